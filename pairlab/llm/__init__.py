"""Operators of a large-scale training-data pipeline (packing, secret scans,
near and exact deduplication, token rollups, archives, fingerprints, language
model scores, toxicity, piece encoding). Nothing outside this subpackage
imports it."""
