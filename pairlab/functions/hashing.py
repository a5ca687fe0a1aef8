"""Deterministic pseudo-random keys from md5.

All random choices of the library (sampling, shuffles, random baselines) are
re-specified as md5 order so that results are reproducible on any cluster
size and can be recomputed by an independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_str(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def md5_of(*parts) -> Column:
    return F.md5(F.concat(*[_as_str(p) for p in parts]))


def md5_bucket(*parts, mod: int = 100) -> Column:
    """First 8 hex digits of md5(concat(parts)) as an integer, modulo ``mod``."""
    return F.conv(F.substring(md5_of(*parts), 1, 8), 16, 10).cast("bigint") % F.lit(mod)


def md5_order(*parts) -> Column:
    """A 60-bit sort key (first 15 hex digits of md5); ties broken by the caller."""
    return F.conv(F.substring(md5_of(*parts), 1, 15), 16, 10).cast("bigint")
