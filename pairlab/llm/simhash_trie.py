"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie
self-join under a Hamming budget, grouped into connected components.

Fingerprints are computed in one pass (Arrow batches, no shuffle of texts) and
the rest works on distinct fingerprints. With budget d a fingerprint is cut
into d+1 blocks of bits; a linked pair agrees in one block at least. For each
block the bits are turned so that this block comes first: all trie paths of
the pair then run together down to the end of the block, and the traversal of
node pairs starts there with no bit spent. Node pairs that hold many
fingerprints are taken further down level by level as Spark joins; small ones
are traversed to the leaves within tasks, many node pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.components import connected
from pairlab.llm.storage import stored

BITS = 64
SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
#: A node pair with more fingerprints than this on a side is split in Spark.
NODE_ROWS = 4096
#: Bits that one Spark level goes down.
LEVEL_BITS = 8
#: Shingles hashed at once within a document.
BLOCK = 1 << 16
#: Bits set in each byte value, lowest bit first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text: A-Z lower-cased, words between ASCII white
    space, shingles with repeats (a shorter text is one shingle, one without
    words gives 0); a bit is set if over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + size - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.array([xxhash.xxh64_intdigest(line[s:e], seed)
                           for s, e in zip(starts, ends[size - 1:].tolist())], np.uint64)
        for k, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            counts[k] += np.bincount(column, minlength=256)
    set_bits = (counts @ BYTE_BITS).reshape(-1)  # of bit 0, 1, ..
    return int((2 * set_bits > n) @ (1 << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp) for every row; tag is a hash of the text, fp the
    fingerprint as a signed long."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), text_tag(text).alias("tag"), text.alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x.as_py(), shingle) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "tag", "fp"])

    return rows.mapInArrow(run, schema)


def text_tag(text: Column) -> Column:
    """A hash that tells the rows of one id apart (null counts as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def trie_pairs(group: np.ndarray, value: np.ndarray, side: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values within ``budget`` bits, for many node pairs at once.

    Rows are sorted by (group, side, value); a group with one side (0) is a
    node paired with itself, one with sides 0 and 1 a pair of nodes. The
    traversal goes down one bit at a time with all node pairs in step: each
    splits into its children's pairs, those of unlike bits pay one, and what
    exceeds the budget is pruned. Returns the row numbers of the pairs found."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[new[1:], n]
    first = np.flatnonzero(np.r_[True, group[new][1:] != group[new][:-1]])
    two = np.r_[first[1:], len(new)] - first == 2
    other = first + two
    xlo, xhi, ylo, yhi, cost = new[first], end[first], new[other], end[other], np.zeros(len(first), np.int64)
    for bit in range(BITS - 1, -1, -1):
        ones = np.r_[0, np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        xm, ym = xhi - (ones[xhi] - ones[xlo]), yhi - (ones[yhi] - ones[ylo])
        same = (xlo == ylo) & (xhi == yhi)
        parts = [(xlo, xm, ylo, ym, cost, None), (xm, xhi, ym, yhi, cost, None), (xlo, xm, ym, yhi, cost + 1, None),
                 (xm, xhi, ylo, ym, cost + 1, ~same)]  # of a node with itself one mixed pair is enough
        kept = []
        for a, b, c, d, e, also in parts:
            # empty nodes, a single value with itself, and what is over budget go
            keep = (a < b) & (c < d) & (e <= budget) & ~((a == c) & (b == d) & (b - a == 1))
            if also is not None:
                keep &= also
            kept.append([v[keep] for v in (a, b, c, d, e)])
        xlo, xhi, ylo, yhi, cost = (np.concatenate(v) for v in zip(*kept, strict=True))
        if not len(xlo):
            break
    return xlo, ylo


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each value to its root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    found = [(x, find(x)) for x in root]
    found = [(x, y) for x, y in found if x != y]
    return np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64)


def _traverse(budget: int):
    """mapInArrow function over rows (leaf, side, fp, turned), all rows of a
    leaf together: links (a, b) between fingerprints."""

    def links(leaf, side, fp, turned):
        order = np.lexsort((turned.view(np.uint64), side, leaf))
        x, y = trie_pairs(leaf[order], turned.view(np.uint64)[order], side[order], budget)
        a, b = spanning_links(fp[order][x], fp[order][y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(v) for v in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            whole = rows[0] != rows[0][-1]  # the last leaf may go on in the next batch
            held = [v[~whole] for v in rows]
            if whole.any():
                yield links(*(v[whole] for v in rows))
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def _top(bits: int) -> Column:
    return F.shiftrightunsigned("turned", BITS - bits)


def linked_fingerprints(fps: DataFrame, budget: int = MAX_DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints (column fp, distinct)
    within ``budget`` bits of one another, as spanning links of each node pair."""
    spark = fps.sparkSession
    blocks = budget + 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]  # turned left by cuts[k], block k comes first
    turned = F.array(*[F.struct(
        F.lit(k).alias("block"),
        (F.col("fp") if not cut else F.shiftleft("fp", cut).bitwiseOR(F.shiftrightunsigned("fp", BITS - cut)))
        .alias("turned")) for k, cut in enumerate(cuts[:-1])])
    members = fps.select("fp", F.explode(turned).alias("t")).select("fp", "t.block", "t.turned")
    depth = min(b - a for a, b in zip(cuts, cuts[1:]))
    nodes = (members.groupBy("block", _top(depth).alias("px")).count().where("count > 1"))
    members = stored(members.withColumn("px", _top(depth)).join(nodes.select("block", "px"), ["block", "px"])
                     .drop("px"), "trie-members")
    pairs = nodes.select("block", "px", F.col("px").alias("py"), F.col("count").alias("nx"),
                         F.col("count").alias("ny"))
    found = None
    while True:
        pairs = stored(pairs, "trie-nodes")
        large = F.greatest("nx", "ny") > node_rows if depth < BITS else F.lit(False)
        leaves = pairs.where(~large).withColumn("leaf", F.xxhash64("block", "px", "py"))
        at = members.withColumn("p", _top(depth))
        sides = leaves.select("block", "leaf", F.explode(F.when(
            F.col("px") == F.col("py"), F.array(F.struct(F.lit(0).alias("side"), F.col("px").alias("p"))))
            .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("px").alias("p")),
                               F.struct(F.lit(1).alias("side"), F.col("py").alias("p"))))).alias("s")
        ).select("block", "leaf", "s.side", "s.p")
        rows = at.join(sides, ["block", "p"]).select("leaf", "side", "fp", "turned")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a leaf has at most 2 * node_rows rows, so dealing by leaf is even
        links = (rows.repartition(parts, "leaf").sortWithinPartitions("leaf")
                 .mapInArrow(_traverse(budget), "a long, b long"))
        found = links if found is None else found.unionByName(links)
        if depth >= BITS or pairs.where(large).isEmpty():
            return found
        below = min(depth + LEVEL_BITS, BITS)
        heavy = pairs.where(large).select("block", "px", "py")
        parents = heavy.select("block", F.col("px").alias("p")).union(heavy.select("block", "py")).distinct()
        children = (at.join(parents, ["block", "p"]).groupBy("block", "p", _top(below).alias("c")).count())
        x = children.select("block", F.col("p").alias("px"), F.col("c").alias("cx"), F.col("count").alias("nx"))
        y = children.select("block", F.col("p").alias("py"), F.col("c").alias("cy"), F.col("count").alias("ny"))
        pairs = (heavy.join(x, ["block", "px"]).join(y, ["block", "py"])
                 .where((F.col("px") != F.col("py")) | (F.col("cx") <= F.col("cy")))
                 .where(F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) <= budget)
                 .where((F.col("cx") != F.col("cy")) | (F.col("nx") > 1))
                 .select("block", F.col("cx").alias("px"), F.col("cy").alias("py"), "nx", "ny"))
        depth = below


def grouped(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, node_rows: int = NODE_ROWS,
            id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, fp) of every row, and (fp, first, component) of every
    distinct fingerprint; first is its least id, component the least
    fingerprint reachable."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    smallest = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    group = connected(linked_fingerprints(smallest.select("fp"), max_distance, node_rows))
    return fps, smallest.join(group, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                    node_rows: int = NODE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 hex digits; component_id: the smallest id reachable over
    links of at most ``max_distance`` differing bits, itself included. Null
    and empty texts have fingerprint 0 and are linked like any other; repeated
    rows give a row each; null ids stay and never name a component unless all
    its ids are null; an empty table gives no rows; other columns are not
    read."""
    fps, named = grouped(docs, shingle, max_distance, node_rows, id_col, text_col)
    roots = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(roots, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                     "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, one row of each component: that with the
    least id (null ids come last, texts of one id are ordered by a hash; of
    rows that repeat in id and text any one)."""
    fps, named = grouped(docs, shingle, max_distance, NODE_ROWS, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    rows = fps.join(named.select("fp", "component"), "fp").groupBy("component", "doc_id", "tag").agg(
        F.count("*").alias("copies"))
    best = rows.groupBy("component").agg(F.min(F.struct(*[place[c].alias(c) for c in ("no_id", "doc_id", "tag")],
                                                        "copies")).alias("best"))
    stays = best.select(F.col("best.doc_id").alias("stay_id"), F.col("best.tag").alias("stay_tag"),
                        F.col("best.copies").alias("copies"))
    tagged = docs.select(docs[id_col].alias("doc_id"), text_tag(docs[text_col].cast("string")).alias("tag"),
                         F.struct("*").alias("row"))
    kept = tagged.join(stays.hint("shuffle_hash"), tagged["doc_id"].eqNullSafe(stays["stay_id"]) & (
        tagged["tag"] == stays["stay_tag"]))
    repeated = kept.where("copies > 1").groupBy("stay_id", "stay_tag").agg(F.first("row").alias("row"))
    return kept.where("copies = 1").select("row.*").unionByName(repeated.select("row.*"))
