"""Sampling, capping and group splits in md5 order.

Exact global ranks are computed without a single-partition window: each key
falls into one of ``2**bits`` hash-range buckets; bucket sizes (a table of at
most ``2**bits`` rows, hence safe to broadcast) give per-bucket offsets, and a
window partitioned by bucket numbers keys inside their bucket.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.hashing import md5_order

BROADCAST_LIMIT = 2_000_000  # rows of a bounded table of ids at most
RANK_BUCKET_BITS = 12  # 4096 hash ranges; the offsets table never exceeds this


def _ord_key(seed: str, key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return md5_order(seed, ":", k)


def global_hash_rank(keys: DataFrame, key: str, seed: str, rank_col: str = "rank",
                     total_col: str | None = None, by: list[str] = (), prefix: Column | None = None,
                     bits: int = RANK_BUCKET_BITS) -> DataFrame:
    """Exact 1-based rank of each distinct ``key`` within ``by`` in
    (prefix, md5(seed:key), key) order.

    Returns by..., key, rank [, total]. Distributed: one aggregation over
    (by, prefix, hash range) buckets, a broadcast of those bucket offsets (at most
    |by| x |prefix values| x 2**bits rows), then a window per bucket, so neither a
    hot ``by`` value nor a large key set is funnelled through one task.
    """
    by = list(by)
    h = _ord_key(seed, key)
    base = keys.select(*by, key, *([prefix.alias("_p")] if prefix is not None else [F.lit(0).alias("_p")])).distinct()
    x = base.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 60 - bits))
    counts = x.groupBy(*by, "_p", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = Window.partitionBy(*by).orderBy("_p", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_p", "_b",
        F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    # without groups the offsets are a row a bucket; with them they grow with the groups
    ranked = x.join(offsets if by or prefix is not None else F.broadcast(offsets), [*by, "_p", "_b"]).withColumn(
        rank_col, F.col("_off") + F.row_number().over(Window.partitionBy(*by, "_p", "_b").orderBy("_h", key)))
    cols = [*by, key, rank_col] + ([F.col("_total").alias(total_col)] if total_col else [])
    return ranked.select(*cols)


def sample_ids(keys: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """N distinct keys without replacement (all when fewer exist), md5 order."""
    return global_hash_rank(keys, key, seed).where(F.col("rank") <= n).select(key)


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str, size_bound: int | None = None,
                  broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Keep rows whose key is in ``ids``. The id side is broadcast only
    when its size is bounded (e.g. a sample of n ids) below ``broadcast_limit``."""
    if size_bound is not None and size_bound <= broadcast_limit:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def rows_at(df: DataFrame, winners: DataFrame, keys: list[str], size_bound: int | None = None,
            broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (the group, then the row key) are in the
    narrow table ``winners``, with its further columns. Joined on the row key
    too, so the rows of a hot group spread over all tasks. Null groups match each
    other. ``winners`` is broadcast only when its size is bounded."""
    w = winners.withColumnsRenamed({k: f"_w{i}" for i, k in enumerate(keys)})
    if size_bound is not None and size_bound <= broadcast_limit:
        w = F.broadcast(w)
    same = [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)]
    return df.join(w, same, "inner").drop(*[f"_w{i}" for i in range(len(keys))])


def first_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """First row per group by ``order`` (drop_duplicates keeping the first);
    ``order`` identifies a row within its group (equal values all stay), and a
    group without any value of it has no first row.

    The minimum comes from a hash aggregate over the two narrow columns with
    partial (map-side) sums; the other columns are joined afterwards."""
    winners = df.groupBy(group).agg(F.min(order).alias(order)).where(F.col(order).isNotNull())
    return rows_at(df, winners, [group, order])


def random_key(seed: str, key: str) -> Column:
    """(md5_order(seed:key), key) of an integer key as one decimal number of 38
    digits: the same order as the pair, but a fixed width, so that ``min`` and
    ``min_by`` over it stay hash aggregates."""
    whole = "decimal(20,0)"
    return _ord_key(seed, key).cast(whole) * F.lit(Decimal(2 ** 64)).cast(whole) + F.col(key).cast(whole)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_buckets: int = 16, salt: Column | None = None) -> DataFrame:
    """Top ``k`` rows per group by ``order`` (exact), skew-safe.

    For a small ``k`` each task drops what is beyond the first k rows of a group
    before the shuffle (window group limit), so a hot group sends k rows a task.
    Otherwise, or with a ``salt``, stage 1 ranks inside (group, salt) so a hot
    group is split across ``salt_buckets`` tasks; stage 2 ranks the at most
    k*salt_buckets survivors.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if salt is None and k <= limit:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    if salt is None:
        salt = F.abs(F.hash(*[F.col(c) for c in df.columns])) % salt_buckets
    x = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    x = x.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return x.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= k).drop("_salt", "_r1", "_r2")


def cap_per_group(df: DataFrame, group: str, row_key: str, k: int, seed: str = "42") -> DataFrame:
    """At most k random rows per group (random = md5(seed:row_key) order)."""
    o = _ord_key(seed, row_key)
    if k == 1:
        least = df.select(group, row_key, o.alias("_h")).groupBy(group, "_h").agg(F.min(row_key).alias(row_key))
        return rows_at(df, least.groupBy(group).agg(F.min_by(row_key, "_h").alias(row_key)), [group, row_key])
    return top_k_per_group(df, [group], [o, F.col(row_key)], k)


def _split_ends(total: Column, test_frac: float, val_frac: float) -> tuple[Column, Column]:
    """The last ranks of test and val among ``total`` groups."""
    n_test = F.ceil(F.lit(test_frac) * total)
    return n_test, n_test + F.ceil(F.lit(val_frac) * (total - n_test))


def _split_of(rank: Column, test_end: Column, val_end: Column) -> Column:
    return F.when(rank <= test_end, F.lit("test")).when(rank <= val_end, F.lit("val")).otherwise(F.lit("train"))


def group_split(keys: DataFrame, key: str, test_frac: float = 0.2, val_frac: float = 0.25,
                seed: str = "split") -> DataFrame:
    """Exact two-stage group split. test = first ceil(test_frac*G) groups in
    md5 order, val = next ceil(val_frac*(G - test)), rest train. Returns key, split."""
    r = global_hash_rank(keys, key, seed, total_col="_g")
    return r.select(key, _split_of(F.col("rank"), *_split_ends(F.col("_g"), test_frac, val_frac)).alias("split"))


def with_group_split(groups: DataFrame, key: str, splits: tuple[str, ...] | None = None, test_frac: float = 0.2,
                     val_frac: float = 0.25, seed: str = "split", bits: int = RANK_BUCKET_BITS) -> DataFrame:
    """What a join with ``group_split`` returns for a table that holds each group
    once: the other columns go along with the rank, so nothing is joined back.
    ``splits``: only the rows of these splits; hash ranges without any of their
    ranks are left out before the shuffle that ranks the groups."""
    x = groups.withColumn("_h", _ord_key(seed, key)).withColumn("_b", F.shiftright("_h", 60 - bits))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # <= 2**bits rows
    ranges = counts.select("_b", "_n", F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"),
                           F.sum("_n").over(Window.partitionBy()).alias("_g"))
    test_end, val_end = _split_ends(F.col("_g"), test_frac, val_frac)
    if splits is not None:
        first, last = F.col("_off") + 1, F.col("_off") + F.col("_n")
        meets = {"test": first <= test_end, "val": (last > test_end) & (first <= val_end), "train": last > val_end}
        ranges = ranges.where(reduce(or_, [meets[s] for s in splits], F.lit(False)))
    ranked = x.join(F.broadcast(ranges), "_b").withColumn(
        "_rank", F.col("_off") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    out = ranked.select(*groups.columns, _split_of(F.col("_rank"), test_end, val_end).alias("split"))
    return out if splits is None else out.where(F.col("split").isin(*splits))


def hash_split(keys: DataFrame, key: str, test_pct: int = 20, val_pct: int = 20,
               seed: str = "split") -> DataFrame:
    """E4 (map-only variant): split by md5 bucket thresholds, no shuffle at all;
    shares are exact in expectation only."""
    from pairlab.functions.hashing import md5_bucket
    b = md5_bucket(seed, ":", F.col(key))
    split = (F.when(b < test_pct, F.lit("test")).when(b < test_pct + val_pct, F.lit("val"))
             .otherwise(F.lit("train")))
    return keys.select(key, split.alias("split"))


def dealing_phases(runs: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, int, list[int]]]:
    """The greedy rule (each group, largest first, to the lightest fold, the
    first of equals) over runs (size, groups of that size), largest size first.
    Returns (size, first, last, folds): the groups of a size with ranks first to
    last - 1 go to these folds in turn. Within a run folds join from the lightest
    on, and those that have joined take turns, so a run has n_folds phases at
    most."""
    loads, out = [0] * n_folds, []
    for size, groups in runs:
        waiting = sorted(range(n_folds), key=lambda f: (loads[f], f))
        active, at = [waiting.pop(0)], 0
        while at < groups:
            turns = groups - at
            if waiting:  # until the next fold is the lightest
                x = waiting[0]
                turns = min(turns, sum(max(0, -((loads[a] - loads[x]) // size) + ((loads[x] - loads[a]) % size == 0 and a < x))
                                       for a in active))
            order = sorted(active, key=lambda f: (loads[f], f))
            if turns:
                out.append((size, at, at + turns, order))
            for k, f in enumerate(order):
                loads[f] += size * (turns // len(order) + (k < turns % len(order)))
            at += turns
            if waiting and at < groups:
                active.append(waiting.pop(0))
    return out


def group_kfold(df: DataFrame, key: str, n_folds: int = 5, seed: str = "fold") -> DataFrame:
    """E5: group k-fold, greedily balanced: groups by size (largest first, then
    md5 order) each go to the fold with fewest rows so far. Only the histogram
    size -> groups goes to the driver (distinct sizes are fewer than the square
    root of twice the rows); groups are ranked within their size and look their
    turn up. Returns key, fold."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    runs = [(r["n"], r["m"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()]
    phases = df.sparkSession.createDataFrame(dealing_phases(sorted(runs, reverse=True), n_folds),
                                             "n long, first long, last long, folds array<int>")
    r = global_hash_rank(sizes, key, seed, by=["n"]).withColumn("rank", F.col("rank") - 1)
    dealt = r.join(phases, "n").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    turn = ((F.col("rank") - F.col("first")) % F.size("folds")).cast("int")
    return dealt.select(key, F.get("folds", turn).alias("fold"))


def stratified_sample(df: DataFrame, stratum: str, row_key: str, n: int, seed: str = "42") -> DataFrame:
    """N rows keeping class shares. Stratum s gets floor(n * n_s / N) rows and
    the remaining rows go to the strata with the largest fractional parts (lower
    stratum first on ties); rows inside a stratum in md5 order. Ranks come from
    ``global_hash_rank`` per stratum, so a dominant class is ranked by many tasks."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_ns"))   # one row per class
    exact = F.lit(float(n)) * F.col("_ns") / F.sum("_ns").over(Window.partitionBy())
    c = counts.withColumn("_ex", exact).withColumn("_fl", F.floor("_ex"))
    rem = F.lit(n) - F.sum("_fl").over(Window.partitionBy())
    extra = (F.row_number().over(Window.orderBy(F.desc(F.col("_ex") - F.col("_fl")), F.asc(stratum))) <= rem).cast("long")
    alloc = c.select(stratum, F.least(F.col("_ns"), F.col("_fl") + extra).alias("_take"))
    r = global_hash_rank(df.select(stratum, row_key), row_key, seed, by=[stratum], rank_col="_rn")
    keep = r.join(F.broadcast(alloc), stratum).where(F.col("_rn") <= F.col("_take")).select(stratum, row_key)
    return df.join(keep, [stratum, row_key], "left_semi")


def random_rows(df: DataFrame, row_key: str, n: int, seed: str = "42") -> DataFrame:
    """N random rows (md5 order); a top-n, the sampling is the feature."""
    return df.orderBy(_ord_key(seed, row_key), F.col(row_key)).limit(n)
