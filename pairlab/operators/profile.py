"""Feature profiling statistics.

All per-feature statistics of a table are computed in one aggregation (never
a loop of jobs); the resulting scalars (two per feature, bounded by the
schema width) come back as literals for the row-level step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = "original_sentence_idx"


def _stack(df: DataFrame, keys: list[str], features: list[str], value: str = "value") -> DataFrame:
    """Wide -> long (key..., feature, value) without a shuffle."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias(value)) for f in features])
    return df.select(*keys, F.inline(entries))


def feature_deltas(sentences: DataFrame, features: list[str]) -> DataFrame:
    """C4: per id, original minus simplified value of every feature; ids with
    any missing value dropped. One aggregation per id (no self-join)."""
    aggs = []
    for f in features:
        aggs.append(F.max(F.when(F.col("is_original"), F.col(f))).alias(f"_o_{f}"))
        aggs.append(F.max(F.when(~F.col("is_original"), F.col(f))).alias(f"_s_{f}"))
    per_id = sentences.groupBy(ID).agg(*aggs)
    return per_id.select(ID, *[(F.col(f"_o_{f}") - F.col(f"_s_{f}")).alias(f) for f in features]).dropna()


def moments(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of every feature in ONE job (2 scalars per feature)."""
    row = df.agg(*[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
                 *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)]).first()
    return {f: (row[f"m_{i}"], row[f"s_{i}"]) for i, f in enumerate(features)}


def zscore(df: DataFrame, features: list[str], stats: dict[str, tuple[float, float]], zero_std_one: bool = False) -> DataFrame:
    """(x - mean) / std_pop. A zero std gives null (D20), or divides by 1 (H2)."""
    cols = []
    for f in features:
        m, s = stats[f]
        if s is None or s == 0:
            z = (F.col(f) - F.lit(m)) if zero_std_one else F.lit(None).cast("double")
        else:
            z = (F.col(f) - F.lit(m)) / F.lit(s)
        cols.append(z.alias(f))
    keep = [c for c in df.columns if c not in features]
    return df.select(*keep, *cols)


def delta_profile(sentences: DataFrame, features: list[str]) -> DataFrame:
    """Z-scored per-id feature drops (population std; zero std -> null)."""
    d = feature_deltas(sentences, features)
    return zscore(d, features, moments(d, features))


def top_features(z: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """The k features with the highest z per id, for all ids at once
    (ties: feature name). Returns id, rank, feature, z."""
    long = _stack(z, [ID], features, "z").where(F.col("z").isNotNull())
    w = Window.partitionBy(ID).orderBy(F.desc("z"), F.asc("feature"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_by_side(sentences: DataFrame, features: list[str], top: int = 10) -> DataFrame:
    """Mean of every feature for originals and simplifications, their
    difference, the ``top`` largest drops. One aggregation + a stack."""
    aggs = []
    for i, f in enumerate(features):
        aggs.append(F.avg(F.when(F.col("is_original"), F.col(f))).alias(f"o{i}"))
        aggs.append(F.avg(F.when(~F.col("is_original"), F.col(f))).alias(f"s{i}"))
    wide = sentences.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"o{i}").alias("originale"),
                              F.col(f"s{i}").alias("semplificata")) for i, f in enumerate(features)])
    long = wide.select(F.inline(rows)).withColumn("delta", F.col("originale") - F.col("semplificata"))
    return long.orderBy(F.desc("delta"), F.asc("feature")).limit(top)


def exact_medians(df: DataFrame, features: list[str], n_buckets: int = 64) -> DataFrame:
    """H1 statistics: exact median (linear interpolation) of every feature, all
    features in the same jobs.

    Long form -> counts per (feature, value) with partial aggregation -> per
    feature value-range buckets from a bounded quantile sketch (features x
    n_buckets numbers) -> bucket totals (a table of at most that size) broadcast
    as offsets -> running counts inside each (feature, bucket). No feature's
    values are ever sorted in a single task."""
    from pyspark import StorageLevel

    long = _stack(df, [], features).where(F.col("value").isNotNull())
    cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    sk = {r["feature"]: r["b"] for r in cnt.groupBy("feature").agg(
        F.percentile_approx("value", probs, 4 * n_buckets).alias("b")).collect()}
    bounds = F.create_map(*[x for f in features for x in (
        F.lit(f), F.array(*[F.lit(float(v)) for v in (sorted(set(sk.get(f) or [])) or [0.0])]))])
    b = cnt.withColumn("_rb", F.size(F.filter(F.element_at(bounds, F.col("feature")), lambda t: t < F.col("value"))))
    tot = b.groupBy("feature", "_rb").agg(F.sum("c").alias("_bc"))
    w_prev = Window.partitionBy("feature").orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("feature", "_rb", F.coalesce(F.sum("_bc").over(w_prev), F.lit(0)).alias("_off"),
                     F.sum("_bc").over(Window.partitionBy("feature")).alias("n"))
    w_in = Window.partitionBy("feature", "_rb").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    c = b.join(F.broadcast(off), ["feature", "_rb"]).select(
        "feature", "value", "c", "n", (F.col("_off") + F.sum("c").over(w_in)).alias("cum"))
    lo = F.floor((F.col("n") - 1) / 2.0)
    hi = F.ceil((F.col("n") - 1) / 2.0)
    hit = lambda k: (k >= F.col("cum") - F.col("c")) & (k < F.col("cum"))
    picks = c.select("feature", F.when(hit(lo), F.col("value")).alias("v_lo"), F.when(hit(hi), F.col("value")).alias("v_hi"))
    m = picks.groupBy("feature").agg(F.max("v_lo").alias("v_lo"), F.max("v_hi").alias("v_hi"))
    return m.select("feature", ((F.col("v_lo") + F.col("v_hi")) / 2.0).alias("median"))


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    """H1: nulls replaced by the exact column median."""
    med = {r["feature"]: r["median"] for r in exact_medians(df, features).collect()}   # one scalar per feature
    return df.fillna({f: med[f] for f in features if med.get(f) is not None})


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """H2: population-std standardisation; constant columns are only centred."""
    return zscore(df, features, moments(df, features), zero_std_one=True)


def balanced_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """H6: class-balanced sample weights n / (2 * n_class). Class counts form a
    table with one row per class (bounded), broadcast back to the rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    counts = counts.withColumn(weight, F.sum("_nc").over(Window.partitionBy()) / (2.0 * F.col("_nc"))).drop("_nc")
    return df.join(F.broadcast(counts), label)
