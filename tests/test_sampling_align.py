"""Sampling invariants and sequence-alignment labels."""

from pyspark.sql import functions as F

from pairlab.functions.align import matcher_ratio, similar, typed_labels
from pairlab.functions.hashing import md5_order
from pairlab.operators import sampling


def test_global_rank_matches_sort(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    got = {r["k"]: r["rank"] for r in sampling.global_hash_rank(df, "k", "s").collect()}
    keyed = df.select("k", md5_order("s", ":", F.col("k")).alias("h")).collect()
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(((r["k"], r["h"]) for r in keyed), key=lambda x: (x[1], x[0])))}
    assert got == want


def test_group_split_sizes_and_disjoint(spark):
    df = spark.range(0, 1477).withColumnRenamed("id", "g")
    sp = {r["split"]: r["n"] for r in sampling.group_split(df, "g").groupBy("split").agg(F.count("*").alias("n")).collect()}
    import math
    t = math.ceil(0.2 * 1477)
    v = math.ceil(0.25 * (1477 - t))
    assert sp == {"test": t, "val": v, "train": 1477 - t - v}


def test_stratified_sample_keeps_shares(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("rid"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = sampling.stratified_sample(df, "y", "rid", 300)
    counts = {r["y"]: r["n"] for r in s.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 100, 0: 200}


def test_top_k_per_group_exact(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = sampling.top_k_per_group(df, ["g"], [F.desc("v")], 2).collect()
    assert sorted((r["g"], r["v"]) for r in got) == [(0, 1995), (0, 1998), (1, 1996), (1, 1999), (2, 1994), (2, 1997)]


def test_matcher_and_labels():
    assert abs(matcher_ratio("qabxcd", "abycdf") - 2 * 4 / 12) < 1e-12
    assert similar("Perché", "perche")
    toks = ["il", "gatto", "nero", "dorme"]
    simp = ["il", "gatto", "dorme"]
    assert typed_labels(toks, toks, simp, simp, guarded=False) == ["keep", "keep", "del", "keep"]
    simp2 = ["il", "cane", "nero", "dorme"]
    assert typed_labels(toks, toks, simp2, simp2, guarded=True) == ["keep", "sub", "keep", "keep"]


def test_exact_medians_match_numpy(spark):
    import numpy as np
    from pairlab.operators.profile import exact_medians
    rnd = np.random.default_rng(5)
    a = np.round(rnd.random(501), 2)
    b = np.round(rnd.normal(size=400), 1)
    rows = [(float(a[i]), float(b[i]) if i < len(b) else None) for i in range(len(a))]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["feature"]: r["median"] for r in exact_medians(df, ["a", "b"], n_buckets=8).collect()}
    assert abs(got["a"] - np.median(a)) < 1e-12 and abs(got["b"] - np.median(b)) < 1e-12
