"""Property tests of the per-row text metrics against plain-Python statements."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairlab.functions import editdist
from pairlab.functions.editdist import (batched_distances, word_edit_distance, word_edit_distance_expr,
                                        word_edit_distance_py, word_edit_distances)
from pairlab.functions.sari import batched_sari, sari_py, with_sari, with_sari_expr
from pairlab.functions.ter import ter_edits, ter_score

VOCAB = list("abcdefg")


def _pairs(n, seed=1):
    rnd = random.Random(seed)
    return [([rnd.choice(VOCAB) for _ in range(rnd.randint(0, 9))], [rnd.choice(VOCAB) for _ in range(rnd.randint(0, 9))])
            for _ in range(n)]


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def test_edit_distance_properties():
    for a, b in _pairs(300):
        d1, d15, d2 = (word_edit_distance_py(a, b, c) for c in (1.0, 1.5, 2.0))
        assert word_edit_distance_py(a, a, 1.5) == 0
        assert d1 <= d15 <= d2
        assert d2 == len(a) + len(b) - 2 * _lcs(a, b)


def test_edit_distance_spark_forms_agree(spark):
    rows = _pairs(60, seed=2)
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    out = df.select("a", "b", word_edit_distance("a", "b", 1.5).alias("u"),
                    word_edit_distance_expr("a", "b", 1.5).alias("e")).collect()
    for r in out:
        ref = word_edit_distance_py(list(r["a"]), list(r["b"]), 1.5)
        assert r["u"] == ref and r["e"] == ref


def _ragged(n, seed, longest=25):
    rnd = random.Random(seed)
    rows = [[rnd.choice(VOCAB) for _ in range(rnd.randint(0, longest))] for _ in range(n)]
    return pd.Series([None if k % 17 == seed % 17 else r for k, r in enumerate(rows)])


def test_batched_distances_of_mixed_lengths(monkeypatch):
    a, b, costs = _ragged(400, 1), _ragged(400, 2), (1.0, 1.3, 1.5, 2.0)
    for cells in (1, 300, editdist.BLOCK_CELLS):   # a pair a block, a few, all
        monkeypatch.setattr(editdist, "BLOCK_CELLS", cells)
        for x, y, row in zip(a, b, batched_distances(a, b, costs)):
            want = [np.nan if x is None or y is None else word_edit_distance_py(x, y, c) for c in costs]
            np.testing.assert_allclose(row, want, atol=1e-9)
    assert batched_distances(a[:0], b[:0], costs).shape == (0, 4)
    assert batched_distances(pd.Series([[None, "a"], []]), pd.Series([[None], []]), (1.5,)).tolist() == [[1.0], [0.0]]


def test_distance_of_5000_tokens_is_whole(spark):
    rnd = random.Random(7)
    a = [str(rnd.randint(0, 300)) for _ in range(5000)]
    b = [x for k, x in enumerate(a) if k % 10]
    df = spark.createDataFrame([(a, b), (a, None), ([], ["x"])], "a array<string>, b array<string>")
    got = [tuple(r.d or ()) for r in df.select(word_edit_distances("a", "b").alias("d")).collect()]
    assert got == [(500.0, 500.0, 500.0), (None, None, None), (1.0, 1.0, 1.0)]


def test_batched_sari_of_mixed_lengths():
    s, c, r = _ragged(300, 3), _ragged(300, 4), _ragged(300, 5)
    c[10], r[11] = s[10], s[11]
    for x, y, z, got in zip(s, c, r, batched_sari(s, c, r)):
        want = np.nan if x is None or y is None or z is None else sari_py(x, y, z)
        np.testing.assert_allclose(got, want, atol=1e-9)
    empty = pd.Series([[], []])
    assert batched_sari(empty, empty, empty).tolist() == [100.0, 100.0] and not len(batched_sari(s[:0], c[:0], r[:0]))


def test_sari_udf_and_expression_agree(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(40):
        mk = lambda: " ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 8)))
        rows.append((mk(), mk(), mk()))
    df = spark.createDataFrame(rows, "s string, c string, r string")
    a = with_sari(df, "s", "c", "r", "u")
    b = with_sari_expr(a, "s", "c", "r", "e")
    for r in b.collect():
        ref = sari_py(r["s"].split(), r["c"].split(), r["r"].split())
        assert abs(r["u"] - ref) < 1e-9 and abs(r["e"] - ref) < 1e-9


def test_sari_identity_and_range():
    assert abs(sari_py(["a", "b"], ["a", "b"], ["a", "b"]) - 100.0) < 1e-9
    for a, b in _pairs(100, seed=4):
        v = sari_py(a, b, a[:3] + b[:2])
        assert 0.0 <= v <= 100.0


def test_ter_bounds_and_shift():
    assert ter_score("a b c", "a b c") == 0.0
    # one block shift repairs the order: 1 edit over 4 reference words
    assert ter_edits("c d a b".split(), "a b c d".split())[0] == 1
    for a, b in _pairs(150, seed=5):
        if not b:
            continue
        edits, n = ter_edits(a, b)
        assert edits <= word_edit_distance_py(a, b, 1.0)
        assert n == len(b)


def test_char_levenshtein_matches_bruteforce(spark):
    rows = [("città è bella", "citta e bela"), ("", "abc"), ("perché", "perche"), ("ééé", "e")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(F.levenshtein("a", "b")).collect()]
    want = [int(word_edit_distance_py(list(a), list(b), 1.0)) for a, b in rows]
    assert got == want


def test_normal_form_drops_every_accent(spark):
    from pairlab.functions import align, text
    tokens = ["Škoda", "ő", "ﬁne", "  L'Aquila\t", "Ångström", "é", "ABC", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select(text.norm_token("t").alias("n"))
    assert [r.n for r in df.collect()] == [align.norm(t) for t in tokens] == [
        "skoda", "o", "fine", "laquila", "angstrom", "e", "abc", ""]


def test_term_buckets_are_those_of_the_model_stage(spark):
    from pyspark.ml.feature import HashingTF
    from pairlab.operators.models import term_buckets
    terms = ["abcdefgh"[:k] for k in range(1, 9)] + ["è", "perché"]
    hashing = HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 18)
    df = spark.createDataFrame([(t,) for t in terms], "_term string")
    got = {r._term: r.bucket for r in term_buckets(hashing, df).collect()}
    assert got == {t: hashing.indexOf(t) for t in terms}


def test_empty_inputs_of_ranking_metrics(spark):
    from pairlab.operators import metrics
    empty = spark.createDataFrame([], "s double, y int")
    assert metrics.roc_auc(empty, "s", "y").first().auc is None
    assert metrics.exact_quantiles(empty, "s", [0.5]).count() == 0
