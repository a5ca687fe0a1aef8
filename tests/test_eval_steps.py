"""steps of the evaluation against plain statements of them."""

import random

import pytest
from pyspark.sql import functions as F

from pairlab.catalog import explain_q
from pairlab.functions import align, ter
from pairlab.operators import explain, sampling
from test_pair_fixture import documents, plan, rows


@pytest.mark.parametrize("splits", [None, ("test",), ("val",), ("train", "test")])
def test_groups_keep_their_columns_along_with_the_split(spark, splits):
    groups = spark.createDataFrame([(i if i else None, f"x{i}") for i in range(300)], "id long, x string")
    want = groups.join(sampling.group_split(groups.select("id"), "id"), "id")
    if splits:
        want = want.where(F.col("split").isin(*splits))
    for bits in (12, 3):
        assert rows(sampling.with_group_split(groups, "id", splits, bits=bits)) == rows(want)


def test_lexicon_prediction_is_that_of_the_joined_token_rows(spark):
    ev = spark.createDataFrame([(1, ["Il", "Cane", "."], ["il", "cane", "."], ["DET", "NOUN", "PUNCT"]), (2, [], [], []),
                                (3, ["gatto"], ["gatto"], ["NOUN"]), (4, ["gatto", "gatto"], ["gatto", "gatto"], ["ADV", "DET"])],
                               "idx long, tokens array<string>, lemmas array<string>, pos array<string>")
    for words in (["gatto", "il", "gatto"], ["cane"], []):
        lexicon = spark.createDataFrame([(w,) for w in words], "lemma string")
        t = explain.lexicon_flags(ev, lexicon).withColumn("p", (F.col("pos").isin(*explain.CONTENT_POS) & ~F.col("in_lexicon")).cast("int"))
        assert t.count() == 6
        want = {1: [0, int("cane" not in words), 0], 3: [int("gatto" not in words)], 4: [int("gatto" not in words), 0]}
        got = explain.predict_lexicon(ev, lexicon)
        assert {r["idx"]: r["pred"] for r in got.collect()} == want
        assert "collect_list" not in plan(got)   # no token rows to put together again


def test_an_eval_set_with_one_reader_is_not_kept(spark, tmp_path):
    d = documents(spark, tmp_path)
    for query in (explain_q.c9_lexicon_membership, explain_q.d25_reason_counts):
        assert "InMemoryRelation" not in plan(query(spark, d))
    assert explain_q.eval_set(spark, d, columns=explain_q.EVALUATED).columns == list(explain_q.EVALUATED)
    assert "dep_of" not in plan(explain_q.c9_lexicon_membership(spark, d)) and "dep:" not in plan(explain_q.c9_lexicon_membership(spark, d))


def plain_trace(hyp, ref):
    dp = [[i + j if 0 in (i, j) else 0 for j in range(len(ref) + 1)] for i in range(len(hyp) + 1)]
    for i, h in enumerate(hyp, 1):
        for j, r in enumerate(ref, 1):
            dp[i][j] = min(dp[i - 1][j - 1] + (h != r), dp[i - 1][j] + 1, dp[i][j - 1] + 1)
    i, j, found = len(hyp), len(ref), []
    while i or j:
        if i and j and dp[i][j] == dp[i - 1][j - 1] + (hyp[i - 1] != ref[j - 1]):
            found.append("m" if hyp[i - 1] == ref[j - 1] else "s")
            i, j = i - 1, j - 1
        elif i and dp[i][j] == dp[i - 1][j] + 1:
            found.append("d")
            i -= 1
        else:
            found.append("i")
            j -= 1
    return dp[-1][-1], found[::-1]


def test_distances_and_traces_by_bits():
    dice = random.Random(5)
    for _ in range(300):
        words = [f"w{i}" for i in range(dice.choice([2, 6, 30]))]
        hyp, ref = ([dice.choice(words) for _ in range(dice.randrange(low, 80))] for low in (0, 1))
        places = ter._places(ref)
        assert ter._edit_trace(hyp, ref, places) == plain_trace(hyp, ref)
        assert ter._edits(hyp, places, len(ref)) == plain_trace(hyp, ref)[0]


def test_words_are_compared_once():
    align.similar.cache_clear()
    tokens, simple = ["parole"] * 3, ["parolone"]
    for _ in range(4):
        align.typed_labels(tokens, tokens, simple, simple)
    assert align.similar.cache_info().misses == 1
    for a, b in (("parole", "parolone"), ("lunghissima", "lunghissime"), ("abc", "xyz"), ("L'acqua", "acqua")):
        x, y = align.norm(a), align.norm(b)
        assert align.similar(a, b) == (x in y or y in x or align.matcher_ratio(x, y) >= align.SIMILARITY_THRESHOLD)
