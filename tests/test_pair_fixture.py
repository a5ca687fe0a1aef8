"""The pair table: variants derived for a batch at once, rows looked up by key,
nothing kept, and the texts cut into tokens once."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from pairlab.catalog.prep_q import pair_rows, pairs_table
from pairlab.functions import text as T
from pairlab.operators import explain, sampling
from pairlab.plans.prepare import prepare_sentences
from pairlab.sources import fixtures

ID = "original_sentence_idx"
TEXTS = [(1, "La costituzione protegge l'ambiente. Il parlamento approva una legge importantissima, poi basta."),
         (1, "Un altro testo dello stesso documento. Con parole lunghissime e corte"),
         (2, " ".join(f"parola{i % 7} lunghezza" for i in range(60))), (3, ""), (4, None), (5, "Àé ß. \U0001d4d0bc x"),
         (None, "Senza numero restano tutte le parole lunghissime.")]


def documents(spark, tmp_path) -> str:
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variants_are_those_of_the_token_hashes(spark, tmp_path):
    d = documents(spark, tmp_path)
    s = fixtures.sents(spark, d)
    s = s.select("*", fixtures.token_hashes(F.col("tokens"), F.col("sid")).alias("hs"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("v"))
    t = fixtures.simplify_with_hashes(F.col("tokens"), F.col("hs"), F.col("v"))
    want = s.select((F.col("sid") * 10 + F.col("v")).alias("idx"), F.col("sid").alias(ID), T.join_tokens("tokens").alias("original_text"),
                    T.join_tokens(t).alias("simplification"), T.gulpease_complexity("tokens").alias("original_all"),
                    T.gulpease_complexity(t).alias("simplification_all"))
    assert rows(fixtures.pair_table(spark, d)) == rows(want)
    other = s.select(F.col("sid"), F.col("v"), T.gulpease_complexity(t).alias("y"), fixtures.long_share(t).alias("pred")).where("y IS NOT NULL")
    got = fixtures.scored(spark, d).where("label = 0").select("sid", (F.col("row_id") - F.col("sid") * 11).cast("int").alias("v"), "y", "pred")
    assert rows(got.where("sid IS NOT NULL")) == rows(other.where("sid IS NOT NULL"))
    assert got.where("sid IS NULL").count() == other.where("sid IS NULL").count()


def test_lookup_returns_the_rows_of_the_join(spark, tmp_path):
    d = documents(spark, tmp_path)
    for profile in (False, True):
        pairs = fixtures.pair_table(spark, d, profile)
        keys = pairs.where((F.col("idx") % 4 == 1) | F.col("idx").isNull()).select(ID, "idx").distinct().withColumn("kind", F.col("idx") % 3)
        want = rows(sampling.rows_at(pairs, keys, [ID, "idx"]))
        for small in (False, True):
            assert rows(fixtures.pair_rows_at(spark, d, keys, profile, small)) == want
    assert len(want) > 20


def test_preparing_with_the_lookup_gives_the_same_rows(spark, tmp_path):
    d = documents(spark, tmp_path)
    pairs, lean = fixtures.pair_table(spark, d), fixtures.pair_numbers(spark, d)
    assert rows(lean) == rows(pairs.select(*lean.columns))
    for n in (None, 3):
        want = rows(prepare_sentences(pairs, n_sample=n))
        assert want and rows(prepare_sentences(lean, n_sample=n, persist=True, rows_of=pair_rows(spark, d))) == want


def test_the_pair_table_is_not_kept(spark, tmp_path):
    d = documents(spark, tmp_path)
    assert not pairs_table(spark, d).storageLevel.useDisk
    lean = plan(pairs_table(spark, d).select("idx", ID))
    assert "ArrowEvalPython" not in lean and "run(" not in lean and "InMemoryRelation" not in lean


def test_tokens_and_choices_are_made_once(spark, tmp_path):
    d = documents(spark, tmp_path)
    assert plan(fixtures.sents(spark, d)).count("regexp_extract_all") == 1
    ev = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, [])], "idx long, tokens array<string>")
    p = explain.predict_random(ev, 0.5)
    assert "array_contains(lambda" in plan(p)
    assert [(r["idx"], len(r["pred"]), sum(r["pred"])) for r in p.orderBy("idx").collect()] == [(1, 4, 2), (2, 0, 0)]


def test_rows_beyond_the_cap_go_before_the_shuffle(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2990, 1).otherwise(F.col("id")).alias("g"), F.col("id").alias("k"))
    top = sampling.top_k_per_group(df, ["g"], [F.desc("k")], 3)
    found = top._jdf.queryExecution().executedPlan().toString()
    assert found.count("WindowGroupLimit") == 2 and found.count("hashpartitioning(g") == 1
    assert sorted(r["k"] for r in top.collect()) == [*range(2987, 3000)]
    salted = sampling.top_k_per_group(df, ["g"], [F.desc("k")], 3, salt=F.col("k") % 4)
    assert rows(salted) == rows(top)


def test_digests_of_a_batch_are_those_of_each_token():
    keys, sizes = [b"1000001", None, b"", b"5128200000123", b"-7"], np.array([3, 2, 0, 130, 1])
    for k in (keys, [*keys[:-1], b"9" * 70]):                  # the last needs a second block
        want = [b"\xff" * 32 if key is None else hashlib.md5(b"a:%s:%d" % (key, i)).digest() + hashlib.md5(b"b:%s:%d" % (key, i)).digest()
                for key, n in zip(k, sizes) for i in range(n)]
        assert [bytes(x) for x in fixtures._token_digests(k, sizes)] == want


def test_chosen_variants_come_without_a_lambda_over_tokens(spark, tmp_path):
    d = documents(spark, tmp_path)
    keys = spark.range(3).select((F.col("id") * 1_000_000).alias(ID), (F.col("id") * 10_000_000 + 4).alias("idx"))
    for found in (plan(fixtures.pair_rows_at(spark, d, keys, True)), plan(fixtures.pair_numbers(spark, d))):
        assert "zip_with" not in found and "array_distinct" not in found and found.count("regexp_extract_all") == 1


def test_only_the_texts_of_the_wanted_splits_are_fetched(spark, tmp_path):
    d = documents(spark, tmp_path)
    lean, lookup, asked = fixtures.pair_numbers(spark, d), pair_rows(spark, d), []
    every = prepare_sentences(lean, rows_of=lookup)

    def watched(keys, small):
        asked.append(keys)
        return lookup(keys, small)

    for splits in (("test",), ("train", "val")):
        got = prepare_sentences(lean, rows_of=watched, splits=splits)
        want = rows(every.where(F.col("split").isin(*splits)))
        assert want and rows(got) == want
        assert {r["split"] for r in asked[-1].select("split").distinct().collect()} == set(splits)
        assert rows(prepare_sentences(fixtures.pair_table(spark, d), splits=splits)) == want


def test_attributions_of_some_sentences(spark, tmp_path):
    d = documents(spark, tmp_path)
    every = fixtures.sentence_scores(spark, d)
    tokens = fixtures.token_scores(spark, d).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "attribution"))).alias("a"))
    once = "sid >= 2000000"   # the sentences of document 1 come twice
    assert rows(every.where(once).where("size(attributions) > 0")) == rows(tokens.where(once).select(
        "sid", F.col("a.attribution").alias("attributions")))
    ids = every.where("sid % 2 = 0").select("sid")
    found = fixtures.sentence_scores(spark, d, ids)
    assert ids.count() > 2 and rows(found) == rows(every.where("sid % 2 = 0"))
    below = plan(found)
    assert below.index("md5") < below.index("LeftSemi")   # worked out above the join, for the asked ones alone


def test_leakage_prepares_once(spark, tmp_path, monkeypatch):
    from pairlab.catalog import gating_q
    d, made = documents(spark, tmp_path), []
    monkeypatch.setattr(gating_q, "prepared", lambda *a, _of=gating_q.prepared: made.append(a) or _of(*a))
    assert gating_q.c10_gating_leakage(spark, d).first()["n_shared"] == 0 and len(made) == 1
