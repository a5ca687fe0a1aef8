"""Pairs derived from texts that are stored once, references found in the row,
and hashes, vectors and tasks that do not multiply."""

import time

import numpy as np
from pyspark.sql import functions as F

from pairlab.catalog import profile_q
from pairlab.functions import sari as S
from pairlab.functions.editdist import word_edit_distance_py, word_edit_distances
from pairlab.operators import models as ML
from pairlab.operators import selection
from pairlab.plans import gating as L3
from pairlab.sources import fixtures

ID = "original_sentence_idx"
TEXTS = [(1, "La costituzione protegge l'ambiente importantissimo. Il parlamento approva una legge importantissima, poi basta."),
         (1, "Un altro testo dello stesso documento. Con parole lunghissime e corte, poi altre lunghissime"),
         (1, "Un altro testo dello stesso documento. Con parole lunghissime e corte, poi altre lunghissime"),
         (2, " ".join(f"parola{i % 7} lunghezza" for i in range(60))), (3, ""), (4, None), (5, "\u00c0\u00e9 \u00df. \U0001d4d0bc x"),
         (-1, "Un numero sotto lo zero"), (None, "Senza numero restano tutte le parole lunghissime.")]


def documents(spark, tmp_path) -> str:
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_the_next_variant_is_found_before_pairs_are_dealt_out(spark, tmp_path):
    d = documents(spark, tmp_path)
    p = fixtures.pair_table(spark, d)
    before = F.when(F.col("idx") % 10 == 0, F.col("idx") + 9).otherwise(F.col("idx") - 1)
    want = p.join(p.select(before.alias("idx"), F.col("simplification").alias("reference")), "idx")
    got = fixtures.pair_table_with_next(spark, d)
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [i for i, x in enumerate(plan) if "Join" in x]
    dealt = [i for i, x in enumerate(plan) if "Generate posexplode(" in x]
    assert len(at) == 1 and dealt[0] < at[0] < dealt[1]   # variants above the join, sentences below it


def test_gating_rows_from_held_texts_are_those_of_the_pair_table(spark, tmp_path):
    d = documents(spark, tmp_path)
    p = fixtures.pair_table(spark, d)
    sentences = p.select(ID, F.when(F.col(ID) % 2 == 0, "test").otherwise("val").alias("split")).distinct()
    want = L3.gating_rows(p, sentences)
    held = fixtures.HeldTexts(spark, d)
    held.rows(p.select(ID, "idx"))
    got = L3.gating_rows(held.of, sentences, held.rows)
    assert rows(want) and rows(got.select(want.columns)) == rows(want)
    plain = L3.gating_rows(held.of, sentences, held.rows, with_texts=False)
    assert rows(plain) == rows(want.select(plain.columns))
    assert "documents" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "gold_text" not in plain.columns


def test_a_long_text_is_hashed_once(spark):
    text = " ".join(f"parola{i} lunghezza" for i in range(1500))
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    began = time.time()
    got = [r[0] for r in df.select(fixtures.stub_generate(F.col("t"), F.col("t"))).collect()]
    assert time.time() - began < 30   # 4 x 4,500 squared digests before
    assert got == [*fixtures.stub_generator_factory()([text, ""]), None]


def test_sari_cuts_texts_as_the_tokenizer_does(spark):
    import random
    r = random.Random(1)
    words = ["a", "b", "cc", "dd.", "e,e", "\u0130x", "\u00df", "-", "\u03b1\u03a3", "l'x", "x\u00a0y"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", "  ", "\t", "\n", ""]) for _ in range(r.randrange(14)))
    pairs = [(a, text(), text()) for a in (text() for _ in range(200))]
    pairs += [(a, a, b) for a, b, _ in pairs[:20]] + [(None, "a", "b"), ("a", None, "b"), ("", "", "")]
    df = spark.createDataFrame(pairs, "a string, b string, c string")
    from pairlab.functions.text import tokenize
    got = df.select(S.sari("a", "b", "c").alias("s"), *[tokenize(F.lower(x)).alias(x) for x in "abc"]).collect()
    for x in got:
        if None in (x["a"], x["b"], x["c"]):
            assert x["s"] is None
        else:
            assert abs(x["s"] - S.sari_py(x["a"], x["b"], x["c"])) < 1e-9
    assert "regexp_extract_all" not in df.select(S.sari("a", "b", "c"))._jdf.queryExecution().optimizedPlan().toString()


def test_word_distances_of_null_tokens_and_null_lists(spark):
    lists = [(["a", None, "b"], [None, "a"]), ([], ["x"]), (["x"], []), ([], []), (None, ["a"]), (["a"], None), (["a", "b"], ["b", "c"])]
    df = spark.createDataFrame(lists, "a array<string>, b array<string>")
    for r in df.select("a", "b", word_edit_distances("a", "b").alias("d")).collect():
        want = [None if r["a"] is None or r["b"] is None else word_edit_distance_py(r["a"], r["b"], c) for c in (1.0, 1.5, 2.0)]
        assert list(r["d"]) == want


def test_text_models_of_one_set_of_vectors(spark, monkeypatch):
    data = [(f"parola{i % 5} casa{i % 3} lunga", float(i % 5 < 2)) for i in range(60)]
    df = spark.createDataFrame(data, "text string, label double")
    vectors, fit = ML.text_models(df, "label")
    for reg in (0.0, 0.1):
        a, b = (m.transform(df).select(F.col("probability").cast("string")) for m in (fit(reg), ML.text_pipeline("label", reg=reg).fit(df)))
        values = lambda x: np.array([[float(y) for y in z[0].strip("[]").split(",")] for z in x.collect()])
        assert np.allclose(values(a), values(b), atol=1e-6)
    assert "regexp" not in str(fit(0.1).stages[-1]) and len(fit(0.1).stages) == len(vectors.stages) + 1
    monkeypatch.setattr(profile_q, "prepared_features", None)   # no profile is worked out for the text models
    columns = "original_sentence_idx long, text string, score float, is_original boolean, split string"
    monkeypatch.setattr(profile_q, "prepared", lambda *_: spark.createDataFrame([(1, "a", 0.5, True, "test")], columns))
    assert rows(profile_q._text_data(spark, "")) == [(1, 1, 0.5, "test", "a")]


def test_a_fit_takes_few_tasks(spark):
    df = spark.range(1000).repartition(50)
    few = selection._in_few_tasks(df, 1000)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and few.count() == 1000
    assert selection._in_few_tasks(df, 40 * selection.TASK_ROWS).rdd.getNumPartitions() == 40


def test_both_alignments_read_one_set_of_pairs(spark, tmp_path, monkeypatch):
    from pairlab.catalog import explain_q
    d, made = documents(spark, tmp_path), []
    monkeypatch.setattr(explain_q, "prepared", lambda *a, _of=explain_q.prepared, **k: made.append(a) or _of(*a, **k))
    counts = explain_q.g6_aligned_silver_counts(spark, d)
    assert set(counts.columns) == {"tipo", "n", "mode"} and len(made) == 1
