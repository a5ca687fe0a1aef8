"""E1, E2, E7 and E8 pick rows by their numbers and fetch the texts afterwards."""

import hashlib
import io
from contextlib import redirect_stdout

from pairlab.operators import sampling
from pairlab.operators.gating import gating_inputs
from pairlab.plans.prepare import prepare_sentences

ID = "original_sentence_idx"
PAIR = f"{ID} long, idx long, original_text string, simplification string, original_all double, simplification_all double"


def _key(x, seed="42"):
    return int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:15], 16), x


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _pairs(spark, hot=300):
    """An id with a third of all rows, ids of two rows, equal scores, an id without gain, an empty text."""
    rows = [(7, i, "uno due", f"s{i}", 0.9, 0.2 if i % 3 == 0 else 0.5) for i in range(hot)]
    rows += [(1000 + i // 2, hot + i, f"o{i // 2}", f"t{i}", 0.8, 0.1) for i in range(2 * hot)]
    rows += [(8, 5000, "o", "s", 0.5, 0.5), (9, 5001, "o", "", 0.9, 0.1), (10, 5002, None, "s", None, 0.1)]
    return spark.createDataFrame(rows, PAIR), rows


def test_first_and_one_random_row(spark):
    df = spark.createDataFrame([(g, k, f"{g}:{k}") for g in (1, 2, None) for k in (5, 3, 9, 4)] + [(3, None, "x")],
                               "g long, k long, t string")
    first = sampling.first_per_group(df, "g", "k")
    assert {tuple(r) for r in first.collect()} == {(1, 3, "1:3"), (2, 3, "2:3"), (None, 3, "None:3")}
    one = sampling.cap_per_group(df.where("k IS NOT NULL"), "g", "k", 1)
    best = min((5, 3, 9, 4), key=_key)
    assert {tuple(r) for r in one.collect()} == {(g, best, f"{g}:{best}") for g in (1, 2, None)}
    for picked in (first, one):
        assert "SortAggregate" not in _plan(picked)
    assert sampling.first_per_group(df.limit(0), "g", "k").count() == 0


def test_random_key_orders_like_the_pair(spark):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 12345, 99]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r["k"] for r in df.orderBy(sampling.random_key("42", "k")).collect()]
    assert got == sorted(keys, key=_key)


def test_prepared_rows_of_a_hot_id(spark):
    p, rows = _pairs(spark)
    by_id = {}
    for r in rows:
        if r[4] is not None and round(r[4] - r[5], 9) > 0.05:
            by_id.setdefault(r[0], []).append(r)
    want = set()
    for g, rs in by_id.items():
        o, s = min(rs, key=lambda r: r[1]), min(rs, key=lambda r: _key(r[1]))
        want |= {(g, True, o[2])} | ({(g, False, s[3])} if s[3] else set())
    for n_sample in (None, 10_000):
        got = prepare_sentences(p, n_sample=n_sample).select(ID, "is_original", "text").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_gating_inputs_of_a_hot_id(spark):
    p, rows = _pairs(spark)
    df = gating_inputs(p)
    assert "SortAggregate" not in _plan(df)
    got = df.collect()
    assert {r[ID] for r in got} == {7, 9} | set(range(1000, 1300))   # 8 has no gain, 10 no score
    hot = [r for r in got if r[ID] == 7]
    assert len(hot) == 300 and {r["gold_text"] for r in hot} == {"s0"}   # of equal scores the first row
    assert sorted(r["input_text"] for r in hot) == sorted(["uno due"] + [f"s{i}" for i in range(1, 300)])
    assert all(r["true_label"] == (r["input_text"] == "uno due" or r["input_score"] == 0.5) for r in hot)
