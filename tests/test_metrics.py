"""Golden arithmetic from published confusion matrices, and exact ranking
statistics against brute force on tie-rich data."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pairlab.operators import metrics as M


def _conf(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_golden_rates_logistic(spark):
    r = M.rates(_conf(spark, 4743, 2796, 1154, 6385)).first()
    assert round(r["f1"], 4) == 0.7638 and round(r["accuracy"], 3) == 0.738
    assert round(r["precision"], 4) == 0.6955 and round(r["recall"], 4) == 0.8469


def test_golden_report_transformer(spark):
    rep = {x["row"]: x for x in M.classification_report(_conf(spark, 6019, 1520, 625, 6914)).collect()}
    assert round(rep["accuracy"]["f1"], 4) == 0.8577
    assert round(rep["simple"]["precision"], 4) == 0.9059 and round(rep["simple"]["recall"], 4) == 0.7984
    assert round(rep["complex"]["f1"], 4) == 0.8657
    assert round(rep["macro avg"]["f1"], 4) == 0.8572 and rep["macro avg"]["support"] == 15078


def _data(n=400, seed=7):
    rnd = random.Random(seed)
    return [(i, round(rnd.random(), 1), int(rnd.random() < 0.4)) for i in range(n)]


def test_auc_and_ranks_bruteforce(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "id long, s double, y int")
    auc = M.roc_auc(df, "s", "y").first()["auc"]
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12
    ranks = {r["s"]: r["r"] for r in M.average_ranks(df, "s", "r").collect()}
    vals = sorted(s for _, s, _ in rows)
    for v, r in ranks.items():
        idx = [i + 1 for i, x in enumerate(vals) if x == v]
        assert abs(r - sum(idx) / len(idx)) < 1e-12


def test_quantiles_and_threshold_bruteforce(spark):
    rows = _data(300, seed=9)
    df = spark.createDataFrame(rows, "id long, s double, y int")
    probs = M.linspace(0.1, 0.9, 81)
    got = [r["value"] for r in M.exact_quantiles(df, "s", probs).orderBy("j").collect()]
    want = np.quantile(np.array([s for _, s, _ in rows]), probs)
    assert np.allclose(got, want, atol=1e-12)
    best = M.calibrate_threshold(df, "s", "y").first()

    def f1(t):
        tp = sum(1 for _, s, y in rows if s > t and y == 1)
        fp = sum(1 for _, s, y in rows if s > t and y == 0)
        fn = sum(1 for _, s, y in rows if s <= t and y == 1)
        return 0.0 if tp == 0 else 2 * tp / (2 * tp + fp + fn)
    cands = [round(c, 9) for c in want]
    want_t = max(cands, key=f1)
    assert abs(best["thr"] - want_t) < 1e-9


def test_unknown_criterion_raises(spark):
    df = spark.createDataFrame(_data(20), "id long, s double, y int")
    try:
        M.calibrate_threshold(df, "s", "y", criterion="nope")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_spearman_bruteforce(spark):
    rnd = random.Random(11)
    rows = [(round(rnd.random(), 1), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = M.spearman(df, "x", "y").first()["spearman"]

    def avg_ranks(v):
        order = sorted(v)
        return [np.mean([i + 1 for i, o in enumerate(order) if o == x]) for x in v]
    rx, ry = avg_ranks([r[0] for r in rows]), avg_ranks([r[1] for r in rows])
    assert abs(got - np.corrcoef(rx, ry)[0, 1]) < 1e-9
