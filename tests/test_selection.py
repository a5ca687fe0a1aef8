"""Model selection by group folds, the greedy split, checks that raise."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pairlab.operators import explain as X
from pairlab.operators import inference as I
from pairlab.operators import sampling
from pairlab.operators import selection as SEL
from pairlab.sources import io as IO
from pairlab.sources import tables

FEATURES = ["a", "b", "c"]
GRID = (0.01, 1.0, 100.0)


def greedy(sizes, k):
    loads, folds = [0] * k, []
    for s in sizes:
        f = min(range(k), key=lambda x: (loads[x], x))
        loads[f] += s
        folds.append(f)
    return folds


def test_dealing_phases_equal_the_greedy_rule():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.randint(1, 6)
        runs = sorted(((s, rng.randint(1, 40)) for s in rng.sample(range(1, 60), rng.randint(1, 6))), reverse=True)
        got = []
        phases = sampling.dealing_phases(runs, k)
        for size, groups in runs:
            for rank in range(groups):
                own = [p for p in phases if p[0] == size and p[1] <= rank < p[2]]
                assert len(own) == 1
                got.append(own[0][3][(rank - own[0][1]) % len(own[0][3])])
        assert got == greedy([s for s, m in runs for _ in range(m)], k)
        assert len(phases) <= k * len(runs)


def test_group_kfold_balances_and_keeps_groups(spark):
    rng = random.Random(2)
    sizes = [rng.choice((1, 1, 1, 2, 3, 50)) for _ in range(300)] + [400]
    rows = [(g,) for g, s in enumerate(sizes) for _ in range(s)]
    got = {r["g"]: r["fold"] for r in sampling.group_kfold(spark.createDataFrame(rows, "g long"), "g").collect()}
    assert len(got) == len(sizes)
    loads = [sum(s for g, s in enumerate(sizes) if got[g] == f) for f in range(5)]
    want = [0] * 5
    for s, f in zip(sorted(sizes, reverse=True), greedy(sorted(sizes, reverse=True), 5)):
        want[f] += s
    assert loads == want


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = x @ [1.0, -0.2, 3.0] + 2 + rng.normal(size=400) * 0.3
    x[rng.random(x.shape) < 0.1] = np.nan
    folds = rng.integers(0, 5, 400)
    label = (y > 2).astype(int)
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t), int(l), int(f)) for r, t, l, f in zip(x, y, label, folds)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, label int, fold int"), x, y, label, folds


def prepared(x, train):
    med = np.nanmedian(x[train], 0)
    z = np.where(np.isnan(x), med, x)
    return (z - z[train].mean(0)) / z[train].std(0)


def test_svr_grid_equals_numpy(table):
    df, x, y, _, folds = table
    want = []
    for c in GRID:
        errors = []
        for f in range(5):
            train = folds != f
            z = np.hstack([prepared(x, train), np.ones((len(x), 1))])  # the intercept is a weight like the others
            w = np.linalg.solve(z[train].T @ z[train] + np.eye(4) / (2 * c), z[train].T @ y[train])
            errors.append(np.sqrt(np.mean((z[~train] @ w - y[~train]) ** 2)))
        want.append(np.mean(errors))
    got = SEL.svr_grid(df, FEATURES, "y", "fold", GRID).orderBy("grid_pos").collect()
    assert np.allclose([r["rmse"] for r in got], want, rtol=1e-9, atol=1e-9)


def test_logistic_selection_and_stored_model(spark, table):
    df, x, _, label, folds = table
    model, best, means = SEL.select_logistic(df, FEATURES, "label", "fold", GRID)
    assert best == GRID[int(np.argmax(means))] and all(0.6 < m <= 1 for m in means)
    everything = np.ones(len(x), bool)
    z = prepared(x, everything)
    w, b = np.array(model.stages[-1].coefficients), model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(z @ w + b)))
    # stationary point of C sum(loss) + |w|^2 / 2, the intercept free
    assert np.allclose(best * z.T @ (p - label) + w, 0, atol=0.05 * max(1, best)) and abs((p - label).sum()) < 0.5
    path = IO.scratch_path(spark, "model-test")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(df).select("probability").collect()
    assert again == model.transform(df).select("probability").collect()
    assert np.allclose([r[0][1] for r in again], p, atol=1e-9)


def evaluated(spark):
    ev = spark.createDataFrame([(1, ["a", "b"], [0, 1]), (2, ["c"], [1])], "idx long, tokens array<string>, silver array<int>")
    return ev, lambda *rows: spark.createDataFrame(list(rows), "idx long, method string, pred array<int>")


def test_strict_alignment_raises(spark):
    ev, preds = evaluated(spark)
    good = [(1, "m", [0, 1]), (2, "m", [1])]
    assert X.checked_predictions(ev, preds(*good)).count() == 2
    for bad in ([(1, "m", [0]), good[1]], good[:1], [*good, (3, "m", [1])], [(1, "m", None), good[1]]):
        with pytest.raises(PySparkException, match="do not match"):
            X.checked_predictions(ev, preds(*bad)).collect()
        assert X.checked_predictions(ev, preds(*bad), strict=False).count() == sum(r in good for r in bad)


def test_disagreement_needs_two_methods(spark):
    ev, preds = evaluated(spark)
    one = [(1, "m", [0, 1]), (2, "m", [1])]
    assert X.disagreement(ev, preds(*one, (1, "n", [1, 1]), (2, "n", [1]))).count() == 2
    with pytest.raises(PySparkException, match="two methods"):
        X.disagreement(ev, preds(*one)).collect()


def test_restore_order_checks_the_count(spark):
    inputs = spark.createDataFrame([(2,), (1,)], "id long")
    out = lambda *rows: spark.createDataFrame(list(rows), "id long, response string")
    assert [tuple(r) for r in I.restore_order(inputs, out((1, "x"), (2, None))).collect()] == [(1, "x"), (2, None)]
    for bad in ([(1, "x")], [(1, "x"), (2, "y"), (2, "z")], [(1, "x"), (2, "y"), (3, "z")]):
        with pytest.raises(PySparkException, match="do not match"):
            I.restore_order(inputs, out(*bad)).collect()
    assert I.restore_order(inputs, out((1, "x")), strict=False).count() == 2


def test_domain_source_lists_one_folder(spark):
    path = IO.scratch_path(spark, "domains-test")
    tables.write_domains(spark.createDataFrame([(k, "ab"[k % 2], k * 2) for k in range(10)], "k long, d string, v long"), path, "d")
    df = tables.load_domain(spark, path, "a", ["k"])
    assert sorted(r["k"] for r in df.collect()) == [0, 2, 4, 6, 8]
    assert len(df.inputFiles()) and all("domain=a" in f or "domain=b" in f for f in df.inputFiles())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan and "ReadSchema: struct<k:bigint>" in plan
