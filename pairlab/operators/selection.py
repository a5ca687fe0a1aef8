"""Model selection by group folds without leaks.

Every fold's imputing, scaling and fitting see the other folds' rows only. The
rows are read once for all folds: each task adds up, for each fold, the products
of (1, features, label) over the rows outside and inside it, with nulls replaced
by the medians outside. What follows from these small matrices (means, standard
deviations, the squared-loss models for every C and their errors) needs no
further job; the logistic models are fitted by Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators import profile

#: Models of one fold fitted at the same time.
PARALLEL = 4
#: Rows of one task of a fit, about. A fit runs a job an iteration, so small tables take few tasks.
TASK_ROWS = 1_000_000


def _in_few_tasks(df: DataFrame, rows: float) -> DataFrame:
    """All rows in no more partitions than so many of them need and the cluster has cores for."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // TASK_ROWS)))


@dataclass
class FoldSums:
    """medians[f], outside[f], inside[f] of fold f; the last entry is that of
    all rows (nothing inside). The matrices hold the sums of products of
    (1, features less their medians, label)."""
    medians: np.ndarray
    outside: np.ndarray
    inside: np.ndarray


def fold_sums(df: DataFrame, features: list[str], label: str, fold: str, n_folds: int) -> FoldSums:
    """One pass over the rows for the matrices of all folds. The driver gets
    (n_folds + 1) x 2 matrices of (features + 2) squared numbers, whatever the
    number of rows. A feature without any value has median 0; rows whose label
    is null are left out."""
    rows = df.where(F.col(label).isNotNull())
    medians = np.zeros((n_folds + 1, len(features)))
    for f in range(n_folds + 1):
        found = {r["feature"]: r["median"] for r in profile.exact_medians(rows.where(F.col(fold) != f), features).collect()}
        medians[f] = [found.get(x) or 0.0 for x in features]
    width = len(features) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n_folds + 1, 2, width, width))
        for b in batches:
            x, own = b[features].to_numpy(float, na_value=np.nan), b[fold].to_numpy()
            y = b[label].to_numpy(float)[:, None]
            for f in range(n_folds + 1):
                z = np.hstack([np.ones_like(y), np.where(np.isnan(x), 0.0, x - medians[f]), y])
                for held, at in ((0, own != f), (1, own == f)):
                    sums[f, held] += z[at].T @ z[at]
        f, held, i, j = (g.ravel() for g in np.indices(sums.shape))
        yield pd.DataFrame({"f": f, "held": held, "i": i, "j": j, "v": sums.ravel()})

    parts = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label),
                        F.col(fold).cast("int").alias(fold)).mapInPandas(run, "f long, held long, i long, j long, v double")
    total = parts.groupBy("f", "held", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((n_folds + 1, 2, width, width))
    sums[total["f"], total["held"], total["i"], total["j"]] = total["v"]
    return FoldSums(medians, sums[:, 0], sums[:, 1])


def scaling(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population standard deviation) of the features in a matrix of
    sums, less their medians; a constant feature has 1."""
    n = sums[0, 0]
    mean = sums[0, 1:-1] / n
    centred = np.diag(sums)[1:-1] - n * mean ** 2
    centred[centred <= 1e-12 * np.maximum(np.diag(sums)[1:-1], 1e-300)] = 0.0
    sd = np.sqrt(centred / n)
    return mean, np.where(sd == 0, 1.0, sd)


def svr_weights(sums: np.ndarray, c: float) -> np.ndarray:
    """(intercept, weights) on features less their medians, of the squared-loss
    support vector regression on standardised features: 1/2 (|w|^2 + b^2) +
    C sum (y - xw - b)^2, whose intercept is shrunk as well."""
    n, (mean, sd) = sums[0, 0], scaling(sums)
    y = sums[0, -1] / n
    gram = (sums[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    w = np.linalg.solve(gram + np.eye(len(mean)) / (2 * c), (sums[1:-1, -1] - n * mean * y) / sd) / sd
    return np.append(y * 2 * c * n / (1 + 2 * c * n) - w @ mean, w)


def squared_error(sums: np.ndarray, weights: np.ndarray) -> float:
    """Sum of squared errors over the rows of a matrix of sums."""
    v = np.append(-weights, 1.0)
    return float(max(v @ sums @ v, 0.0))


def svr_grid(df: DataFrame, features: list[str], label: str, fold: str, grid: tuple[float, ...],
             n_folds: int = 5) -> DataFrame:
    """H4: grid_pos, C, rmse: the mean over folds of the held-out error of each
    C. Folds without rows do not count."""
    s = fold_sums(df, features, label, fold, n_folds)
    out = []
    for pos, c in enumerate(grid):
        errors = [np.sqrt(squared_error(s.inside[f], svr_weights(s.outside[f], c)) / s.inside[f][0, 0])
                  for f in range(n_folds) if s.inside[f][0, 0] and s.outside[f][0, 0]]
        out.append((pos, float(c), float(np.mean(errors))))
    return df.sparkSession.createDataFrame(out, "grid_pos long, C double, rmse double")


def prepared_by(medians: np.ndarray, sums: np.ndarray, features: list[str]) -> list:
    """Pipeline stages: nulls to medians, standardised, assembled. They hold
    plain numbers, so a fitted pipeline can be written and read."""
    mean, sd = scaling(sums)
    columns = ", ".join(f"(coalesce(cast(`{x}` as double), {m!r}D) - {m + a!r}D) / {s!r}D AS `z_{x}`"
                        for x, m, a, s in zip(features, medians.tolist(), mean.tolist(), sd.tolist()))
    return [SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
            VectorAssembler(inputCols=[f"z_{x}" for x in features], outputCol="features")]


def select_logistic(df: DataFrame, features: list[str], label: str, fold: str, grid: tuple[float, ...],
                    n_folds: int = 5) -> tuple[PipelineModel, float, list[float]]:
    """H5: (model refitted on all rows, its C, mean AUC of each C). The penalty
    1/(C n) takes n from the rows that a model is fitted on; the first of equal
    AUCs wins."""
    s = fold_sums(df, features, label, fold, n_folds)
    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)

    def fitted(rows: DataFrame, sums: np.ndarray, c: float):
        return LogisticRegression(labelCol=label, standardization=False, elasticNetParam=0.0, maxIter=100,
                                  regParam=1.0 / (c * sums[0, 0])).fit(rows)

    scores: list[list[float]] = [[] for _ in grid]
    for f in range(n_folds):
        stages = Pipeline(stages=prepared_by(s.medians[f], s.outside[f], features)).fit(df)
        train = _in_few_tasks(stages.transform(df.where(F.col(fold) != f)).select("features", label), s.outside[f][0, 0]).persist()
        held = _in_few_tasks(stages.transform(df.where(F.col(fold) == f)).select("features", label), s.inside[f][0, 0]).persist()
        with ThreadPool(PARALLEL) as pool:  # the small jobs of several C at once
            found = pool.map(lambda c: judge.evaluate(fitted(train, s.outside[f], c).transform(held)), grid)
        for k, auc in enumerate(found):
            scores[k].append(auc)
        train.unpersist()
        held.unpersist()
    means = [float(np.mean(x)) for x in scores]
    best = max(range(len(grid)), key=lambda k: (means[k], -k))
    stages = Pipeline(stages=prepared_by(s.medians[-1], s.outside[-1], features)).fit(df)
    model = fitted(_in_few_tasks(stages.transform(df), s.outside[-1][0, 0]), s.outside[-1], grid[best])
    return PipelineModel(stages=[*stages.stages, model]), float(grid[best]), means
