"""Evaluation statistics (E0, D4-D15, D30) as DataFrame jobs.

Global ranks and cumulative counts use ``score_cdf``: scores are first reduced
to one row per distinct value (partial aggregation, skew-safe), those rows are
cut into range buckets by approximate quantiles (bounded sketch), as many as the
distinct scores need, and prefix sums run per bucket plus a broadcast table of
bucket offsets. No step puts all rows into one task, nor more distinct scores
than a bucket holds.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct scores a range bucket, about, and buckets at most (their totals are broadcast).
BUCKET_SCORES, MOST_BUCKETS = 50_000, 8192
QUANT_DIGITS = 9   # thresholds and scores compared after rounding (engine-independent)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def score_counts(df: DataFrame, score: str, label: str | None = None) -> DataFrame:
    """One row per distinct non-null score (as ``_s``): cnt, pos. Partial
    aggregation makes a hot score value cost one row, not a hot task.
    Persisted: the boundary sketch, the CDF and threshold tables all read it."""
    pos_expr = F.sum(F.col(label).cast("long")) if label else F.lit(0).cast("long")
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("_s"))
            .agg(F.count(F.lit(1)).alias("cnt"), pos_expr.alias("pos"))
            .persist(StorageLevel.MEMORY_AND_DISK))


def score_cdf(df: DataFrame, score: str, label: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """One row per distinct non-null ``score``: cnt, pos, cnt_below, pos_below,
    n_total, pos_total (pos columns only count ``label == 1``)."""
    return cdf_from_counts(score_counts(df, score, label), score, n_buckets)


def range_buckets(dist: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """``dist`` with ``_rb``, the number of its score's value range; the ranges
    come from a bounded quantile sketch, their number from the distinct scores."""
    if n_buckets is None:   # the count also fills the cache of ``dist``
        n_buckets = min(MOST_BUCKETS, -(-dist.count() // BUCKET_SCORES))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = dist.agg(F.percentile_approx("_s", probs, 4 * n_buckets).alias("b")).first() if probs else None
    bounds = list(row["b"] or []) if row is not None else []
    inner = sorted(set(b for b in bounds if b == b and abs(b) != float("inf")))
    if not inner:   # an empty input, or one bucket
        return dist.withColumn("_rb", F.lit(0.0))
    return Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_s", outputCol="_rb",
                      handleInvalid="keep").transform(dist)


def cdf_from_counts(dist: DataFrame, score: str, n_buckets: int | None = None) -> DataFrame:
    """Exclusive prefix sums over the distinct-score table ``dist`` (``_s``, cnt,
    pos): value ranges, their totals (<= MOST_BUCKETS rows) broadcast as
    offsets, a running sum inside each range."""
    b = range_buckets(dist, n_buckets)
    tot = b.groupBy("_rb").agg(F.sum("cnt").alias("_bc"), F.sum("pos").alias("_bp"))
    w_prev = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)   # <= n_buckets rows
    w_all = Window.partitionBy()
    off = tot.select("_rb",
                     F.coalesce(F.sum("_bc").over(w_prev), F.lit(0)).alias("_oc"),
                     F.coalesce(F.sum("_bp").over(w_prev), F.lit(0)).alias("_op"),
                     F.sum("_bc").over(w_all).alias("n_total"),
                     F.sum("_bp").over(w_all).alias("pos_total"))
    w_in = Window.partitionBy("_rb").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return (b.join(F.broadcast(off), "_rb")
            .select(F.col("_s").alias(score), "cnt", "pos",
                    (F.col("_oc") + F.coalesce(F.sum("cnt").over(w_in), F.lit(0))).alias("cnt_below"),
                    (F.col("_op") + F.coalesce(F.sum("pos").over(w_in), F.lit(0))).alias("pos_below"),
                    "n_total", "pos_total"))


def average_ranks(df: DataFrame, col: str, rank_col: str) -> DataFrame:
    """Average (tie-aware, 1-based) rank of every distinct value of ``col``."""
    c = score_cdf(df, col)
    return c.select(col, (F.col("cnt_below") + (F.col("cnt") + 1) / 2.0).alias(rank_col))


def confusion(df: DataFrame, label: str, pred: str, by: list[str] = ()) -> DataFrame:
    """TN, FP, FN, TP in one pass."""
    y, p = F.col(label), F.col(pred)
    cnt = lambda cond: F.count_if(cond).cast("long")
    aggs = [cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
            cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def safe_div(a, b) -> Column:
    """0/0 (and x/0) = 0, the library-wide convention for rates."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def f1_of(p, r) -> Column:
    return safe_div(F.lit(2.0) * _c(p) * _c(r), _c(p) + _c(r))


def rates(conf: DataFrame) -> DataFrame:
    """D5 + D7: precision, recall, F1, accuracy, FPR, FNR and the dominant error."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    fpr, fnr = safe_div(fp, fp + tn), safe_div(fn, fn + tp)
    dominant = (F.when(fp > fn, F.lit("false positives")).when(fn > fp, F.lit("false negatives"))
                .otherwise(F.lit("balanced")))
    return conf.select("*", precision.alias("precision"), recall.alias("recall"),
                       f1_of(precision, recall).alias("f1"),
                       safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                       fpr.alias("fpr"), fnr.alias("fnr"), dominant.alias("dominant_error"))


def classification_report(conf: DataFrame, names: tuple[str, str] = ("simple", "complex")) -> DataFrame:
    """Per class P/R/F1/support, macro and weighted averages, accuracy (long form)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    p0, r0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    n = s0 + s1
    f0, f1 = f1_of(p0, r0), f1_of(p1, r1)
    acc = safe_div(tp + tn, n)

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("row"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("double").alias("support"))

    rows = F.array(
        row(names[0], p0, r0, f0, s0), row(names[1], p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", safe_div(p0 * s0 + p1 * s1, n), safe_div(r0 * s0 + r1 * s1, n),
            safe_div(f0 * s0 + f1 * s1, n), n),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n))
    return conf.select(F.inline(rows))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC-AUC with ties (= Mann-Whitney U with average ranks)."""
    c = score_cdf(df, score, label)
    neg, neg_below = F.col("cnt") - F.col("pos"), F.col("cnt_below") - F.col("pos_below")
    num = F.sum(F.col("pos") * (neg_below + 0.5 * neg))
    p, n = F.first("pos_total"), F.first("n_total") - F.first("pos_total")
    return c.agg(F.when(p * n > 0, num / (p * n)).alias("auc"))   # one class or no rows: undefined


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation = Pearson correlation of average ranks, over
    distinct (x, y) with their counts: a value that many rows share meets its
    rank once for each partner value. Undefined without spread in x or y."""
    d = (df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
         .persist(StorageLevel.MEMORY_AND_DISK))   # two rank tables and the pairing read it
    rx = average_ranks(d, "_x", "_rx")
    ry = average_ranks(d, "_y", "_ry")
    mean = (d.count() + 1) / 2   # of ranks, ties included
    dx, dy = F.col("_rx") - F.lit(mean), F.col("_ry") - F.lit(mean)
    pairs = d.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n")).join(rx, "_x").join(ry, "_y")
    return pairs.agg(F.try_divide(F.sum(F.col("_n") * dx * dy), F.sqrt(
        F.sum(F.col("_n") * dx * dx)) * F.sqrt(F.sum(F.col("_n") * dy * dy))).alias("spearman"))


def regression_errors(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MAE and RMSE."""
    e = F.col(pred) - F.col(y)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


BIN_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def binned_errors(df: DataFrame, y: str, pred: str, edges=BIN_EDGES) -> DataFrame:
    """Right-closed bins of the true score, count and RMSE of the observed bins."""
    s = F.col(y)
    bin_ = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = (s > lo) & (s <= hi)
        lab = F.lit(f"({lo}, {hi}]")
        bin_ = F.when(cond, lab) if bin_ is None else bin_.when(cond, lab)
    e = F.col(pred) - s
    return (df.withColumn("bin", bin_).where(F.col("bin").isNotNull())
            .groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")))


def linspace(a: float, b: float, n: int) -> list[float]:
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, distributed."""
    return quantiles_from_counts(score_counts(df, col), probs)


def quantiles_from_counts(dist: DataFrame, probs: list[float]) -> DataFrame:
    """Order statistics floor/ceil((n-1)q) of the distinct-score table ``dist``
    (``_s``, cnt). The totals of the value ranges (<= MOST_BUCKETS numbers) say
    in which range, and at which place of it, each statistic lies; the ranges
    asked for meet their statistics by an equi-join on the range number, and
    only those ranges are sorted."""
    b = range_buckets(dist)
    ends, n = {}, 0
    for r in b.groupBy("_rb").agg(F.sum("cnt").alias("n")).orderBy("_rb").collect():   # bounded
        ends[r["_rb"]] = (n, n := n + r["n"])
    wanted: dict[float, list[tuple]] = {}
    for j, q in enumerate(probs if n else ()):
        lo = int((n - 1) * q // 1)
        for high, k in enumerate((lo, min(lo + 1, n - 1))):
            bucket = next(x for x, (first, end) in ends.items() if first <= k < end)
            wanted.setdefault(bucket, []).append((j, float(q), high, k - ends[bucket][0], (n - 1) * q - lo))
    places = b.sparkSession.createDataFrame(
        list(wanted.items()), "_rb double, _p array<struct<j: long, q: double, high: int, k: long, frac: double>>")
    below = F.coalesce(F.sum("cnt").over(
        Window.partitionBy("_rb").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = b.join(F.broadcast(places.select("_rb")), "_rb").select("_rb", "_s", "cnt", below.alias("_below"))
    found = ranks.join(F.broadcast(places), "_rb").select("_s", F.inline(F.filter(
        "_p", lambda p: (p["k"] >= F.col("_below")) & (p["k"] < F.col("_below") + F.col("cnt")))))
    v_lo, v_hi = (F.max(F.when(F.col("high") == x, F.col("_s"))) for x in (0, 1))
    return found.groupBy("j", "q").agg((v_lo + F.first("frac") * (v_hi - v_lo)).alias("value"))


CRITERIA = ("f1", "balanced_acc", "youden")


def threshold_table(df: DataFrame, score: str, label: str, candidates: list[float]) -> DataFrame:
    """Counts for every candidate threshold t (prediction = score > t) from the rows."""
    return threshold_table_from_counts(score_counts(df, score, label), candidates)


def threshold_table_from_counts(dist: DataFrame, candidates: list[float]) -> DataFrame:
    """Counts for every candidate threshold t (prediction = score > t) in one pass
    over the distinct-score table (``_s``, cnt, pos).

    Each score is bucketed by b = number of candidates strictly below it (a JVM
    array filter over <= 91 literals); the <= m+1 bucket rows are joined onto
    the complete bucket index 0..m and a reverse cumulative sum gives, for
    candidate j, the rows with b >= j+1, i.e. score > t_j."""
    cands = sorted(set(round(c, QUANT_DIGITS) for c in candidates))
    m = len(cands)
    arr = F.array(*[F.lit(float(c)) for c in cands])
    s = F.round(F.col("_s"), QUANT_DIGITS)
    b = F.size(F.filter(arr, lambda t: t < s))
    per = dist.groupBy(b.alias("j")).agg(F.sum("cnt").alias("cnt"), F.sum("pos").alias("pos"))
    spark = dist.sparkSession
    idx = spark.createDataFrame([(j, float(cands[j]) if j < m else None) for j in range(m + 1)],
                                "j int, thr double")
    full = idx.join(F.broadcast(per), "j", "left").select(
        "j", "thr", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("pos", F.lit(0)).alias("pos"))
    w_after = Window.orderBy("j").rowsBetween(1, Window.unboundedFollowing)   # <= m+1 rows
    w_all = Window.partitionBy()
    t = full.select("j", "thr",
                    F.coalesce(F.sum("cnt").over(w_after), F.lit(0)).alias("pp"),
                    F.coalesce(F.sum("pos").over(w_after), F.lit(0)).alias("tp"),
                    F.sum("cnt").over(w_all).alias("n"), F.sum("pos").over(w_all).alias("p"))
    return t.where(F.col("j") < m).select(
        "j", "thr", F.col("tp").cast("long").alias("tp"),
        (F.col("pp") - F.col("tp")).cast("long").alias("fp"),
        (F.col("p") - F.col("tp")).cast("long").alias("fn"),
        (F.col("n") - F.col("p") - F.col("pp") + F.col("tp")).cast("long").alias("tn"))


def objective(criterion: str) -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    r1, r0 = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    if criterion == "f1":
        return f1_of(safe_div(tp, tp + fp), r1)
    if criterion == "balanced_acc":
        return 0.5 * (r1 + r0)
    if criterion == "youden":
        return r1 + r0 - 1
    raise ValueError(f"unknown criterion {criterion!r}")


def calibrate_threshold(df: DataFrame, score: str, label: str, lo: float = 0.1, hi: float = 0.9,
                        n: int = 81, criterion: str = "f1") -> DataFrame:
    """Best candidate among quantiles linspace(lo, hi, n); strict >, the
    lowest threshold wins ties. Returns thr, objective."""
    obj = objective(criterion)   # validates the criterion before any job runs
    dist = score_counts(df, score, label)          # the only pass over the rows
    qs = quantiles_from_counts(dist, linspace(lo, hi, n))
    cands = [r["value"] for r in qs.select("value").collect()]   # n numbers
    t = threshold_table_from_counts(dist, cands)
    return (t.select("thr", obj.alias("objective"))
            .orderBy(F.desc("objective"), F.asc("thr")).limit(1))


def binary_view(df: DataFrame, score: str, label: str, thr: float) -> DataFrame:
    """AUC and the rates at a given threshold, in one aggregation over the
    score CDF (one row per distinct score)."""
    t = round(thr, QUANT_DIGITS)
    c = score_cdf(df, score, label)
    above = F.round(F.col(score), QUANT_DIGITS) > F.lit(t)
    neg, neg_below = F.col("cnt") - F.col("pos"), F.col("cnt_below") - F.col("pos_below")
    a = c.agg(F.sum(F.col("pos") * (neg_below + 0.5 * neg)).alias("_u"),
              F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
              F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
              F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
              F.sum(F.when(above, 0).otherwise(neg)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return a.select(safe_div("_u", (tp + fn) * (fp + tn)).alias("auc"), f1_of(prec, rec).alias("f1"),
                    prec.alias("precision"), rec.alias("recall"),
                    safe_div(tp + tn, tp + tn + fp + fn).alias("acc"), F.lit(float(t)).alias("thr"))


def best_of_grid(results: DataFrame, metric: str, order_col: str = "grid_pos") -> DataFrame:
    """Winner of a parameter grid: highest metric, first grid position on ties."""
    return results.orderBy(F.desc(metric), F.asc(order_col)).limit(1)
