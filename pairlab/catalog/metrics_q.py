"""Queries of the evaluation-statistics family."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.catalog.registry import register
from pairlab.operators import metrics as M
from pairlab.oracle.fixtures_sql import with_fixtures
from pairlab.oracle.sqlfn import f1, qlist, sdiv
from pairlab.sources import fixtures

FIXED_THR = 0.2


def _scored(spark, sf_dir, split=None):
    """The scored-sentence input (of one split). It has eleven rows a sentence and is
    not kept: each query reads it once, and the operators keep what they reduce it to."""
    return fixtures.scored(spark, sf_dir, split)


def _pred_col():
    return (F.col("pred") > F.lit(FIXED_THR)).cast("int").alias("p")


_CONF_SQL = """conf AS (SELECT split,
  CAST(count(*) FILTER (WHERE label = 0 AND NOT pred > 0.2::DOUBLE) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE label = 0 AND pred > 0.2::DOUBLE) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND NOT pred > 0.2::DOUBLE) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE label = 1 AND pred > 0.2::DOUBLE) AS BIGINT) AS tp
  FROM scored WHERE pred IS NOT NULL GROUP BY split)"""


@register("d4_confusion_matrix", with_fixtures(["scored"], "SELECT * FROM conf", [_CONF_SQL]))
def d4_confusion_matrix(spark, sf_dir):
    """TN/FP/FN/TP per split at threshold 0.2."""
    s = _scored(spark, sf_dir).where(F.col("pred").isNotNull()).withColumn("p", _pred_col())
    return M.confusion(s, "label", "p", by=["split"])


_P, _R = sdiv("tp", "tp + fp"), sdiv("tp", "tp + fn")


@register("d5_d7_rates", with_fixtures(["scored"], f"""
SELECT split, tn, fp, fn, tp, round({_P}, 6) AS precision, round({_R}, 6) AS recall,
  round({f1(_P, _R)}, 6) AS f1, round({sdiv('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
  round({sdiv('fp', 'fp + tn')}, 6) AS fpr, round({sdiv('fn', 'fn + tp')}, 6) AS fnr,
  CASE WHEN fp > fn THEN 'false positives' WHEN fn > fp THEN 'false negatives' ELSE 'balanced' END AS dominant_error
FROM conf""", [_CONF_SQL]))
def d5_d7_rates(spark, sf_dir):
    """D5 + D7: precision/recall/F1/accuracy (0/0 = 0), FPR/FNR, dominant error."""
    s = _scored(spark, sf_dir).where(F.col("pred").isNotNull()).withColumn("p", _pred_col())
    return M.rates(M.confusion(s, "label", "p", by=["split"]))


def _report_sql() -> str:
    p1, r1 = sdiv("tp", "tp + fp"), sdiv("tp", "tp + fn")
    p0, r0 = sdiv("tn", "tn + fn"), sdiv("tn", "tn + fp")
    s1, s0 = "CAST(tp + fn AS DOUBLE)", "CAST(tn + fp AS DOUBLE)"
    n = f"({s0} + {s1})"
    f0, f1_ = f1(p0, r0), f1(p1, r1)
    rows = [
        ("simple", p0, r0, f0, s0), ("complex", p1, r1, f1_, s1),
        ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1_}) / 2", n),
        ("weighted avg", sdiv(f"{p0} * {s0} + {p1} * {s1}", n), sdiv(f"{r0} * {s0} + {r1} * {s1}", n),
         sdiv(f"{f0} * {s0} + {f1_} * {s1}", n), n),
        ("accuracy", "NULL::DOUBLE", "NULL::DOUBLE", sdiv("tp + tn", n), n),
    ]
    sel = [f"SELECT '{lab}' AS row, round({p}, 6) AS precision, round({r}, 6) AS recall, "
           f"round({f}, 6) AS f1, round({s}, 6) AS support FROM conf WHERE split = 'test'"
           for lab, p, r, f, s in rows]
    return with_fixtures(["scored"], "\nUNION ALL\n".join(sel), [_CONF_SQL])


@register("d6_classification_report", _report_sql())
def d6_classification_report(spark, sf_dir):
    """Per-class P/R/F1/support + macro, weighted, accuracy on the test split."""
    s = (_scored(spark, sf_dir, "test").where(F.col("pred").isNotNull())
         .withColumn("p", _pred_col()))
    return M.classification_report(M.confusion(s, "label", "p"))


_AUC_SQL = """, r AS (SELECT label, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rk
  FROM scored WHERE {c} IS NOT NULL),
t AS (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n,
  sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r)"""


@register("d8_roc_auc", with_fixtures(["scored"], """
SELECT round((rs - p * (p + 1) / 2) / (p * n), 6) AS auc FROM t""",
    [_AUC_SQL.format(c="pred").lstrip(", ")]))
def d8_roc_auc(spark, sf_dir):
    """Exact ROC-AUC with ties of the long-word share against the complex label."""
    return M.roc_auc(_scored(spark, sf_dir), "pred", "label")


@register("e0_average_ranks", with_fixtures(["scored"], """
SELECT pred, CAST(min(rk) AS DOUBLE) AS avg_rank FROM (
  SELECT pred, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS rk
  FROM scored WHERE pred IS NOT NULL) GROUP BY pred"""))
def e0_average_ranks(spark, sf_dir):
    """Average rank of every distinct predictor value (range-bucketed prefix sums)."""
    return M.average_ranks(_scored(spark, sf_dir), "pred", "avg_rank")


@register("d9_spearman", with_fixtures(["scored"], """
SELECT round(corr(ry, rp), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry,
         rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS rp
  FROM scored WHERE y IS NOT NULL AND pred IS NOT NULL)"""))
def d9_spearman(spark, sf_dir):
    """Spearman correlation between true complexity and the predictor."""
    return M.spearman(_scored(spark, sf_dir), "y", "pred")


@register("d10_mae_rmse", with_fixtures(["scored"], """
SELECT split, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse
FROM scored GROUP BY split"""))
def d10_mae_rmse(spark, sf_dir):
    """MAE and RMSE per split."""
    s = _scored(spark, sf_dir)
    e = F.col("pred") - F.col("y")
    return s.groupBy("split").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def _bins_sql() -> str:
    cases = " ".join(f"WHEN y > {lo}::DOUBLE AND y <= {hi}::DOUBLE THEN '({lo}, {hi}]'"
                     for lo, hi in zip(M.BIN_EDGES[:-1], M.BIN_EDGES[1:]))
    return with_fixtures(["scored"], f"""
SELECT bin, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse
FROM (SELECT *, CASE {cases} END AS bin FROM scored) WHERE bin IS NOT NULL GROUP BY bin""")


@register("d11_binned_errors", _bins_sql())
def d11_binned_errors(spark, sf_dir):
    """Count and RMSE per right-closed score bin (observed bins only)."""
    return M.binned_errors(_scored(spark, sf_dir), "y", "pred")


_Q81 = M.linspace(0.1, 0.9, 81)


@register("d12_quantiles", with_fixtures(["scored"], f"""
SELECT CAST(unnest(range(0, 81)) AS BIGINT) AS j, unnest({qlist(_Q81)}) AS q,
       unnest(list_transform(vs, lambda v: round(v, 6))) AS value FROM qq""",
    [f"qq AS (SELECT quantile_cont(pred, {qlist(_Q81)}) AS vs FROM scored WHERE split = 'val' AND pred IS NOT NULL)"]))
def d12_quantiles(spark, sf_dir):
    """Exact interpolated quantiles at linspace(.1, .9, 81) on the val split."""
    return M.exact_quantiles(_scored(spark, sf_dir, "val"), "pred", _Q81)


def _calib_sql(split: str, lo: float, hi: float, n: int, criterion: str) -> str:
    qs = M.linspace(lo, hi, n)
    tp, fp, fn, tn = "tp", "fp", "fn", "tn"
    r1, r0 = sdiv(tp, f"{tp} + {fn}"), sdiv(tn, f"{tn} + {fp}")
    obj = {"f1": f1(sdiv(tp, f"{tp} + {fp}"), r1), "balanced_acc": f"0.5::DOUBLE * ({r1} + {r0})",
           "youden": f"{r1} + {r0} - 1"}[criterion]
    return f"""cands AS (SELECT DISTINCT round(unnest(quantile_cont(pred, {qlist(qs)})), 9) AS thr
  FROM scored WHERE split = '{split}' AND pred IS NOT NULL),
ev AS (SELECT thr,
  count(*) FILTER (WHERE label = 1 AND round(pred, 9) > thr) AS tp,
  count(*) FILTER (WHERE label = 0 AND round(pred, 9) > thr) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT round(pred, 9) > thr) AS fn,
  count(*) FILTER (WHERE label = 0 AND NOT round(pred, 9) > thr) AS tn
  FROM cands, (SELECT * FROM scored WHERE split = '{split}' AND pred IS NOT NULL) s GROUP BY thr),
best AS (SELECT thr, {obj} AS objective FROM ev ORDER BY objective DESC, thr ASC LIMIT 1)"""


@register("d13_threshold_calibration", with_fixtures(
    ["scored"], "SELECT round(thr, 6) AS thr, round(objective, 6) AS objective FROM best",
    [_calib_sql("val", 0.1, 0.9, 81, "f1")]))
def d13_threshold_calibration(spark, sf_dir):
    """D13 + C11: threshold maximising F1 among 81 quantile candidates (val split); the
    candidates x rows theta join runs in its histogram form."""
    val = _scored(spark, sf_dir, "val")
    return M.calibrate_threshold(val, "pred", "label")


def _binview_sql() -> str:
    p, r = sdiv("tp", "tp + fp"), sdiv("tp", "tp + fn")
    return with_fixtures(["scored"], f"""
SELECT round(auc, 6) AS auc, round({f1(p, r)}, 6) AS f1, round({p}, 6) AS precision, round({r}, 6) AS recall,
  round({sdiv('tp + tn', 'tp + tn + fp + fn')}, 6) AS acc, round(thr, 6) AS thr FROM (
  SELECT (SELECT thr FROM best) AS thr, (SELECT (rs - p * (p + 1) / 2) / (p * n) FROM t) AS auc,
    count(*) FILTER (WHERE label = 1 AND round(pred, 9) > (SELECT thr FROM best)) AS tp,
    count(*) FILTER (WHERE label = 0 AND round(pred, 9) > (SELECT thr FROM best)) AS fp,
    count(*) FILTER (WHERE label = 1 AND NOT round(pred, 9) > (SELECT thr FROM best)) AS fn,
    count(*) FILTER (WHERE label = 0 AND NOT round(pred, 9) > (SELECT thr FROM best)) AS tn
  FROM scored WHERE split = 'test' AND pred IS NOT NULL)""",
        [_calib_sql("val", 0.1, 0.9, 81, "f1"),
         "r AS (SELECT label, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS rk "
         "FROM scored WHERE split = 'test' AND pred IS NOT NULL)",
         "t AS (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n, "
         "sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r)"])


@register("d14_binary_view", _binview_sql())
def d14_binary_view(spark, sf_dir):
    """Calibrate the threshold on val, apply it unchanged on test."""
    s = _scored(spark, sf_dir).select("label", "pred", "split").cache()   # both splits are read
    thr = M.calibrate_threshold(s.where(F.col("split") == "val"), "pred", "label").first()["thr"]
    return M.binary_view(s.where(F.col("split") == "test"), "pred", "label", thr)


for _crit in ("balanced_acc", "youden"):
    def _mk(crit):
        @register(f"d15_threshold_{crit}", with_fixtures(
            ["scored"], f"SELECT '{crit}' AS criterion, round(thr, 6) AS thr, round(objective, 6) AS objective FROM best",
            [_calib_sql("val", 0.05, 0.95, 91, crit)]))
        def q(spark, sf_dir):
            """Alternative calibration criterion over 91 candidates in [.05, .95]."""
            val = _scored(spark, sf_dir, "val")
            return M.calibrate_threshold(val, "pred", "label", 0.05, 0.95, 91, crit).select(
                F.lit(crit).alias("criterion"), "thr", "objective")
        return q
    _mk(_crit)


_GRID = (0.1, 0.15, 0.2, 0.25, 0.3)


@register("d30_grid_winner", with_fixtures(["scored"], """
SELECT CAST(grid_pos AS BIGINT) AS grid_pos, round(thr, 6) AS thr, round(acc, 6) AS acc
FROM ev ORDER BY acc DESC, grid_pos ASC LIMIT 1""", [
    f"g AS (SELECT unnest(range(0, {len(_GRID)})) AS grid_pos, unnest({qlist(_GRID)}) AS thr)",
    """ev AS (SELECT grid_pos, thr, avg(CASE WHEN (pred > thr) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
  FROM g, scored WHERE split = 'val' AND pred IS NOT NULL GROUP BY grid_pos, thr)"""]))
def d30_grid_winner(spark, sf_dir):
    """Grid winner (accuracy of fixed thresholds on val), first grid position on ties."""
    val = _scored(spark, sf_dir, "val").where(F.col("pred").isNotNull())
    aggs = [F.avg(((F.col("pred") > F.lit(t)) == (F.col("label") == 1)).cast("double")).alias(f"a{i}")
            for i, t in enumerate(_GRID)]
    wide = val.agg(*aggs)
    stacked = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("grid_pos"), F.lit(float(t)).alias("thr"), F.col(f"a{i}").alias("acc"))
        for i, t in enumerate(_GRID)])))
    return M.best_of_grid(stacked, "acc")
