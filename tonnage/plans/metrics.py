"""Model metrics as aggregates. `by` turns any of them into a segment metric."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.functions.scalar import equal_bins, flag, null_safe_join, safe_ratio
from tonnage.operators.ordered import row_numbers, running
from tonnage.plans.contracts import ALERT_BUDGETS


def _group(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def regression_aggs(y: str, p: str) -> list[Column]:
    error = F.col(y) - F.col(p)
    spread = F.var_pop(y) * F.count(y)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - safe_ratio(F.sum(error * error), spread)).alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _group(df, by, regression_aggs(y, p))


def _pinball(y: str, q: str, alpha: float) -> Column:
    gap = F.col(y) - F.col(q)
    return F.avg(F.greatest(F.lit(alpha) * gap, F.lit(alpha - 1.0) * gap))


def quantile_metrics(df: DataFrame, y: str, p10: str, p50: str, p90: str, by: Sequence[str] = (), nominal: float = 0.8) -> DataFrame:
    covered = F.avg(flag(F.col(y).between(F.col(p10), F.col(p90))))
    return _group(
        df,
        by,
        [
            _pinball(y, p10, 0.1).alias("pinball_p10"),
            _pinball(y, p50, 0.5).alias("pinball_p50"),
            _pinball(y, p90, 0.9).alias("pinball_p90"),
            covered.alias("empirical_coverage_80"),
            F.abs(covered - nominal).alias("coverage_error_abs"),
            F.avg(F.col(p90) - F.col(p10)).alias("mean_interval_width"),
            F.avg(F.abs(F.col(y) - F.col(p50))).alias("p50_mae"),
        ],
    )


def clipped(p: str) -> Column:
    return F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0 - 1e-12))


def confusion_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Prevalence, log-loss, Brier, precision and recall at 0.5, confusion counts: one aggregation."""
    q, actual = clipped(p), F.col(y) == 1
    said = q >= 0.5
    tp, fp = F.count_if(actual & said), F.count_if(~actual & said)
    fn, tn = F.count_if(actual & ~said), F.count_if(~actual & ~said)
    loss = -F.when(actual, F.log(q)).otherwise(F.log(F.lit(1.0) - q))
    return _group(
        df,
        by,
        [
            F.avg(F.col(y).cast("double")).alias("prevalence"),
            F.avg(loss).alias("log_loss"),
            F.avg((q - F.col(y)) * (q - F.col(y))).alias("brier"),
            F.coalesce(safe_ratio(tp, tp + fp), F.lit(0.0)).alias("precision_at_0_5"),
            F.coalesce(safe_ratio(tp, tp + fn), F.lit(0.0)).alias("recall_at_0_5"),
            tn.alias("tn"),
            fp.alias("fp"),
            fn.alias("fn"),
            tp.alias("tp"),
        ],
    )


def _curve(df: DataFrame, y: str, p: str, by: Sequence[str], descending: bool) -> DataFrame:
    """Cumulative positives and rows per distinct score, with the positives and rows of the score itself."""
    scored = df.select(*by, clipped(p).alias("__p"), F.col(y).cast("double").alias("__y"))
    upto = running(scored, by, "__p", {"__cpos": ("sum", "__y"), "__crows": ("sum", F.lit(1.0))}, descending=descending, totals=True, own=True)
    return upto.withColumnsRenamed({"__cpos_own": "__pos", "__crows_own": "__rows"})


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half; null when only one class is present."""
    c = _curve(df, y, p, by, descending=False)
    negatives = F.col("__rows") - F.col("__pos")
    below = F.col("__crows") - F.col("__cpos") - negatives
    wins = F.sum(F.col("__pos") * (below + negatives / 2.0))
    positives = F.max("__cpos_total")
    area = safe_ratio(wins, positives * (F.max("__crows_total") - positives))
    return _group(c, by, [area.alias("roc_auc")])


def pr_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision over descending distinct scores (step-wise, ties grouped)."""
    c = _curve(df, y, p, by, descending=True)
    step = safe_ratio(F.col("__pos"), F.col("__cpos_total")) * safe_ratio("__cpos", "__crows")
    return _group(c, by, [F.sum(step).alias("pr_auc")])


def expected_calibration_error(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    binned = df.select(*by, equal_bins(clipped(p), bins).alias("__bin"), F.col(y).cast("double").alias("__y"), clipped(p).alias("__p"))
    cells = binned.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__sy"), F.sum("__p").alias("__sp"))
    gap = safe_ratio(F.sum(F.abs(F.col("__sy") - F.col("__sp"))), F.sum("__n"))
    return _group(cells, by, [gap.alias(f"ece_{bins}")])


def alert_budget_metrics(df: DataFrame, y: str, p: str, key: str, by: Sequence[str] = (), budgets: Sequence[float] = ALERT_BUDGETS) -> DataFrame:
    """Recall and precision among the ceil(rows x budget) highest scores; equal scores go by key."""
    scored = df.select(*by, key, clipped(p).alias("__p"), F.col(y).cast("double").alias("__y"))
    ranked = row_numbers(scored, by, "__p", key, descending=True, name="__r", total="__n")
    aggs = []
    positives = F.greatest(F.sum("__y"), F.lit(1.0))
    for budget in budgets:
        size = F.greatest(F.ceil(F.col("__n") * F.lit(float(budget))), F.lit(1))
        hits = F.sum(F.when(F.col("__r") <= size, F.col("__y")).otherwise(0.0))
        suffix = f"{round(budget * 100):02d}pct"
        aggs += [(hits / positives).alias(f"recall_at_alert_budget_{suffix}"), safe_ratio(hits, F.max(size)).alias(f"precision_at_alert_budget_{suffix}")]
    return _group(ranked, by, aggs)


def classification_metrics(df: DataFrame, y: str, p: str, key: str, by: Sequence[str] = (), budgets: Sequence[float] = ALERT_BUDGETS) -> DataFrame:
    """Every classification metric, one row per group."""
    keyed, groups = (df, list(by)) if by else (df.withColumn("__all", F.lit(1)), ["__all"])
    out = confusion_metrics(keyed, y, p, groups)
    for part in (
        roc_auc(keyed, y, p, groups),
        pr_auc(keyed, y, p, groups),
        expected_calibration_error(keyed, y, p, groups),
        alert_budget_metrics(keyed, y, p, key, groups, budgets),
    ):
        out = null_safe_join(out, part, groups, "left")
    return out if by else out.drop("__all")


def segment_metrics(
    df: DataFrame, y: str, p: str, segments: Mapping[str, Column], kind: str = "regression", key: str = "sample_key", min_rows: int = 100
) -> DataFrame:
    """Metrics per segment value; small segments and one-class segments drop out."""
    names = list(segments)
    pairs = F.array(*[F.struct(F.lit(n).alias("segment"), segments[n].cast("string").alias("segment_value")) for n in names])
    long = df.select(y, p, *([key] if kind != "regression" else []), F.inline(pairs))
    by = ["segment", "segment_value"]
    sizes = long.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(y).alias("__classes") if kind != "regression" else F.lit(2).alias("__classes"))
    kept = sizes.filter((F.col("rows") >= min_rows) & (F.col("__classes") >= 2)).drop("__classes")
    values = regression_metrics(long, y, p, by) if kind == "regression" else classification_metrics(long, y, p, key, by)
    return null_safe_join(kept, values, by)


def baseline_ranking(metrics: DataFrame, main_model: str, target: float = 0.05) -> DataFrame:
    """Best other model by MAE per task, and the main model's relative improvement over it."""
    others = metrics.filter(F.col("model") != main_model).groupBy("task").agg(F.min(F.struct("mae", "model")).alias("b"))
    mine = metrics.filter(F.col("model") == main_model).select("task", F.col("mae").alias("model_mae"))
    gain = safe_ratio(F.col("b.mae") - F.col("model_mae"), F.col("b.mae"))
    return mine.join(others, "task").select(
        "task", "model_mae", F.col("b.model").alias("best_baseline"), F.col("b.mae").alias("baseline_mae"),
        gain.alias("relative_improvement"), F.coalesce(gain >= target, F.lit(False)).alias("target_met"),
    )


def backtest_stability(folds: DataFrame, metric: str, by: Sequence[str] = ("task",)) -> DataFrame:
    return folds.groupBy(*by).agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.min(metric).alias("low"), F.max(metric).alias("high"), F.count(metric).alias("folds")
    )
