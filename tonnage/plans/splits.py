"""Chronological splits with label embargo, expanding backtest folds, task rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonnage.operators.ordered import row_numbers, tiles
from tonnage.plans.contracts import SPLIT_FRACTIONS, Task


class SplitError(ValueError):
    """The snapshot times do not support the requested windows."""


def boundaries(df: DataFrame, ts: str, fractions: Sequence[float] = SPLIT_FRACTIONS) -> tuple:
    """Start of tuning, calibration and final test: three values, whatever the table size."""
    times = row_numbers(df.select(ts).distinct(), [], ts, name="__i", total="__n")
    total, shares = 0.0, []
    for f in fractions[:-1]:
        total += f
        shares.append(total)
    position = [F.least(F.greatest(F.floor(F.col("__n") * F.lit(s)), F.lit(1)), F.col("__n") - 1) for s in shares]
    picks = [F.max(F.when(F.col("__i") - 1 == p, F.col(ts))).alias(f"b{i}") for i, p in enumerate(position)]
    row = times.agg(F.max("__n").alias("n"), *picks).first()
    if row is None or (row["n"] or 0) < 8:
        raise SplitError("at least eight distinct snapshot times are needed")
    cuts = (row["b0"], row["b1"], row["b2"])
    if len(set(cuts)) != 3:
        raise SplitError("window boundaries coincide; more snapshot times are needed")
    return cuts


def temporal_split(df: DataFrame, ts: str, label_ts: str, fractions: Sequence[float] = SPLIT_FRACTIONS) -> DataFrame:
    """Add `split` and whether the label arrives before the next window begins; late labels become `embargo`."""
    kind = df.schema[ts].dataType
    tuning, calibration, final = (F.lit(c).cast(kind) for c in boundaries(df, ts, fractions))
    at, label = F.col(ts), F.col(label_ts)
    window = F.when(at < tuning, "train").when(at < calibration, "tuning").when(at < final, "calibration").otherwise("final_test")
    next_start = F.when(at < tuning, tuning).when(at < calibration, calibration).when(at < final, final)
    late = F.coalesce(label >= next_start, F.lit(False))
    return df.withColumns({"split": F.when(late, "embargo").otherwise(window), "label_available_before_next_window": ~late})


def expanding_folds(df: DataFrame, ts: str, label_ts: str, key: str, folds: int = 3, split: str = "split") -> DataFrame:
    """fold, role, key: train ends before each validation chunk and its labels are known when that chunk starts."""
    eligible = df.filter(F.col(split).isin("train", "tuning"))
    chunks = tiles(eligible.select(ts).distinct(), [], ts, ts, folds + 1, "__chunk")
    edges = {r["__chunk"]: (r["lo"], r["hi"]) for r in chunks.groupBy("__chunk").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).collect()}
    if len(edges) < folds + 1:
        raise SplitError("too few snapshot times for the folds")
    kind = df.schema[ts].dataType
    at, label, roles = F.col(ts), F.col(label_ts), []
    for fold in range(1, folds + 1):
        train_end, start, end = (F.lit(v).cast(kind) for v in (edges[fold][1], *edges[fold + 1]))
        role = F.when((at <= train_end) & (label < start), "train").when((at >= start) & (at <= end), "validation")
        roles.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    return eligible.select(F.col(key), F.inline(F.array(*roles))).filter(F.col("role").isNotNull())


def task_rows(df: DataFrame, task: Task, split: str | None = None) -> DataFrame:
    """Rows a task may use, with a double `label`: target present, optional positive filter, optional inversion."""
    if split is not None:
        df = df.filter(F.col("split") == split)
    if task.positive_filter:
        df = df.filter(F.col(task.positive_filter).cast("boolean"))
    label = F.col(task.target).cast("double")
    label = F.when(F.isnan(label), None).otherwise(label)
    if task.invert:
        label = F.lit(1.0) - label
    return df.withColumn("label", label).filter(F.col("label").isNotNull())


def fill_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns}).fillna("__MISSING__", subset=list(columns))
