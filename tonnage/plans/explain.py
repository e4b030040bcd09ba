"""Explanations over a long contribution table (sample_key, feature, contribution)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonnage.operators.ordered import rows_reached
from tonnage.sources.scratch import written


def even_sample(df: DataFrame, order: str, tie: str, n: int, name: str = "r") -> DataFrame:
    """Rows at `n` evenly spaced positions of an ordering (truncated positions, first and last included)."""

    def reached(first: Column, rows: Column, total: Column) -> Column:
        # a row is one of floor(i * (N-1) / (n-1)); inverted instead of listing positions
        span = F.greatest(total - 1, F.lit(1))
        i = F.ceil(first * F.lit(float(n - 1)) / span)
        place = lambda k: F.floor(k * (total - 1) / F.lit(float(n - 1)))
        return F.exists(F.array(i - 1, i, i + 1), lambda k: (k >= 0) & (k <= n - 1) & (place(k) >= first) & (place(k) < first + rows))

    return rows_reached(df, order, tie, reached, name, "__n").drop("__n")


def importance_rank(contrib: DataFrame, by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Mean absolute and signed contribution per feature, ranked; a feature list is small, so one window is fine."""
    by = list(by)
    means = contrib.groupBy(*by, "feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean_signed"), F.count(F.lit(1)).alias("rows")
    )
    order = Window.partitionBy(*by).orderBy(F.col("mean_abs").desc(), "feature")
    ranked = means.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def local_cases(scored: DataFrame, contrib: DataFrame, n: int = 10, top: int = 5, key: str = "sample_key") -> DataFrame:
    """Up to `n` rows spread over the prediction ranks, each with its largest contributions as JSON."""
    # few cases, so the contributions left after the semi join are few too; written, so that Spark knows it before it moves any
    cases = written(even_sample(scored, "prediction", key, n).drop("r"), "cases")
    near = contrib.join(cases.select(key), key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    largest = near.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top)
    packed = largest.groupBy(key).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("__r", "feature", "contribution"))),
                              lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))).alias("top_contributions_json")
    )
    return cases.join(packed, key, "left")
