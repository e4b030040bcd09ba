"""Dashboard read model: small, sorted views over the marts and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import safe_ratio
from tonnage.plans.diagnostics import period_start


def _ratio(a: str, b: str):
    return safe_ratio(F.sum(a), F.sum(b))


def _weighted(value: str, weight: str):
    return safe_ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def executive_trend(trend: DataFrame) -> DataFrame:
    return trend.select(
        "full_date", "line_id", "shift_id", "tube_count", "total_tonnes", "good_tonnes", "productive_hours", "fpy",
        "energy_kwh", "unplanned_downtime_minutes", "tbh", "energy_per_good_tonne_kwh_t", "oee",
    ).orderBy("full_date", "line_id", "shift_id")


def line_summary(mart: DataFrame) -> DataFrame:
    return mart.groupBy("line_id").agg(
        F.sum("tube_count").alias("tube_count"),
        _ratio("good_tonnes", "productive_hours").alias("tbh"),
        _ratio("good_tonnes", "total_tonnes").alias("quality"),
        _ratio("energy_kwh", "good_tonnes").alias("energy_per_good_tonne_kwh_t"),
        F.sum("unplanned_downtime_minutes").alias("unplanned_downtime_minutes"),
        _weighted("oee", "tube_count").alias("oee"),
    ).orderBy("line_id")


def loss_totals(pareto: DataFrame) -> DataFrame:
    return pareto.groupBy("loss_type").agg(
        F.sum("event_count").alias("event_count"), F.sum("loss_tonnes_equivalent").alias("loss_tonnes_equivalent")
    ).orderBy(F.col("loss_tonnes_equivalent").desc(), "loss_type")


def mix_by_date(mix: DataFrame) -> DataFrame:
    return mix.select(
        period_start().alias("full_date"), "line_id", "actual_tbh", "mix_expected_tbh", "mix_adjusted_tbh_gap", "order_count"
    ).orderBy("full_date", "line_id")


def quality_alerts(quality_spc: DataFrame, n: int = 100) -> DataFrame:
    """Latest reliable alerts; the extra keys make the cut repeatable."""
    tie = ["line_id", "product_code", "grade_family", "characteristic"]
    return (
        quality_spc.filter("limits_reliable AND control_signal")
        .select(period_start().alias("full_date"), *tie, "mean_value", "conformance_rate", "control_signal")
        .orderBy(F.col("full_date").desc(), *tie)
        .limit(n)
    )


def tbh_control(tbh_spc: DataFrame) -> DataFrame:
    return tbh_spc.filter("limits_reliable").select(
        period_start().alias("full_date"), "line_id", "shift_id", "tbh", "lower_control_tbh", "upper_control_tbh", "control_signal"
    ).orderBy("full_date", "line_id", "shift_id")


def asset_condition_by_date(mart: DataFrame) -> DataFrame:
    return mart.select(
        period_start().alias("full_date"), "line_id", "mean_tool_wear_index", "mean_sensor_degradation_index",
        "mean_hours_since_maintenance", "maintenance_deferred_rate", "unplanned_downtime_minutes",
    ).orderBy("full_date", "line_id")


def slice_filter(df: DataFrame, line: str | None = None, shift: str | None = None, start=None, end=None) -> DataFrame:
    """Optional line, shift and date window; unset parts do not filter."""
    if line is not None:
        df = df.filter(F.col("line_id") == line)
    if shift is not None:
        df = df.filter(F.col("shift_id") == shift)
    if start is not None and end is not None:
        df = df.filter(F.col("full_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df


def monthly_by_line(trend: DataFrame) -> DataFrame:
    """Calendar-month roll-up; the FPY of this view is the plain mean of the cells."""
    return trend.groupBy(F.date_trunc("month", "full_date").cast("date").alias("month"), "line_id").agg(
        F.sum("good_tonnes").alias("good_tonnes"),
        F.sum("productive_hours").alias("productive_hours"),
        F.sum("energy_kwh").alias("energy_kwh"),
        F.avg("fpy").alias("unweighted_fpy"),
        _ratio("good_tonnes", "productive_hours").alias("tbh"),
        _ratio("energy_kwh", "good_tonnes").alias("energy_per_good_tonne_kwh_t"),
    ).orderBy("month", "line_id")


def line_tbh(trend: DataFrame, **slicers) -> DataFrame:
    return slice_filter(trend, **slicers).groupBy("line_id").agg(
        F.sum("good_tonnes").alias("good_tonnes"), F.sum("productive_hours").alias("productive_hours"),
        _ratio("good_tonnes", "productive_hours").alias("tbh"),
    ).orderBy("line_id")


def monthly_mix_gap(mix: DataFrame) -> DataFrame:
    return mix.groupBy(F.date_trunc("month", period_start()).cast("date").alias("month"), "line_id").agg(
        F.avg("mix_adjusted_tbh_gap").alias("mix_adjusted_tbh_gap")
    ).orderBy("month", "line_id")


def loss_share(pareto: DataFrame) -> DataFrame:
    """Whole-plant share per loss type: three rows, so the unpartitioned window is trivial."""
    totals = pareto.groupBy("loss_type").agg(F.sum("loss_tonnes_equivalent").alias("loss_tonnes_equivalent"))
    upto = Window.orderBy(F.col("loss_tonnes_equivalent").desc(), "loss_type").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("loss_tonnes_equivalent").over(Window.partitionBy())
    return totals.withColumns(
        {
            "share": safe_ratio(F.col("loss_tonnes_equivalent"), whole),
            "cumulative_share": safe_ratio(F.sum("loss_tonnes_equivalent").over(upto), whole),
        }
    )


def executive_card(trend: DataFrame) -> DataFrame:
    """Headline figures of one filter selection; empty denominators are guarded, not null."""

    def over(numerator, denominator: str):
        return F.sum(numerator) / F.greatest(F.sum(denominator), F.lit(1e-12))

    return trend.agg(
        over("good_tonnes", "productive_hours").alias("tbh"),
        over(F.col("fpy") * F.col("tube_count"), "tube_count").alias("fpy"),
        over(F.col("oee") * F.col("tube_count"), "tube_count").alias("oee"),
        over("energy_kwh", "good_tonnes").alias("energy_per_good_tonne_kwh_t"),
        F.sum("unplanned_downtime_minutes").alias("unplanned_downtime_minutes"),
        F.sum("good_tonnes").alias("good_tonnes"),
    )


def interaction_heatmap(cells: DataFrame, value: str, keys: Sequence[str] = ("product_code", "grade_family")) -> DataFrame:
    """Thermal band x speed band table of mean values for each segment."""
    wide = cells.groupBy(*keys, "thermal_uniformity_band").pivot("roll_speed_band", [1, 2, 3]).agg(F.avg(value))
    for band in (1, 2, 3):
        wide = wide.withColumnRenamed(str(band), f"speed_{band}")
    return wide


def slicer_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
