"""Retrospective diagnostics: trend, mix adjustment, control charts, interactions, associations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import flag, safe_corr, safe_ratio
from tonnage.operators.ordered import exact_quantiles, tiles_together
from tonnage.plans.features import DIMENSIONAL, pivot_characteristics
from tonnage.plans.star import tube_keys


def period_start(date_key: str = "date_key") -> Column:
    """First day of an integer yyyyMM or yyyyMMdd key."""
    text = F.col(date_key).cast("string")
    return F.to_date(F.rpad(text, 8, "01"), "yyyyMMdd")


def daily_trend(mart: DataFrame) -> DataFrame:
    """Change against the previous period of the same line and shift (one mart row per period)."""
    past = Window.partitionBy("line_key", "shift_key").orderBy("date_key")
    return mart.withColumns(
        {
            "full_date": period_start(),
            "tbh_change_from_previous_window": F.col("tbh") - F.lag("tbh").over(past),
            "fpy_change_from_previous_window": F.col("fpy") - F.lag("fpy").over(past),
        }
    )


def mix_adjustment(orders: DataFrame, minimum_orders: int = 3) -> DataFrame:
    """Actual throughput against what the product mix's own medians would have given."""
    segment = ["product_code", "grade_family", "line_id"]
    medians = exact_quantiles(orders, segment, "tbh", {"segment_median_tbh": 0.5})
    sizes = orders.groupBy(*segment).agg(F.count(F.lit(1)).alias("baseline_order_count"))
    baseline = sizes.join(medians, segment, "left")
    cells = (
        orders.join(baseline, segment)
        .groupBy("date_key", "line_key")
        .agg(
            F.min("line_id").alias("line_id"),  # an order's smallest line name need not match its smallest key
            F.sum("good_tonnes").alias("good_tonnes"),
            F.sum("productive_hours").alias("productive_hours"),
            F.sum(F.col("segment_median_tbh") * F.col("productive_hours")).alias("mix_expected_good_tonnes"),
            F.count(F.lit(1)).alias("order_count"),
            F.count_if(F.col("baseline_order_count") < minimum_orders).alias("low_support_segment_orders"),
        )
    )
    cells = cells.withColumns(
        {
            "actual_tbh": safe_ratio("good_tonnes", "productive_hours"),
            "mix_expected_tbh": safe_ratio("mix_expected_good_tonnes", "productive_hours"),
        }
    )
    return cells.withColumn("mix_adjusted_tbh_gap", F.col("actual_tbh") - F.col("mix_expected_tbh"))


def baseline_end(mart: DataFrame, period: str = "date_key", q: float = 0.30) -> DataFrame:
    """Discrete quantile of the period key, from the row count of each period (a calendar-sized table)."""
    per_period = mart.groupBy(period).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    counted = per_period.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(Window.partitionBy())})
    return counted.filter(F.col("__upto") >= F.ceil(F.lit(q) * F.col("__all"))).agg(F.min(period).alias("baseline_end"))


def spc(
    mart: DataFrame,
    value: str,
    by: Sequence[str],
    keep: Sequence[str],
    suffix: str,
    period: str = "date_key",
    q: float = 0.30,
    k: float = 3.0,
    min_n: int = 5,
    floor: float | None = None,
) -> DataFrame:
    """Control limits from the first `q` of the history; a signal needs support and a positive sigma."""
    cutoff = baseline_end(mart, period, q).scalar()
    limits = (
        mart.filter(F.col(period) <= cutoff)
        .groupBy(*by)
        .agg(
            F.avg(value).alias(f"centerline_{suffix}"),
            F.stddev_samp(value).alias("__sigma"),
            F.count(F.lit(1)).alias("baseline_observations"),
            F.max(period).alias("baseline_end_date_key"),
        )
    )
    centre, sigma, x = F.col(f"centerline_{suffix}"), F.col("__sigma"), F.col(value)
    width = F.lit(k) * F.coalesce(sigma, F.lit(0.0))
    low = centre - width if floor is None else F.greatest(centre - width, F.lit(floor))
    outside = (x < centre - F.lit(k) * sigma) | (x > centre + F.lit(k) * sigma)
    reliable = F.col("baseline_observations") >= min_n
    return (
        mart.select(*keep)
        .join(limits, list(by))
        .select(
            *keep,
            f"centerline_{suffix}",
            low.alias(f"lower_control_{suffix}"),
            (centre + width).alias(f"upper_control_{suffix}"),
            "baseline_observations",
            "baseline_end_date_key",
            reliable.alias("limits_reliable"),
            F.when(reliable & (sigma > 0), outside).otherwise(F.lit(False)).alias("control_signal"),
        )
    )


def spc_tbh(mart: DataFrame) -> DataFrame:
    keep = ("date_key", "line_key", "shift_key", "line_id", "shift_id", "tbh")
    return spc(mart, "tbh", ["line_key"], keep, "tbh", floor=0.0)


def spc_quality(mart: DataFrame, k: float = 3.0) -> DataFrame:
    keep = (
        "date_key", "product_key", "line_key", "product_code", "grade_family", "line_id", "characteristic", "unit",
        "inspection_count", "mean_value", "conformance_rate",
    )
    return spc(mart, "mean_value", ["line_key", "characteristic"], keep, "value", k=k)


def interactions(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    key: str,
    cell: Sequence[str],
    aggs: Sequence[Column],
    x_band: str = "roll_speed_band",
    y_band: str = "thermal_uniformity_band",
    bands: int = 3,
    ranges_from: DataFrame | None = None,
) -> DataFrame:
    """Cross two per-segment tercile bands and summarise each cell."""
    banded = tiles_together(df, by, {x: x_band, y: y_band}, key, bands, ranges_from)
    return banded.groupBy(*cell, x_band, y_band).agg(*aggs)


def ranked_tubes(production: DataFrame, process: DataFrame, quality: DataFrame, energy: DataFrame) -> DataFrame:
    """What `process_interactions` reads of a tube, from its facts."""
    keys = tube_keys(production, process, quality, energy)
    state = process.select(*keys, "roll_speed_rpm", "thermal_uniformity_index", "tool_wear_index")
    used = energy.groupBy(*keys).agg(F.sum("energy_kwh").alias("energy_kwh"))
    made = production.select(*keys, "product_code", "grade_family", "line_id", "actual_tph", "approved_first_pass", "disposition")
    return made.join(state, keys).join(pivot_characteristics(quality, DIMENSIONAL), keys).join(used, keys)


def process_interactions(ranked: DataFrame, ranges_from: DataFrame | None = None) -> DataFrame:
    means = {
        "mean_wall_eccentricity_pct": "wall_eccentricity_pct",
        "mean_outer_diameter_deviation_mm": "outer_diameter_deviation_mm",
        "mean_ovality_pct": "ovality_pct",
        "mean_energy_kwh": "energy_kwh",
        "mean_roll_speed_rpm": "roll_speed_rpm",
        "mean_thermal_uniformity_index": "thermal_uniformity_index",
        "mean_tool_wear_index": "tool_wear_index",
    }
    aggs = [
        F.count(F.lit(1)).alias("tube_count"),
        F.avg("actual_tph").alias("mean_actual_tph"),
        F.avg(flag(F.col("approved_first_pass"))).alias("fpy"),
        F.avg(flag(F.col("disposition") == "REWORK")).alias("rework_rate"),
        F.avg(flag(F.col("disposition") == "SCRAP")).alias("scrap_rate"),
        *[F.avg(c).alias(n) for n, c in means.items()],
    ]
    segment = ["product_code", "grade_family"]
    return interactions(
        ranked, "roll_speed_rpm", "thermal_uniformity_index", segment, "tube_id", [*segment, "line_id"], aggs, ranges_from=ranges_from
    )


def associations(df: DataFrame, pairs: Mapping[str, tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Pearson correlation of each named pair per segment, with the segment's row count."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tube_count"), *[safe_corr(a, b).alias(n) for n, (a, b) in pairs.items()]
    )


SEGMENT_PAIRS = {
    "association_roll_speed_tph": ("roll_speed_rpm", "actual_tph"),
    "association_uniformity_eccentricity": ("thermal_uniformity_index", "wall_eccentricity_pct"),
    "association_wear_eccentricity": ("tool_wear_index", "wall_eccentricity_pct"),
    "association_sensor_degradation_tph": ("sensor_degradation_index", "actual_tph"),
}


def associated_tubes(production: DataFrame, process: DataFrame, quality: DataFrame) -> DataFrame:
    """What `segment_associations` reads of a tube, from its facts."""
    keys = tube_keys(production, process, quality)
    state = process.select(*keys, "roll_speed_rpm", "thermal_uniformity_index", "tool_wear_index", "sensor_degradation_index")
    made = production.select(*keys, "product_code", "grade_family", "line_id", "actual_tph")
    return made.join(state, keys).join(pivot_characteristics(quality, ("wall_eccentricity_pct",)), keys)


def segment_associations(tubes: DataFrame) -> DataFrame:
    return associations(tubes, SEGMENT_PAIRS, ["product_code", "grade_family", "line_id"])


def diagnostic_summary(
    production: DataFrame, mix: DataFrame, losses: DataFrame, tbh_spc: DataFrame, quality_spc: DataFrame, cells: DataFrame
) -> DataFrame:
    """One row. Every part is a one-row aggregate or a top-1, combined as scalar subqueries."""
    overall = production.agg(
        safe_ratio(F.sum("good_mass_t"), F.sum("productive_hours")).alias("global_tbh"),
        F.avg(flag(F.col("approved_first_pass"))).alias("global_fpy"),
    )
    daily = production.groupBy("date_key").agg(safe_ratio(F.sum("good_mass_t"), F.sum("productive_hours")).alias("tbh"))
    gaps = mix.agg(F.avg("mix_adjusted_tbh_gap").alias("mean"), F.max(F.abs("mix_adjusted_tbh_gap")).alias("worst"))
    top = (
        losses.groupBy("loss_type").agg(F.sum("loss_tonnes_equivalent").alias("t")).orderBy(F.col("t").desc(), "loss_type").limit(1)
    )

    def signals(df: DataFrame) -> DataFrame:
        return df.agg(
            F.count_if(F.col("limits_reliable") & F.col("control_signal")).alias("signals"),
            F.count_if(F.col("limits_reliable")).alias("reliable"),
        )

    segment = ["product_code", "grade_family", "line_id"]
    spread = cells.groupBy(*segment).agg((F.max("mean_actual_tph") - F.min("mean_actual_tph")).alias("s"))
    widest = spread.orderBy(F.col("s").desc(), *segment).limit(1)
    widest = widest.select(F.struct(*segment, "s").alias("w"))
    tbh, quality = signals(tbh_spc), signals(quality_spc)
    slope = daily.agg(F.regr_slope(F.col("tbh"), F.col("date_key").cast("double")).alias("slope"))
    return overall.select(
        F.round("global_tbh", 6).alias("global_tbh"),
        F.round("global_fpy", 6).alias("global_fpy"),
        F.round(slope.scalar(), 9).alias("daily_tbh_linear_slope"),
        F.round(gaps.select("mean").scalar(), 6).alias("mean_mix_adjusted_tbh_gap"),
        F.round(gaps.select("worst").scalar(), 6).alias("maximum_absolute_mix_adjusted_tbh_gap"),
        top.select("loss_type").scalar().alias("top_loss_type"),
        F.round(top.select("t").scalar(), 6).alias("top_loss_tonnes_equivalent"),
        tbh.select("signals").scalar().alias("tbh_control_signals"),
        tbh.select("reliable").scalar().alias("tbh_windows_with_reliable_limits"),
        quality.select("signals").scalar().alias("quality_control_signals"),
        quality.select("reliable").scalar().alias("quality_rows_with_reliable_limits"),
        widest.scalar().alias("__w"),
    ).select("*", F.col("__w.product_code").alias("spread_product_code"), F.col("__w.grade_family").alias("spread_grade_family"),
             F.col("__w.line_id").alias("spread_line_id"), F.round("__w.s", 6).alias("spread_tbh")).drop("__w")
