"""KPI marts. Each fact is aggregated to its grain before any join, so joins move mart-sized rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import capped, flag, safe_ratio

SHIFT_GRAIN = ("date_key", "line_key", "shift_key")
# The names follow from the surrogate keys. As grouping keys they keep the hash aggregation, whereas
# min(text) would turn it into a sort of all fact rows.
SHIFT_NAMES = ("line_id", "shift_id")


def _production_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("tube_count"),
        F.sum("total_mass_t").alias("total_tonnes"),
        F.sum("good_mass_t").alias("good_tonnes"),
        F.sum("productive_hours").alias("productive_hours"),
        F.sum("rework_mass_t").alias("rework_tonnes"),
        F.sum("scrap_mass_t").alias("scrap_tonnes"),
        F.avg(flag(F.col("approved_first_pass"))).alias("fpy"),
        F.avg(flag(F.col("disposition") == "REWORK")).alias("rework_rate"),
        F.avg(flag(F.col("disposition") == "SCRAP")).alias("scrap_rate"),
    ]


def _carried(*names: str) -> list[Column]:
    return [F.min(n).alias(n) for n in names]


def order_performance(
    production: DataFrame, energy: DataFrame, products: DataFrame, lines: DataFrame, shifts: DataFrame, grades: DataFrame
) -> DataFrame:
    """Per order, with the end of its last tube; orders without any energy event drop out. Where frames lie by tube_key, nothing is exchanged.

    Surrogate keys ascend with the names, so an order's least name is that of its least key: numbers are aggregated (min of a
    text would sort all tubes) and the names looked up for the orders only."""
    carried = _carried("date_key", "product_key", "line_key", "shift_key", "grade_key")
    keys = [c for c in ("tube_key", "order_id") if c in production.columns and c in energy.columns]
    made = production.groupBy(*keys).agg(*carried, *_production_aggs(), F.max("actual_end_ts").alias("last_end_ts"))
    used = energy.groupBy(*keys).agg(F.sum("energy_kwh").alias("energy_kwh"))
    made = made.join(used.hint("merge"), keys)
    for dimension, key, name in ((products, "product_key", "product_code"), (lines, "line_key", "line_id"), (shifts, "shift_key", "shift_id"), (grades, "grade_key", "grade_family")):
        made = made.join(dimension.select(key, name), key)
    return made.drop("grade_key", "tube_key").withColumns(
        {
            "tbh": safe_ratio("good_tonnes", "productive_hours"),
            "energy_per_good_tonne_kwh_t": safe_ratio("energy_kwh", "good_tonnes"),
        }
    )


def oee_components(df: DataFrame, rate: float = 42.0) -> DataFrame:
    hours, stopped = F.col("productive_hours"), F.col("unplanned_downtime_minutes") / 60.0
    return df.withColumns(
        {
            "availability": safe_ratio(hours, hours + stopped),
            "performance": capped(safe_ratio("total_tonnes", F.lit(rate) * hours), 1.0),
            "quality": safe_ratio("good_tonnes", "total_tonnes"),
        }
    )


def line_shift_performance(production: DataFrame, energy: DataFrame, downtime: DataFrame, rate: float = 42.0) -> DataFrame:
    """Date x line x shift KPIs; a cell without energy shows 0 kWh but an unknown intensity."""
    grain = list(SHIFT_GRAIN)
    made = production.groupBy(*grain, *SHIFT_NAMES).agg(*_production_aggs())
    used = energy.groupBy(*grain).agg(F.sum("energy_kwh").alias("__kwh"))
    stopped = downtime.groupBy(*grain).agg(F.sum("duration_minutes").alias("__stopped"))
    cells = made.join(used, grain, "left").join(stopped, grain, "left")
    cells = cells.withColumns(
        {
            "energy_kwh": F.coalesce("__kwh", F.lit(0.0)),
            "unplanned_downtime_minutes": F.coalesce("__stopped", F.lit(0.0)),
            "tbh": safe_ratio("good_tonnes", "productive_hours"),
            "energy_per_good_tonne_kwh_t": safe_ratio("__kwh", "good_tonnes"),
        }
    ).drop("__kwh", "__stopped")
    return oee_components(cells, rate).withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))


_SUMMED = (
    "tube_count", "total_tonnes", "good_tonnes", "productive_hours", "rework_tonnes", "scrap_tonnes",
    "energy_kwh", "unplanned_downtime_minutes",
)


def line_shift_summary(mart: DataFrame, rate: float = 42.0) -> DataFrame:
    """Line x shift; every ratio is recomputed from the sums."""
    sums = mart.groupBy("line_key", "shift_key", *SHIFT_NAMES).agg(*[F.sum(c).alias(c) for c in _SUMMED])
    sums = sums.withColumns(
        {
            "tbh": safe_ratio("good_tonnes", "productive_hours"),
            "energy_per_good_tonne_kwh_t": safe_ratio("energy_kwh", "good_tonnes"),
        }
    )
    return oee_components(sums, rate)


QUALITY_GRAIN = ("date_key", "product_key", "line_key", "product_code", "grade_family", "line_id", "characteristic", "unit")


def quality_summary(quality: DataFrame) -> DataFrame:
    value = "measured_value"
    return quality.groupBy(*QUALITY_GRAIN).agg(
        F.count(F.lit(1)).alias("inspection_count"),
        F.avg(value).alias("mean_value"),
        F.stddev_pop(value).alias("standard_deviation"),
        F.min(value).alias("minimum_value"),
        F.max(value).alias("maximum_value"),
        F.avg(flag(F.col("passed"))).alias("conformance_rate"),
        F.count_if(~F.col("passed")).alias("nonconforming_count"),
    )


def energy_summary(energy: DataFrame, repeats: int = 3) -> DataFrame:
    """Good mass repeats on each of a tube's `repeats` energy rows, hence the division."""
    good = F.sum("good_mass_t") / F.lit(float(repeats))
    return energy.groupBy(*SHIFT_GRAIN, *SHIFT_NAMES).agg(
        F.sum("energy_kwh").alias("energy_kwh"),
        good.alias("good_tonnes"),
        safe_ratio(F.sum("energy_kwh"), good).alias("energy_per_good_tonne_kwh_t"),
    )


def downtime_maintenance(downtime: DataFrame, maintenance: DataFrame, lines: DataFrame) -> DataFrame:
    """Date x line; a day may have stops, interventions or both."""
    grain = ["date_key", "line_key"]
    stops = downtime.groupBy(*grain, F.col("line_id").alias("__line")).agg(
        F.count(F.lit(1)).alias("downtime_event_count"),
        F.sum("duration_minutes").alias("unplanned_downtime_minutes"),
        F.sum("production_impact_t").alias("production_impact_t"),
        F.avg("sensor_degradation_index").alias("mean_sensor_degradation"),
        F.avg(flag(F.col("maintenance_deferred"))).alias("deferred_context_rate"),
    )
    works = maintenance.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("maintenance_event_count"),
        F.sum("duration_minutes").alias("maintenance_minutes"),
        F.avg(flag(F.col("was_deferred"))).alias("maintenance_deferred_rate"),
    )
    both = stops.join(works, grain, "full").join(lines.select("line_key", "line_id"), "line_key", "left")

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0 if name.endswith("_count") else 0.0)).alias(name)

    return both.select(
        "date_key",
        "line_key",
        F.coalesce("__line", "line_id").alias("line_id"),
        or_zero("downtime_event_count"),
        or_zero("unplanned_downtime_minutes"),
        or_zero("production_impact_t"),
        "mean_sensor_degradation",
        "deferred_context_rate",
        or_zero("maintenance_event_count"),
        or_zero("maintenance_minutes"),
        "maintenance_deferred_rate",
    )


def asset_condition(process: DataFrame, production: DataFrame, stops_and_works: DataFrame) -> DataFrame:
    placed = process.drop("line_id").join(production.select("tube_id", "date_key", "line_key", "line_id"), "tube_id")
    state = placed.groupBy("date_key", "line_key", "line_id").agg(
        F.avg("tool_wear_index").alias("mean_tool_wear_index"),
        F.max("tool_wear_index").alias("maximum_tool_wear_index"),
        F.avg("sensor_degradation_index").alias("mean_sensor_degradation_index"),
        F.avg("hours_since_maintenance").alias("mean_hours_since_maintenance"),
        F.avg(flag(F.col("maintenance_deferred"))).alias("maintenance_deferred_rate"),
    )
    side = stops_and_works.select(
        "date_key", "line_key", F.col("unplanned_downtime_minutes").alias("__m"), F.col("maintenance_event_count").alias("__c")
    )
    return (
        state.join(side, ["date_key", "line_key"], "left")
        .withColumn("unplanned_downtime_minutes", F.coalesce("__m", F.lit(0.0)))
        .withColumn("maintenance_event_count", F.coalesce("__c", F.lit(0)))
        .drop("__m", "__c")
    )


def losses(production: DataFrame, downtime: DataFrame) -> DataFrame:
    """Loss rows per cell and type. Rework and scrap come from one pass over production."""
    grain = list(SHIFT_GRAIN)
    cells = production.groupBy(*grain, *SHIFT_NAMES).agg(
        F.count_if(F.col("disposition") == "REWORK").alias("rework_n"),
        F.sum("rework_mass_t").alias("rework_t"),
        F.count_if(F.col("disposition") == "SCRAP").alias("scrap_n"),
        F.sum("scrap_mass_t").alias("scrap_t"),
    )
    kinds = F.array(
        F.struct(F.lit("REWORK").alias("loss_type"), F.col("rework_n").alias("event_count"), F.col("rework_t").alias("loss_tonnes_equivalent")),
        F.struct(F.lit("SCRAP").alias("loss_type"), F.col("scrap_n").alias("event_count"), F.col("scrap_t").alias("loss_tonnes_equivalent")),
    )
    made = cells.select(*grain, "line_id", "shift_id", F.inline(kinds))
    stops = downtime.groupBy(*grain, *SHIFT_NAMES).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("production_impact_t").alias("loss_tonnes_equivalent")
    )
    return made.unionByName(stops.withColumn("loss_type", F.lit("UNPLANNED_DOWNTIME")))


def pareto(df: DataFrame, by: Sequence[str], kind: str, value: str) -> DataFrame:
    """Share and cumulative share of the positive values inside each `by` cell (a few kinds per cell)."""
    cell = Window.partitionBy(*by)
    upto = cell.orderBy(F.col(value).desc(), kind).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum(value).over(cell)
    return df.filter(F.col(value) > 0).withColumns(
        {"loss_share": safe_ratio(F.col(value), whole), "cumulative_loss_share": safe_ratio(F.sum(value).over(upto), whole)}
    )


def loss_pareto(production: DataFrame, downtime: DataFrame) -> DataFrame:
    return pareto(losses(production, downtime), SHIFT_GRAIN, "loss_type", "loss_tonnes_equivalent")
