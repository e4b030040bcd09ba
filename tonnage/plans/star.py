"""Star schema: five dimensions and five facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import period_key, shift_start_hour
from tonnage.sources.scratch import written
from tonnage.sources.tables import date_series


def with_surrogate(df: DataFrame, natural_key: str, name: str) -> DataFrame:
    """Dense integer key in natural-key order, at any size; natural keys are unique.

    The members are written in range-sorted order with their place in their partition; the partitions' sizes, one row each,
    turn places into numbers."""
    place = written(df.orderBy(natural_key).withColumn("__at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = place.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    numbered = place.withColumn("__part", part).join(starts, "__part")
    return numbered.withColumn(name, (F.col("__start") + row + 1).cast("int")).drop("__at", "__part", "__start")


def dim_date(bounds: DataFrame, start: str, end: str) -> DataFrame:
    day = F.col("full_date")
    weekday = F.dayofweek(day) - 1
    return date_series(bounds, start, end).select(
        period_key(day).alias("date_key"),
        "full_date",
        F.year(day).alias("year_number"),
        F.month(day).alias("month_number"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.weekofyear(day).alias("iso_week"),
        weekday.alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        weekday.isin(0, 6).alias("is_weekend"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    return with_surrogate(products, "product_code", "product_key")


def dim_line(lines: DataFrame) -> DataFrame:
    return with_surrogate(lines, "line_id", "line_key")


def dim_shift(shifts: DataFrame) -> DataFrame:
    return with_surrogate(shifts, "shift_id", "shift_key")


def dim_asset(assets: DataFrame, lines: DataFrame) -> DataFrame:
    keyed = assets.join(lines.select("line_id", "line_key"), "line_id")
    return with_surrogate(keyed, "asset_id", "asset_key")


def dim_grade(grades: DataFrame) -> DataFrame:
    return with_surrogate(grades, "grade_family", "grade_key")


#: A tube's identity, and the spread 64-bit number of it that tables are bucketed by.
TUBE = ("tube_key", "tube_id")


def tube_keys(*frames: DataFrame) -> list[str]:
    """The parts of a tube's identity that all frames have."""
    return [c for c in TUBE if all(c in f.columns for f in frames)]


def fact_production(
    tubes: DataFrame, products: DataFrame, lines: DataFrame, shifts: DataFrame, period: str = "yyyyMMdd", grades: DataFrame | None = None
) -> DataFrame:
    """Tube fact; AQE broadcasts the dimensions as long as their measured size allows. With `grades`, it has their key too."""
    if grades is not None:
        tubes = tubes.join(grades, "grade_family")
    keyed = (
        tubes.join(products.select("product_code", "product_key"), "product_code")
        .join(lines.select("line_id", "line_key"), "line_id")
        .join(shifts.select("shift_id", "shift_key"), "shift_id")
    )
    return production_rows(keyed, period)


def production_rows(keyed: DataFrame, period: str = "yyyyMMdd", keep: Sequence[str] = ()) -> DataFrame:
    """The tube fact from tubes that have their surrogate keys; `keep` names columns that go with it."""
    tonnes = F.col("tube_mass_kg") / 1000.0
    return keyed.select(
        *tube_keys(keyed),
        "order_id",
        *(["grade_key"] if "grade_key" in keyed.columns else []),
        period_key("actual_start_ts", period).alias("date_key"),
        "product_key",
        "line_key",
        "shift_key",
        "product_code",
        "grade_family",
        "line_id",
        "shift_id",
        "actual_start_ts",
        "actual_end_ts",
        tonnes.alias("total_mass_t"),
        "good_mass_t",
        "productive_hours",
        "actual_tph",
        "approved_first_pass",
        "disposition",
        F.when(F.col("disposition") == "REWORK", tonnes).otherwise(0.0).alias("rework_mass_t"),
        F.when(F.col("disposition") == "SCRAP", tonnes).otherwise(0.0).alias("scrap_mass_t"),
        *keep,
    )


CONTEXT = ("product_key", "line_key", "shift_key", "product_code", "grade_family", "line_id", "shift_id")


def _with_context(events: DataFrame, production: DataFrame) -> DataFrame:
    keys = tube_keys(events, production)
    # stored facts are bucketed alike: a merge needs no exchange at any size, a broadcast would send a fact
    return events.join(production.select(*keys, *CONTEXT).hint("merge"), keys)


def fact_quality(quality: DataFrame, production: DataFrame, period: str = "yyyyMMdd") -> DataFrame:
    return _with_context(quality, production).withColumn("date_key", period_key("inspection_ts", period))


def fact_energy(energy: DataFrame, production: DataFrame, period: str = "yyyyMMdd") -> DataFrame:
    return _with_context(energy, production).withColumn("date_key", period_key("event_ts", period))


def energy_totals(energy: DataFrame, production: DataFrame, period: str = "yyyyMMdd") -> DataFrame:
    """Energy summed per tube and period before the join to production: all the marts need, on fewer rows."""
    keyed = energy.withColumn("date_key", period_key("event_ts", period))
    sums = keyed.groupBy(*tube_keys(keyed), "order_id", "date_key").agg(F.sum("energy_kwh").alias("energy_kwh"), F.sum("good_mass_t").alias("good_mass_t"))
    return _with_context(sums, production)


def fact_downtime(downtime: DataFrame, lines: DataFrame, assets: DataFrame, shifts: DataFrame, period: str = "yyyyMMdd") -> DataFrame:
    """Stop fact; the shift follows from the eight-hour block the stop starts in."""
    return (
        downtime.withColumn("start_hour", shift_start_hour("event_start_ts"))
        .join(lines.select("line_id", "line_key"), "line_id")
        .join(assets.select("asset_id", "asset_key"), "asset_id")
        .join(shifts.select("start_hour", "shift_id", "shift_key"), "start_hour")
        .withColumn("date_key", period_key("event_start_ts", period))
        .drop("start_hour")
    )


def fact_maintenance(maintenance: DataFrame, lines: DataFrame, assets: DataFrame, period: str = "yyyyMMdd") -> DataFrame:
    return (
        maintenance.join(lines.select("line_id", "line_key"), "line_id")
        .join(assets.select("asset_id", "asset_key"), "asset_id")
        .withColumn("date_key", period_key("actual_start_ts", period))
    )
