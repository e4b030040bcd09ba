"""Point-in-time feature snapshots, labels that arrive later, and the contracted X / index / y selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.functions.scalar import add_seconds, flag, hour_boundaries, period_key, safe_ratio, shift_start_hour
from tonnage.operators.asof import EventSource, Lookback, asof_last, lookahead_agg, lookback_agg
from tonnage.plans.star import tube_keys
from tonnage.sources.tables import time_grid

GRID_STEP_HOURS = 2
_STEP = GRID_STEP_HOURS * 3600


def pre_order_snapshot(orders: DataFrame, billets: DataFrame, maintenance: DataFrame) -> DataFrame:
    """One row per order at the moment both its release and its billet are known."""
    base = orders.join(billets, "order_id").withColumn("snapshot_ts", F.greatest("release_ts", "received_ts"))
    known = asof_last(base, maintenance, ["line_id"], "snapshot_ts", "actual_end_ts", "last_maintenance_ts")
    return known.withColumns(
        {
            "hours_since_last_maintenance": hour_boundaries("last_maintenance_ts", "snapshot_ts"),
            "feature_max_source_ts": F.greatest("received_ts", F.coalesce("last_maintenance_ts", "received_ts")),
        }
    )


def _spread(df: DataFrame, key: str, salts: int) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))


def in_process_snapshot(
    process: DataFrame, stages: DataFrame, sensors: DataFrame, sensor_means: dict[str, str], stage: str = "ROLLING_SIZING", salts: int = 8
) -> DataFrame:
    """One row per tube at the end of its rolling stage, with what its sensors had delivered by then.

    Sensor rows are salted and summed per (tube, salt) first, so a tube with very many windows is not one task.
    """
    rolled = stages.filter(F.col("stage_name") == stage).groupBy("tube_id").agg(F.max("event_end_ts").alias("snapshot_ts"))
    copies = rolled.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    seen = _spread(sensors, "tube_id", salts).join(copies, ["tube_id", "__salt"])
    seen = seen.filter(F.col("feature_available_at_ts") <= F.col("snapshot_ts"))
    measures = {out: F.when(F.col("sensor_type") == kind, F.col("mean_value")) for out, kind in sensor_means.items()}
    measures["mean_sensor_out_of_range_pct"] = F.col("out_of_range_pct")
    measures["valid_sensor_window_rate"] = flag(F.col("data_quality_status") == "VALID")
    partial = seen.groupBy("tube_id", "__salt").agg(
        F.max("feature_available_at_ts").alias("__last"),
        *[F.sum(m).alias(f"__s_{n}") for n, m in measures.items()],
        *[F.count(m).alias(f"__c_{n}") for n, m in measures.items()],
    )
    state = partial.groupBy("tube_id").agg(
        F.max("__last").alias("__last"),
        *[safe_ratio(F.sum(f"__s_{n}"), F.sum(f"__c_{n}")).alias(n) for n in measures],
    )
    return (
        process.join(rolled, "tube_id")
        .join(state, "tube_id", "left")
        .withColumn("feature_max_source_ts", F.greatest("process_start_ts", F.coalesce("__last", "process_start_ts")))
        .drop("__last")
    )


def asset_windows(assets: DataFrame, shifts: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Two-hour operational windows of every asset, with calendar and shift context."""
    grid = time_grid(assets, first_day, last_day, GRID_STEP_HOURS, "full_date", "window_hour")
    day = F.col("full_date")
    hour_text = F.lpad(F.col("window_hour").cast("string"), 2, "0")
    weekday = F.dayofweek(day) - 1
    return (
        grid.withColumn("start_hour", shift_start_hour("window_hour", is_hour=True))
        .join(shifts.select("start_hour", "shift_id"), "start_hour")
        .drop("start_hour")
        .withColumn("__midnight", day.cast("timestamp_ntz"))
        .withColumns(
            {
                "window_id": F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), "asset_id", F.lit("-"), hour_text),
                "snapshot_ts": F.expr("timestampadd(HOUR, window_hour, __midnight)"),
                "month_number": F.month(day),
                "day_of_week": weekday,
                "is_weekend": weekday.isin(0, 6),
            }
        )
        .drop("__midnight", "full_date")
    )


def asset_window_snapshot(windows: DataFrame, downtime: DataFrame, maintenance: DataFrame, process: DataFrame) -> DataFrame:
    """History of each asset window: stops and works by end time, process state of the line by start time."""
    stops = EventSource(
        downtime,
        "event_end_ts",
        [
            Lookback("prior_7d_downtime_events", "count", days=7),
            Lookback("prior_7d_downtime_minutes", "sum", "duration_minutes", 7),
            Lookback("prior_30d_downtime_events", "count", days=30),
            Lookback("prior_30d_downtime_minutes", "sum", "duration_minutes", 30),
            Lookback("__last_stop", "last"),
        ],
    )
    works = EventSource(
        maintenance,
        "actual_end_ts",
        [
            Lookback("prior_7d_maintenance_events", "count", days=7),
            Lookback("prior_7d_maintenance_minutes", "sum", "duration_minutes", 7),
            Lookback("__last_work", "last"),
        ],
    )
    condition = EventSource(
        process,
        "process_start_ts",
        [
            Lookback("prior_mean_sensor_degradation", "avg", "sensor_degradation_index", 7),
            Lookback("prior_mean_tool_wear", "avg", "tool_wear_index", 7),
            Lookback("__last_process", "last"),
        ],
        closed="left",
    )
    past = lookback_agg(windows, [stops, works], "asset_id", "snapshot_ts", _STEP)
    past = lookback_agg(past, [condition], "line_id", "snapshot_ts", _STEP)
    return past.withColumns(
        {
            "hours_since_last_maintenance": hour_boundaries("__last_work", "snapshot_ts"),
            "feature_max_source_ts": F.greatest("__last_stop", "__last_work", "__last_process"),
        }
    ).drop("__last_stop", "__last_work", "__last_process")


def order_labels(order_rows: DataFrame) -> DataFrame:
    ready = F.col("last_end_ts").alias("target_available_at_ts")
    return order_rows.select("order_id", ready, "tbh", "fpy", "energy_per_good_tonne_kwh_t", "rework_rate", "scrap_rate")


def pivot_characteristics(quality: DataFrame, names: Sequence[str]) -> DataFrame:
    picked = [F.max(F.when(F.col("characteristic") == n, F.col("measured_value"))).alias(n) for n in names]
    return quality.groupBy(*tube_keys(quality)).agg(*picked)


DIMENSIONAL = ("outer_diameter_deviation_mm", "wall_eccentricity_pct", "ovality_pct")


def tube_labels(production: DataFrame, quality: DataFrame, energy: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    keys = tube_keys(production, quality, energy)
    used = energy.groupBy(*keys).agg(F.sum("energy_kwh").alias("__kwh"))
    return tube_label_rows(production.join(pivot_characteristics(quality, DIMENSIONAL), keys).join(used, keys), "__kwh", keep)


def tube_label_rows(tubes: DataFrame, energy: str, keep: Sequence[str] = ()) -> DataFrame:
    """The labels of tubes that have their characteristics and, in the column `energy`, their energy."""
    return tubes.select(
        *keep,
        "tube_id",
        F.col("actual_end_ts").alias("target_available_at_ts"),
        "actual_tph",
        "approved_first_pass",
        (F.col("disposition") == "REWORK").alias("is_rework"),
        (F.col("disposition") == "SCRAP").alias("is_scrap"),
        safe_ratio(energy, "good_mass_t").alias("energy_per_good_tonne_kwh_t"),
        *DIMENSIONAL,
    )


def next_window_labels(windows: DataFrame, downtime: DataFrame, coverage_end: Column) -> DataFrame:
    """Did the asset stop in the two hours after the snapshot; only windows the data fully covers."""
    covered = windows.select("window_id", "asset_id", "snapshot_ts").withColumn(
        "target_available_at_ts", add_seconds("snapshot_ts", str(_STEP))
    )
    covered = covered.filter(F.col("target_available_at_ts") <= coverage_end)
    aggs = [F.count(F.lit(1)).alias("__n"), F.sum("duration_minutes").alias("__m")]
    ahead = lookahead_agg(covered, downtime, "asset_id", "snapshot_ts", "event_start_ts", _STEP, aggs)
    return ahead.select(
        "window_id",
        "snapshot_ts",
        "target_available_at_ts",
        (F.coalesce("__n", F.lit(0)) > 0).alias("next_window_downtime_occurred"),
        F.coalesce("__m", F.lit(0.0)).alias("next_window_downtime_duration_minutes"),
    )


def select_xy(
    snapshot: DataFrame, labels: DataFrame, key: str, features: Sequence[str], targets: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, index and targets as three selections of keyed rows; the key, not row order, links them."""
    sample = F.col(key).alias("sample_key")
    x = snapshot.select(sample, *features)
    index = snapshot.select(sample, F.col(key).cast("string").alias("entity_id"), "snapshot_ts", "feature_max_source_ts")
    y = labels.select(sample, "target_available_at_ts", *targets)
    return x, index, y


def period_of(df: DataFrame, ts: str, pattern: str = "yyyyMMdd") -> DataFrame:
    return df.withColumn("date_key", period_key(ts, pattern))
