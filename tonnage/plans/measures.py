"""Business measures that can be evaluated under any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.functions.scalar import capped, safe_ratio

MECHANICAL = ("yield_strength_mpa", "tensile_strength_mpa")


def _weighted(value: str, weight: str, where: Column | None = None) -> Column:
    w = F.col(weight) if where is None else F.when(where, F.col(weight))
    return safe_ratio(F.sum(F.col(value) * w), F.sum(w))


def _availability() -> Column:
    hours = F.sum("productive_hours")
    return safe_ratio(hours, hours + F.sum("unplanned_downtime_minutes") / 60.0)


def _performance() -> Column:
    return capped(safe_ratio(F.sum("total_tonnes"), F.lit(42.0) * F.sum("productive_hours")), 1.0)


def _quality() -> Column:
    return safe_ratio(F.sum("good_tonnes"), F.sum("total_tonnes"))


# measure name -> aggregate over the mart named in the comment
LINE_SHIFT_MEASURES = {
    "good_tonnes": lambda: F.sum("good_tonnes"),
    "productive_hours": lambda: F.sum("productive_hours"),
    "energy_kwh": lambda: F.sum("energy_kwh"),
    "downtime_minutes": lambda: F.sum("unplanned_downtime_minutes"),
    "tbh": lambda: safe_ratio(F.sum("good_tonnes"), F.sum("productive_hours")),
    "energy_per_good_tonne": lambda: safe_ratio(F.sum("energy_kwh"), F.sum("good_tonnes")),
    "fpy": lambda: _weighted("fpy", "tube_count"),
    "scrap_rate": lambda: _weighted("scrap_rate", "tube_count"),
    "rework_rate": lambda: _weighted("rework_rate", "tube_count"),
    "availability": _availability,
    "performance": _performance,
    "quality": _quality,
    "oee": lambda: _availability() * _performance() * _quality(),
}
QUALITY_MEASURES = {
    "characteristic_mean": lambda: _weighted("mean_value", "inspection_count"),
    "mechanical_conformance": lambda: _weighted(
        "conformance_rate", "inspection_count", F.col("characteristic").isin(*MECHANICAL)
    ),
}
PREDICTION_MEASURES = {"next_window_downtime_probability": lambda: F.avg("calibrated_probability")}

ALL_MEASURES = {**LINE_SHIFT_MEASURES, **QUALITY_MEASURES, **PREDICTION_MEASURES}


def measure(df: DataFrame, names: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Evaluate measures over a mart; any number of them share one aggregation."""
    wanted = [names] if isinstance(names, str) else list(names)
    aggs = [ALL_MEASURES[n]().alias(n) for n in wanted]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
