"""Point-in-time joins: last value before an instant, and sliding look-back / look-ahead aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import epoch_micros, null_safe_join
from tonnage.operators.ordered import running


def asof_last(
    grid: DataFrame, events: DataFrame, on: Sequence[str], grid_ts: str, event_ts: str, out: str, inclusive: bool = True
) -> DataFrame:
    """Add `out`: the latest `event_ts` at or before `grid_ts` (strictly before with `inclusive=False`).

    Anchors and events are first reduced to distinct (key, instant) pairs; the running maximum then works in
    time ranges of equal row count, so one hot key spreads over many tasks.
    """
    on = list(on)
    late = 0 if inclusive else 1
    anchors = grid.select(*on, epoch_micros(grid_ts).alias("__at"), F.lit(None).cast("long").alias("__seen"))
    marks = events.select(*on, (epoch_micros(event_ts) + late).alias("__at"), epoch_micros(event_ts).alias("__seen"))
    marks = marks.filter(F.col("__at").isNotNull())
    known = running(anchors.unionByName(marks), on, "__at", {"__seen": ("max", "__seen")})
    looked = null_safe_join(grid.withColumn("__at", epoch_micros(grid_ts)), known, [*on, "__at"], "left")
    kind = events.schema[event_ts].dataType.typeName()
    value = F.timestamp_micros("__seen")
    return looked.withColumn(out, value.cast("timestamp_ntz") if kind == "timestamp_ntz" else value).drop("__at", "__seen")


@dataclass(frozen=True)
class Lookback:
    """One aggregate over the events of the last `days` (None: all earlier ones)."""

    name: str
    agg: str  # count | sum | avg | last
    column: str | None = None
    days: float | None = None


@dataclass(frozen=True)
class EventSource:
    events: DataFrame
    event_ts: str
    specs: Sequence[Lookback] = field(default_factory=tuple)
    closed: str = "right"  # right: (t-d, t]; left: [t-d, t)


def step_index(ts, step_seconds: int, closed: str) -> Column:
    """Number of the grid step at which an event becomes part of the past."""
    micros = epoch_micros(ts)
    step = step_seconds * 1_000_000
    if closed == "right":
        return F.ceil(micros / F.lit(step)).cast("long")
    return (F.floor(micros / F.lit(step)) + 1).cast("long")


def lookback_agg(grid: DataFrame, sources: Sequence[EventSource], on: str, grid_ts: str, step_seconds: int) -> DataFrame:
    """Sliding aggregates at instants that lie on multiples of `step_seconds`.

    Because window borders fall on grid steps, events collapse to one partial row per (key, step) before the
    shuffle. A hot key therefore costs one row per step of calendar time, however many events it has.
    """
    step = step_seconds * 1_000_000
    ticks = grid.select(on, F.expr(f"unix_micros(CAST({grid_ts} AS TIMESTAMP)) div {step}").alias("__step")).distinct()
    parts = [ticks.withColumn("__tick", F.lit(True))]
    for i, source in enumerate(sources):
        binned = source.events.withColumn("__step", step_index(source.event_ts, step_seconds, source.closed))
        columns = sorted({s.column for s in source.specs if s.column and s.agg in ("sum", "avg")})
        aggs = [F.count(F.lit(1)).alias(f"__{i}_n"), F.max(epoch_micros(source.event_ts)).alias(f"__{i}_last")]
        for c in columns:
            aggs += [F.sum(c).alias(f"__{i}_sum_{c}"), F.count(c).alias(f"__{i}_cnt_{c}")]
        parts.append(binned.filter(F.col("__step").isNotNull()).groupBy(on, "__step").agg(*aggs))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    # one row per (key, step) keeps the frames short
    values = [c for c in merged.columns if c not in (on, "__step")]
    merged = merged.groupBy(on, "__step").agg(*[F.max(c).alias(c) for c in values])

    base = Window.partitionBy(on).orderBy("__step")
    out = []
    for i, source in enumerate(sources):
        for s in source.specs:
            first = Window.unboundedPreceding if s.days is None else -(round(s.days * 86_400 / step_seconds) - 1)
            frame = base.rangeBetween(first, 0)
            if s.agg == "count":
                value = F.coalesce(F.sum(f"__{i}_n").over(frame), F.lit(0)).cast("long")
            elif s.agg == "sum":
                value = F.coalesce(F.sum(f"__{i}_sum_{s.column}").over(frame), F.lit(0.0))
            elif s.agg == "avg":
                value = F.try_divide(F.sum(f"__{i}_sum_{s.column}").over(frame), F.sum(f"__{i}_cnt_{s.column}").over(frame))
            elif s.agg == "last":
                value = F.timestamp_micros(F.max(f"__{i}_last").over(frame)).cast("timestamp_ntz")
            else:
                raise ValueError(f"unknown look-back aggregate {s.agg!r}")
            out.append(value.alias(s.name))
    answers = merged.select(on, "__step", "__tick", *out).filter("__tick").drop("__tick")
    keyed = grid.withColumn("__step", F.expr(f"unix_micros(CAST({grid_ts} AS TIMESTAMP)) div {step}"))
    return keyed.join(answers, [on, "__step"], "left").drop("__step")


def lookahead_agg(
    grid: DataFrame, events: DataFrame, on: str, grid_ts: str, event_ts: str, step_seconds: int, aggs: Sequence[Column]
) -> DataFrame:
    """Aggregates of the events in [t, t + step) for grid instants on step multiples; no event gives nulls."""
    step = step_seconds * 1_000_000
    ahead = events.withColumn("__step", F.expr(f"unix_micros(CAST({event_ts} AS TIMESTAMP)) div {step}"))
    ahead = ahead.groupBy(on, "__step").agg(*aggs)
    keyed = grid.withColumn("__step", F.expr(f"unix_micros(CAST({grid_ts} AS TIMESTAMP)) div {step}"))
    return keyed.join(ahead, [on, "__step"], "left").drop("__step")
