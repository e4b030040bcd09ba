"""Column expressions shared by every plan. All of them stay inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_ratio(numerator, denominator) -> Column:
    """Quotient that is null, never an error, on a zero or null denominator."""
    return F.try_divide(_col(numerator), _col(denominator))


def capped(value, high: float) -> Column:
    """Upper bound; `least` ignores nulls, so an unknown value becomes the cap itself."""
    return F.least(_col(value), F.lit(float(high)))


def floored(value, low: float) -> Column:
    return F.greatest(_col(value), F.lit(float(low)))


def flag(condition: Column) -> Column:
    """Boolean as 0/1 so that `avg` is a rate and `sum` a count."""
    return condition.cast("int")


def period_key(ts, pattern: str = "yyyyMMdd") -> Column:
    """Integer calendar key; `yyyyMM` gives a month key."""
    return F.date_format(_col(ts), pattern).cast("int")


def hour_boundaries(start, end) -> Column:
    """Number of hour marks crossed between two instants (not elapsed full hours)."""
    first, last = F.date_trunc("hour", _col(start)), F.date_trunc("hour", _col(end))
    return F.floor((epoch_micros(last) - epoch_micros(first)) / F.lit(3_600_000_000)).cast("long")


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch for both timestamp kinds (UTC session)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def shift_start_hour(ts_or_hour, is_hour: bool = False, hours: int = 8) -> Column:
    hour = _col(ts_or_hour) if is_hour else F.hour(_col(ts_or_hour))
    return (F.floor(hour / hours) * hours).cast("int")


def add_seconds(ts: str, seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {seconds}, {ts})")


def hash_id(prefix: str, parts: Iterable, length: int = 20) -> Column:
    """Repeatable identifier: prefix, then the leading hex digits of SHA-256 over the joined parts."""
    joined = F.concat_ws("|", *[_col(part).cast("string") for part in parts])
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(joined, 256), 1, length)))


def bands(value, edges: Sequence[float], labels: Sequence[str] | None = None, right: bool = False) -> Column:
    """Interval label; left-closed by default, right-closed with `right=True`. Outside is null."""
    column = _col(value).cast("double")
    names = list(labels) if labels else [str(i) for i in range(len(edges) - 1)]
    expression = None
    for name, low, high in zip(names, edges[:-1], edges[1:]):
        low_ok = F.lit(True) if low == float("-inf") else (column > low if right else column >= low)
        high_ok = F.lit(True) if high == float("inf") else (column <= high if right else column < high)
        inside = column.isNotNull() & low_ok & high_ok
        expression = F.when(inside, name) if expression is None else expression.when(inside, name)
    return expression


def equal_bins(value, bins: int) -> Column:
    """Bin number 0..bins-1 of [0, 1], decided by comparison with the float edges themselves."""
    column = _col(value)
    number = F.lit(0)
    for step in range(1, bins):
        number = number + flag(column >= F.lit(step / bins))
    return number


def safe_corr(x, y) -> Column:
    """Pearson correlation as an aggregate; null when either side is constant."""
    left, right = _col(x).cast("double"), _col(y).cast("double")
    both = left.isNotNull() & right.isNotNull()
    a, b = F.when(both, left), F.when(both, right)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def close_to(left, right, relative: float = 1e-12, absolute: float = 1e-8) -> Column:
    """True when two measures agree within a relative or absolute tolerance."""
    a, b = _col(left), _col(right)
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def strip_prefix(value, prefix: str) -> Column:
    return F.regexp_replace(F.lower(_col(value)), f"^{re.escape(prefix.lower())}", "")


NUDGE = 1.000000000001


def rounded(df: DataFrame, digits: int = 6, coarse: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (`coarse` overrides the digits by name) so that results compare across engines.

    Sums of two-decimal prices often sit exactly on a rounding tie, where the last bit of the sum (and so the
    summation order) would decide. The nudge moves ties off that point, far above float noise.
    """
    names = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    places = {n: digits for n in names} | (coarse or {})
    return df.select(
        *[(F.round(F.col(c) * F.lit(NUDGE), places[c]) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def text_ts(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other; the key columns come from the left side."""
    if not on:
        raise ValueError("a join needs at least one key")
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = None
    for c in on:
        term = left[c].eqNullSafe(renamed[f"__r_{c}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{c}" for c in on])
