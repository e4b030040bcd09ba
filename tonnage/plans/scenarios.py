"""Scenario analytics: supported envelopes, distance guard, constraints, Pareto alternatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import bands, safe_ratio
from tonnage.operators.neighbours import knn_distance
from tonnage.operators.ordered import exact_quantiles, row_numbers

WEAR_EDGES = (0.0, 0.25, 0.50, 0.75, 1.01)

# fixed values: hard limits of a scenario
LIMITS = {
    "max_quality_failure_probability": 0.25,
    "max_downtime_probability": 0.30,
    "max_expected_downtime_minutes": 20.0,
    "max_throughput_interval_width": 8.0,
    "max_energy_interval_width": 60.0,
    "max_abs_outer_diameter_deviation_mm": 1.20,
    "max_wall_eccentricity_pct": 3.50,
    "max_ovality_pct": 2.50,
}

# constraint -> (observed value, limit); the distance ratio is limited to one
CONSTRAINTS = {
    "historical_distance": ("distance_ratio", None),
    "quality_failure_probability": ("quality_failure_probability", "max_quality_failure_probability"),
    "downtime_probability": ("downtime_probability", "max_downtime_probability"),
    "expected_downtime_minutes": ("expected_downtime_minutes", "max_expected_downtime_minutes"),
    "throughput_interval_width": ("throughput_interval_width", "max_throughput_interval_width"),
    "energy_interval_width": ("energy_interval_width", "max_energy_interval_width"),
    "outer_diameter_deviation": ("max_abs_outer_diameter_deviation", "max_abs_outer_diameter_deviation_mm"),
    "wall_eccentricity": ("wall_eccentricity_p90", "max_wall_eccentricity_pct"),
    "ovality": ("ovality_p90", "max_ovality_pct"),
}


def wear_band(value, edges: Sequence[float] = WEAR_EDGES) -> Column:
    return bands(value, edges, [f"wear_{i}" for i in range(len(edges) - 1)])


def long_controls(df: DataFrame, keys: Sequence[str], controls: Sequence[str]) -> DataFrame:
    """keys, control, value."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("control"), F.col(c).cast("double").alias("value")) for c in controls])))


def control_ranges(support: DataFrame, by: Sequence[str], controls: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """P02 / P98 of every control per support group."""
    return exact_quantiles(long_controls(support, by, controls), [*by, "control"], "value", {"p_low": low, "p_high": high})


def envelopes(
    ranges: DataFrame, contexts: DataFrame, by: Sequence[str], controls: Sequence[str], limits: Mapping[str, tuple[float, float]], change: Mapping[str, float]
) -> DataFrame:
    """Decision range of each control around the current value of a context, with a refusal reason.

    The historical range is cut by the internal limits; the decision range is current +- fraction of its span.
    """
    current = long_controls(contexts, by, controls).withColumnRenamed("value", "current_value")
    spec = F.create_map(*[x for c in controls for x in (F.lit(c), F.struct(F.lit(float(limits[c][0])).alias("lo"), F.lit(float(limits[c][1])).alias("hi"), F.lit(float(change[c])).alias("f")))])
    rows = current.join(ranges, [*by, "control"]).withColumn("__s", spec[F.col("control")])
    rows = rows.withColumns({"lower": F.greatest("p_low", "__s.lo"), "upper": F.least("p_high", "__s.hi")})
    reach = (F.col("upper") - F.col("lower")) * F.col("__s.f")
    rows = rows.withColumns({
        "max_absolute_change": reach,
        "decision_lower": F.greatest(F.col("lower"), F.col("current_value") - reach),
        "decision_upper": F.least(F.col("upper"), F.col("current_value") + reach),
    })
    outside = ~F.col("current_value").between(F.col("lower"), F.col("upper"))
    status = F.when(outside, "OUTSIDE").when(F.col("decision_upper") <= F.col("decision_lower"), "COLLAPSED").otherwise("OK")
    return rows.withColumn("status", status).drop("__s", "p_low", "p_high")


def scaled_vectors(rows: DataFrame, ranges: DataFrame, by: Sequence[str], key: str, controls: Sequence[str], out: str = "vector") -> DataFrame:
    """(x - P02) / (P98 - P02) per control as one array in control order; the width is at least 1e-12."""
    wide = ranges.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("control", F.struct("p_low", "p_high").alias("r")))).alias("__r"))
    joined = rows.join(wide, list(by))
    scaled = [(F.col(c).cast("double") - F.col("__r")[c]["p_low"]) / F.greatest(F.col("__r")[c]["p_high"] - F.col("__r")[c]["p_low"], F.lit(1e-12)) for c in controls]
    return joined.select(*by, key, F.array(*scaled).alias(out))


def distance_thresholds(support: DataFrame, by: Sequence[str], key: str, k: int = 5, q: float = 0.95, multiplier: float = 1.0) -> DataFrame:
    """P95 of the support's own neighbour distances; k + 1 because each row finds itself first."""
    return threshold(knn_distance(support, support, by, key, key, "vector", k + 1), by, "distance", q, multiplier)


def threshold(own: DataFrame, by: Sequence[str], distance: str, q: float = 0.95, multiplier: float = 1.0) -> DataFrame:
    """P95 of known neighbour distances of the support."""
    limits = exact_quantiles(own, by, distance, {"distance_threshold": q})
    return limits.withColumn("distance_threshold", F.col("distance_threshold") * F.lit(multiplier))


def assess(
    candidates: DataFrame, bounds: DataFrame, distances: DataFrame, thresholds: DataFrame, by: Sequence[str], key: str, controls: Sequence[str]
) -> DataFrame:
    """Range violation, distance ratio and the in-distribution verdict of every candidate."""
    long = long_controls(candidates, [*by, key], controls).join(bounds.select(*by, "control", "decision_lower", "decision_upper"), [*by, "control"])
    span = F.greatest(F.col("decision_upper") - F.col("decision_lower"), F.lit(1e-12))
    over = F.greatest(F.col("decision_lower") - F.col("value"), F.col("value") - F.col("decision_upper"), F.lit(0.0)) / span
    worst = long.groupBy(*by, key).agg(F.max(over).alias("range_violation"))
    rows = worst.join(distances, [*by, key]).join(thresholds, list(by))
    ratio = F.col("distance") / F.greatest(F.col("distance_threshold"), F.lit(1e-12))
    inside = F.col("range_violation") <= 1e-12
    return rows.withColumns({"distance_ratio": ratio, "within_conditional_bounds": inside, "in_distribution": inside & (ratio <= 1.0)})


def score_scenarios(df: DataFrame, limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """Derived measures, nine constraint values and the hard verdict from predicted quantiles and risks."""
    scored = df.withColumns({
        "estimated_fpy": F.lit(1.0) - F.col("quality_failure_probability"),
        "estimated_tbh_proxy": F.col("throughput_p50") * (F.lit(1.0) - F.col("quality_failure_probability")),
        "expected_downtime_minutes": F.col("downtime_probability") * F.col("downtime_duration_p50"),
        "throughput_interval_width": F.col("throughput_p90") - F.col("throughput_p10"),
        "energy_interval_width": F.col("energy_p90") - F.col("energy_p10"),
        "max_abs_outer_diameter_deviation": F.greatest(F.abs("outer_diameter_deviation_p10"), F.abs("outer_diameter_deviation_p90")),
    })
    margins = {f"constraint_{n}": F.col(value) - F.lit(1.0 if limit is None else limits[limit]) for n, (value, limit) in CONSTRAINTS.items()}
    scored = scored.withColumns(margins)
    worst = F.greatest(*margins)
    return scored.withColumn("hard_constraints_pass", (worst <= 1e-9) & F.col("within_conditional_bounds"))


OBJECTIVES = {
    "objective_negative_tbh_proxy": lambda: -F.col("estimated_tbh_proxy"),
    "objective_quality_risk": lambda: F.col("quality_failure_probability"),
    "objective_energy": lambda: F.col("energy_p50"),
    "objective_downtime_risk": lambda: F.col("downtime_probability"),
    "objective_expected_downtime": lambda: F.col("expected_downtime_minutes"),
}


def with_objectives(df: DataFrame, intervention: Column) -> DataFrame:
    return df.withColumns({n: make() for n, make in OBJECTIVES.items()} | {"objective_intervention_magnitude": intervention})


def constraint_table(scored: DataFrame, key: str, limits: Mapping[str, float] = LIMITS, tightest: int | None = None) -> DataFrame:
    """name, observed, maximum, margin, status per scenario; optionally its few tightest constraints."""
    parts = []
    for name, (value, limit) in CONSTRAINTS.items():
        top = F.lit(1.0 if limit is None else float(limits[limit]))
        status = F.when(F.col(value) <= top + 1e-9, "PASS").otherwise("FAIL")
        parts.append(F.struct(F.lit(name).alias("name"), F.col(value).alias("observed"), top.alias("maximum"), (top - F.col(value)).alias("margin"), status.alias("status")))
    long = scored.select(key, F.inline(F.array(*parts)))
    if tightest is None:
        return long
    order = Window.partitionBy(key).orderBy("margin", "name")  # nine rows per scenario
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= tightest)


def intervention(controls: Sequence[str], current: Mapping[str, str], lower: Mapping[str, str], upper: Mapping[str, str]) -> Column:
    """Mean absolute change over the decision span of each control."""
    terms = [F.abs(F.col(c) - F.col(current[c])) / F.greatest(F.col(upper[c]) - F.col(lower[c]), F.lit(1e-12)) for c in controls]
    return sum(terms[1:], terms[0]) / F.lit(float(len(terms)))


def feasible_distinct(scored: DataFrame, controls: Sequence[str], key: str | None = None) -> DataFrame:
    """Passing scenarios, one per distinct control setting: the one with the least `key`, where one is given."""
    feasible = scored.filter("hard_constraints_pass")
    if key is None:
        return feasible.dropDuplicates(list(controls))
    return feasible.join(feasible.groupBy(*controls).agg(F.min(key).alias(key)).select(key), key, "left_semi")


def normalised(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), prefix: str = "n_") -> DataFrame:
    """Min-max scaling over the front; a constant column becomes zero."""
    spans = df.groupBy(*by) if by else df.groupBy()
    stats = spans.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    if by:
        joined = df.join(stats, list(by))
    else:
        joined = df.withColumns({n: stats.select(n).scalar() for n in stats.columns})
    out = {}
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        out[f"{prefix}{c}"] = (F.col(c) - F.col(f"__lo_{c}")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return joined.withColumns(out).drop(*stats.columns if not by else [n for n in stats.columns if n not in by])


def alternative_scores(front: DataFrame, objectives: Sequence[str], uncertainty: Sequence[str], distance: str, change: str, by: Sequence[str] = ()) -> DataFrame:
    """Three scores (lower is better): productivity, conservative, balanced. The first objective is throughput."""
    df = normalised(front, [*objectives, *uncertainty], by)
    risks = [F.col(f"n_{c}") for c in objectives[1:-1]]
    spread = sum((F.col(f"n_{c}") for c in uncertainty[1:]), F.col(f"n_{uncertainty[0]}")) / F.lit(float(len(uncertainty)))
    conservative = sum(risks[1:], risks[0]) + spread + F.greatest(F.col(distance), F.lit(0.0)) + F.col(change)
    squares = [F.col(f"n_{c}") * F.col(f"n_{c}") for c in objectives]
    scores = {"productivity": F.col(objectives[0]), "conservative": conservative, "balanced": F.sqrt(sum(squares[1:], squares[0]))}
    return df.withColumns(scores).drop(*[f"n_{c}" for c in (*objectives, *uncertainty)])


def select_alternatives(scores: DataFrame, key: str, by: Sequence[str], signature: Sequence[str], is_current: str | None = None) -> DataFrame:
    """productivity, then conservative, then balanced: best unused row with an unused rounded outcome.

    When every unused row repeats a chosen outcome, the best unused row is taken anyway. Picks are one row per
    group, so each step is an aggregate and a small join.
    """
    by = list(by)
    sig = F.concat_ws("|", *[F.format_string("%.8f", F.round(F.col(c), 8)) for c in signature])
    pool = scores.withColumn("__sig", sig).withColumn("__current", F.col(is_current) if is_current else F.lit(False))
    chosen = None
    for label in ("productivity", "conservative", "balanced"):
        rest = pool
        if chosen is not None:
            rest = rest.join(chosen.select(*by, key), [*by, key], "left_anti")
            used = chosen.select(*by, "__sig").distinct().withColumn("__seen", F.lit(True))
            rest = rest.join(used, [*by, "__sig"], "left")
        else:
            rest = rest.withColumn("__seen", F.lit(None).cast("boolean"))
        again = F.coalesce("__seen", F.lit(False)) | F.col("__current")
        best = rest.groupBy(*by).agg(F.min(F.struct(again.alias("again"), F.col(label).alias("score"), F.col(key).alias("k"), F.col("__sig").alias("sig"))).alias("m"))
        pick = best.select(*by, F.lit(label).alias("scenario_label"), F.col("m.k").alias(key), F.col("m.score").alias("score"), F.col("m.sig").alias("__sig"))
        chosen = pick if chosen is None else chosen.unionByName(pick)
    return chosen.drop("__sig")


def nearest_to_median(df: DataFrame, by: Sequence[str], key: str, first: str, second: str, first_limit: float, second_limit: float) -> DataFrame:
    """Per group the feasible row closest to the medians of its feasible rows, distances scaled by the limits."""
    centre = exact_quantiles(df, by, first, {"__m1": 0.5}).join(exact_quantiles(df, by, second, {"__m2": 0.5}), list(by))
    gap = F.abs(F.col(first) - F.col("__m1")) / F.lit(max(first_limit, 1e-12)) + F.abs(F.col(second) - F.col("__m2")) / F.lit(max(second_limit, 1e-12))
    scored = df.join(centre, list(by)).withColumn("score", gap)
    best = scored.groupBy(*by).agg(F.min(F.struct("score", F.col(key).alias("k"))).alias("m"))
    return best.select(*by, F.col("m.k").alias(key), F.col("m.score").alias("score"))


def medoids(df: DataFrame, by: Sequence[str], key: str, controls: Sequence[str], min_support: int = 150, keep: int = 100) -> DataFrame:
    """Rows nearest the group's median point in standardised controls; groups need enough rows."""
    long = long_controls(df, [*by, key], controls)
    middle = exact_quantiles(long, [*by, "control"], "value", {"__median": 0.5})
    spread = long.groupBy(*by, "control").agg(F.stddev_pop("value").alias("__sd"))
    centred = long.join(middle.join(spread, [*by, "control"]), [*by, "control"])
    z = (F.col("value") - F.col("__median")) / F.greatest(F.col("__sd"), F.lit(1e-12))
    distance = centred.groupBy(*by, key).agg(F.avg(z * z).alias("distance"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support)
    ranked = row_numbers(distance.join(sizes, list(by)), by, "distance", key, name="rank")
    return ranked.filter(F.col("rank") <= keep)


def generate_candidates(contexts: DataFrame, support: DataFrame, bounds: DataFrame, by: Sequence[str], key: str, controls: Sequence[str],
                        nearest: DataFrame, alphas: Sequence[float] = (0.15, 0.55, 0.95)) -> DataFrame:
    """Steps from the current setting towards near support rows, clipped to the decision range (long form).

    `nearest`: by, key of the support rows to step towards.
    """
    current = long_controls(contexts, by, controls).withColumnRenamed("value", "__now")
    near = long_controls(support.join(nearest.select(*by, key), [*by, key], "left_semi"), [*by, key], controls)
    rows = near.join(current, [*by, "control"]).join(bounds.select(*by, "control", "decision_lower", "decision_upper"), [*by, "control"])
    rows = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    step = F.col("__now") + F.col("alpha") * (F.col("value") - F.col("__now"))
    return rows.select(*by, key, "alpha", "control", F.least(F.greatest(step, F.col("decision_lower")), F.col("decision_upper")).alias("value"))


def ood_probes(contexts: DataFrame, bounds: DataFrame, by: Sequence[str], first_control: str, fraction: float = 0.05) -> DataFrame:
    """Context rows with the first control pushed past its upper bound; every one must be refused."""
    edge = bounds.filter(F.col("control") == first_control).select(*by, "decision_lower", "decision_upper")
    pushed = F.col("decision_upper") + F.lit(fraction) * (F.col("decision_upper") - F.col("decision_lower"))
    return contexts.join(edge, list(by)).withColumn(first_control, pushed).drop("decision_lower", "decision_upper")


def top_changes(df: DataFrame, key: str, controls: Sequence[str], current: Mapping[str, float], reach: Mapping[str, float], n: int = 3) -> DataFrame:
    """Largest parameter changes relative to what is allowed; ties by name."""
    parts = [F.struct(F.lit(c).alias("control"), (F.abs(F.col(c) - F.lit(current[c])) / F.lit(max(reach[c], 1e-12))).alias("normalised_change")) for c in controls]
    long = df.select(key, F.inline(F.array(*parts)))
    order = Window.partitionBy(key).orderBy(F.col("normalised_change").desc(), "control")  # one row per control
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def context_fingerprint(df: DataFrame, controls: Sequence[str]) -> DataFrame:
    """Hash of every non-control feature in name order; alternatives of one context must share it."""
    fixed = sorted(c for c in df.columns if c not in controls)
    return df.withColumn("context_hash", F.sha2(F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}), 256))


def risk_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, list(columns), "risk", "value")


def error_widths(df: DataFrame) -> DataFrame:
    return df.withColumns({"lower_error": F.col("p50") - F.col("p10"), "upper_error": F.col("p90") - F.col("p50")})


def relative_gap(a: str, b: str) -> Column:
    return safe_ratio(F.col(a) - F.col(b), F.col(b))
