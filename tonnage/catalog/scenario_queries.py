"""Scenario, distance-guard, Pareto and sensor-window queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tonnage.catalog.base import VIEWS, cols, query, rnd, sql, view
from tonnage.catalog.star_queries import TS, texted
from tonnage.functions import scalar as S
from tonnage.operators.neighbours import knn_distance
from tonnage.operators.ordered import row_numbers
from tonnage.operators.skyline import skyline
from tonnage.plans import scenarios as sc
from tonnage.sources.scratch import scratch, written
from tonnage.sources.tables import read_documents, scenario_documents
from tonnage.streaming.windows import stream_window_summary, window_summary

CONTROLS = tuple(f"c{i:02d}" for i in range(1, 12))
BOUNDS = {c: (-0.25, 0.25) for c in CONTROLS}
CHANGE = {c: 0.15 if i < 6 else 0.12 for i, c in enumerate(CONTROLS)}
MIN_SUPPORT = 150

_C = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(CONTROLS))
view("emb", "", f"SELECT vec_id, label % 3 AS label, {_C} FROM embeddings")
view("emb_long", "emb", " UNION ALL ".join(f"SELECT vec_id, label, '{c}' AS control, {c} AS value FROM emb" for c in CONTROLS))
view("ranges", "emb_long", "SELECT label, control, quantile_cont(value, 0.02) AS p_low, quantile_cont(value, 0.98) AS p_high, median(value) AS mid, stddev_pop(value) AS sd FROM emb_long GROUP BY 1, 2")
view("medoid", "emb_long ranges", f"""SELECT m.*, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM (
  SELECT label, vec_id, avg(((value - mid) / greatest(sd, 1e-12)) * ((value - mid) / greatest(sd, 1e-12))) AS distance FROM emb_long JOIN ranges USING (label, control) GROUP BY 1, 2) m
  JOIN (SELECT label, count(*) AS support FROM emb GROUP BY 1 HAVING count(*) >= {MIN_SUPPORT}) s USING (label)""".replace("FROM emb GROUP", "FROM (SELECT DISTINCT label, vec_id FROM emb_long) d GROUP"))
_F = "CASE " + " ".join(f"WHEN control = '{c}' THEN {f}::DOUBLE" for c, f in CHANGE.items()) + " END"
view("bounds", "emb_long ranges medoid", f"""SELECT *, greatest(lower, current_value - reach) AS decision_lower, least(upper, current_value + reach) AS decision_upper,
  CASE WHEN NOT current_value BETWEEN lower AND upper THEN 'OUTSIDE' WHEN least(upper, current_value + reach) <= greatest(lower, current_value - reach) THEN 'COLLAPSED' ELSE 'OK' END AS status
  FROM (SELECT *, (upper - lower) * {_F} AS reach FROM (SELECT e.label, e.control, e.value AS current_value, greatest(p_low, -0.25::DOUBLE) AS lower, least(p_high, 0.25::DOUBLE) AS upper
  FROM emb_long e JOIN medoid m ON m.vec_id = e.vec_id AND m.label = e.label AND m.rank = 1 JOIN ranges r ON r.label = e.label AND r.control = e.control) x) y""")
view("scaled", "emb_long ranges", "SELECT label, vec_id, list((value - p_low) / greatest(p_high - p_low, 1e-12) ORDER BY control) AS v FROM emb_long JOIN ranges USING (label, control) GROUP BY 1, 2")
view("shifted", "emb_long ranges", "SELECT label, vec_id, list((value + CASE WHEN control = 'c01' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END - p_low) / greatest(p_high - p_low, 1e-12) ORDER BY control) AS v FROM emb_long JOIN ranges USING (label, control) GROUP BY 1, 2")


# the operating points of each label by itself, all ten of them
LABEL_SUPPORT = 30
view("label_emb", "", f"SELECT vec_id, label, {_C} FROM embeddings")
for _name in ("emb_long", "ranges", "medoid", "bounds"):
    _needs, _body = VIEWS[_name]
    for _view in ("emb_long", "emb", "ranges", "medoid"):
        _body = re.sub(rf"\b(FROM|JOIN) {_view}\b", rf"\1 label_{_view}", _body)
    view(f"label_{_name}", " ".join(f"label_{n}" for n in _needs), _body.replace(f">= {MIN_SUPPORT}", f">= {LABEL_SUPPORT}"))


def _knn(points: str, k: int) -> str:
    return (f"SELECT label, vec_id, d AS distance FROM (SELECT a.label, a.vec_id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS r "
            f"FROM {points} a JOIN scaled b ON a.label = b.label) x WHERE r = {k}")


view("own_knn", "scaled", _knn("scaled", 6))
view("limit_d", "own_knn", "SELECT label, quantile_cont(distance, 0.95) AS distance_threshold FROM own_knn GROUP BY 1")


def _assess_sql(shift: str, points: str) -> str:
    return f"""SELECT v.label, v.vec_id, range_violation, distance / greatest(distance_threshold, 1e-12) AS distance_ratio, range_violation <= 1e-12 AND distance / greatest(distance_threshold, 1e-12) <= 1.0 AS in_distribution
  FROM (SELECT e.label, e.vec_id, max(greatest(decision_lower - (value{shift}), (value{shift}) - decision_upper, 0.0::DOUBLE) / greatest(decision_upper - decision_lower, 1e-12)) AS range_violation
        FROM emb_long e JOIN bounds b ON b.label = e.label AND b.control = e.control GROUP BY 1, 2) v
  JOIN ({_knn(points, 5)}) d ON d.vec_id = v.vec_id AND d.label = v.label JOIN limit_d t ON t.label = v.label"""


_SHIFT = " + CASE WHEN e.control = 'c01' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END"


def rows(b, families: int | None = 3):
    """Operating points by context: three families of labels, so that a context has the support it needs also in the small tables.
    Without `families` each label is a context."""
    label = F.col("label") if families is None else F.col("label") % families
    return b.table("embeddings").select("vec_id", label.alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(CONTROLS)])


def bounded(support, min_support: int):
    """ranges, contexts (one medoid per label with support) and decision bounds of operating points."""
    ranges = sc.control_ranges(support, ["label"], CONTROLS)
    best = sc.medoids(support, ["label"], "vec_id", CONTROLS, min_support).filter("rank = 1")
    contexts = support.join(best.select("label", "vec_id"), ["label", "vec_id"], "left_semi")
    return ranges, contexts, sc.envelopes(ranges, contexts.drop("vec_id"), ["label"], CONTROLS, BOUNDS, CHANGE)


def guard(b):
    """support rows, ranges, contexts (one medoid per label), decision bounds, scaled support."""
    support = rows(b)
    ranges, contexts, bounds = bounded(support, MIN_SUPPORT)
    return support, ranges, contexts, bounds, sc.scaled_vectors(support, ranges, ["label"], "vec_id", CONTROLS)


@query("sc1_wear_bands", sql("process", "SELECT tube_id, CASE WHEN tool_wear_index >= 0 AND tool_wear_index < 0.25 THEN 'wear_0' WHEN tool_wear_index >= 0.25 AND tool_wear_index < 0.5 THEN 'wear_1' WHEN tool_wear_index >= 0.5 AND tool_wear_index < 0.75 THEN 'wear_2' WHEN tool_wear_index >= 0.75 AND tool_wear_index < 1.01 THEN 'wear_3' END AS wear_band FROM process"))
def sc1(b):
    return b.process_parameters.select("tube_id", sc.wear_band("tool_wear_index").alias("wear_band"))


_SUPPORT = (("product_code", "grade_family", "line_id", "wear"), ("product_code", "grade_family", "line_id"), ("product_code", "grade_family"), ("grade_family", "line_id"))
view("worn", "tubes", "SELECT product_code, grade_family, line_id, CASE WHEN productive_hours < 5 THEN 'short' ELSE 'long' END AS wear FROM tubes")


@query("sc2_conditional_support", sql("worn", "SELECT product_code, grade_family, line_id, wear, CASE " + " ".join(f"WHEN n{i} >= 150 THEN {i + 1}" for i in range(4)) + " END AS level, CASE " + " ".join(f"WHEN n{i} >= 150 THEN n{i}" for i in range(4)) + " END AS support FROM (SELECT DISTINCT * FROM worn) c " + " ".join(
    f"LEFT JOIN (SELECT {', '.join(k)}, count(*) AS n{i} FROM worn GROUP BY ALL) s{i} USING ({', '.join(k)})" for i, k in enumerate(_SUPPORT))))
def sc2(b):
    from tonnage.operators.lookup import fallback_support

    worn = b.tubes.select("product_code", "grade_family", "line_id", S.bands("productive_hours", [float("-inf"), 5.0, float("inf")], ["short", "long"]).alias("wear"))
    return fallback_support(worn, worn.distinct(), _SUPPORT, 150)


@query("sc3_envelopes", sql("bounds", f"SELECT label, control, status, {cols('current_value lower upper decision_lower decision_upper', 6)} FROM bounds"))
def sc3(b):
    return S.rounded(guard(b)[3].select("label", "control", "status", "current_value", "lower", "upper", "decision_lower", "decision_upper"))


@query("sc4_quantile_scaling", sql("scaled", f"SELECT vec_id, {rnd('v[1]')} AS s01, {rnd('v[11]')} AS s11 FROM scaled"))
def sc4(b):
    support = rows(b)
    v = sc.scaled_vectors(support, sc.control_ranges(support, ["label"], CONTROLS), ["label"], "vec_id", CONTROLS)
    return S.rounded(v.select("vec_id", F.col("vector")[0].alias("s01"), F.col("vector")[10].alias("s11")))


@query("sc5_neighbour_distance", sql("own_knn", f"SELECT label, vec_id, {rnd('distance')} AS distance FROM own_knn"))
def sc5(b):
    scaled = guard(b)[4]
    return S.rounded(knn_distance(scaled, scaled, ["label"], "vec_id", "vec_id", "vector", 6))


@query("sc6_distance_threshold", sql("limit_d", f"SELECT label, {rnd('distance_threshold')} AS distance_threshold FROM limit_d"))
def sc6(b):
    return S.rounded(sc.distance_thresholds(guard(b)[4], ["label"], "vec_id"))


def _assessed(b, shift: float):
    support, ranges, _, bounds, scaled = guard(b)
    if not shift:  # the candidates are the support: one search gives their distances and those of the limit
        found = knn_distance(scaled, scaled, ["label"], "vec_id", "vec_id", "vector", {"distance": 5, "own": 6})
        return sc.assess(support, bounds, found.drop("own"), sc.threshold(found, ["label"], "own"), ["label"], "vec_id", CONTROLS)
    candidates = support.withColumn("c01", F.col("c01") + F.lit(shift))
    points = sc.scaled_vectors(candidates, ranges, ["label"], "vec_id", CONTROLS)
    distances = knn_distance(points, scaled, ["label"], "vec_id", "vec_id", "vector", 5)
    return sc.assess(candidates, bounds, distances, sc.distance_thresholds(scaled, ["label"], "vec_id"), ["label"], "vec_id", CONTROLS)


@query("sc7_distribution_check", sql("emb_long bounds shifted scaled limit_d", f"SELECT label, vec_id, {cols('range_violation distance_ratio', 6)}, in_distribution FROM ({_assess_sql(_SHIFT, 'shifted')}) a"))
def sc7(b):
    return S.rounded(_assessed(b, 0.01).select("label", "vec_id", "range_violation", "distance_ratio", "in_distribution"))


@query("sc20_batch_evaluation", sql("emb_long bounds scaled limit_d", f"SELECT CASE WHEN in_distribution THEN 'ELIGIBLE' ELSE 'REFUSED' END AS status, vec_id, {rnd('distance_ratio - 1.0::DOUBLE')} AS margin FROM ({_assess_sql('', 'scaled')}) a"))
def sc20(b):
    return S.rounded(_assessed(b, 0.0).select(F.when(F.col("in_distribution"), "ELIGIBLE").otherwise("REFUSED").alias("status"), "vec_id", (F.col("distance_ratio") - 1.0).alias("margin")))


@query("sc15_medoids", sql("label_medoid", f"SELECT label, vec_id, {rnd('distance')} AS distance, rank FROM label_medoid WHERE rank <= 100"))
def sc15(b):
    return S.rounded(sc.medoids(rows(b, None), ["label"], "vec_id", CONTROLS, LABEL_SUPPORT).select("label", "vec_id", "distance", "rank"))


@query("sc19_probes", sql("label_bounds", f"SELECT label, {rnd('decision_upper + 0.05::DOUBLE * (decision_upper - decision_lower)')} AS pushed, TRUE AS refused FROM label_bounds WHERE control = 'c01'"))
def sc19(b):
    _, contexts, bounds = bounded(rows(b, None), LABEL_SUPPORT)
    probes = sc.ood_probes(contexts, bounds, ["label"], "c01")
    checked = probes.join(bounds.filter("control = 'c01'").select("label", "decision_upper"), "label")
    return S.rounded(checked.select("label", F.col("c01").alias("pushed"), (F.col("c01") > F.col("decision_upper")).alias("refused")))


@query("sc21_candidates", sql("emb_long bounds scaled medoid", f"""SELECT label, vec_id, alpha, control, {rnd('least(greatest(current_value + alpha * (value - current_value), decision_lower), decision_upper)')} AS value
  FROM emb_long JOIN bounds USING (label, control) JOIN (SELECT s.label, s.vec_id, row_number() OVER (PARTITION BY s.label ORDER BY list_distance(s.v, c.v), s.vec_id) AS r FROM scaled s
    JOIN (SELECT label, v FROM scaled JOIN (SELECT label, vec_id FROM medoid WHERE rank = 1) m USING (label, vec_id)) c USING (label)) n USING (label, vec_id) CROSS JOIN (VALUES (0.15::DOUBLE), (0.55::DOUBLE), (0.95::DOUBLE)) a(alpha) WHERE r <= 20"""))
def sc21(b):
    support, _, contexts, bounds, scaled = guard(b)
    centre = scaled.join(contexts.select("label", "vec_id"), ["label", "vec_id"], "left_semi").select("label", F.col("vector").alias("__c"))
    gap = sum(((F.col("vector")[i] - F.col("__c")[i]) * (F.col("vector")[i] - F.col("__c")[i]) for i in range(1, len(CONTROLS))), (F.col("vector")[0] - F.col("__c")[0]) * (F.col("vector")[0] - F.col("__c")[0]))
    ranked = row_numbers(scaled.join(centre, "label").select("label", "vec_id", F.sqrt(gap).alias("d")), ["label"], "d", "vec_id", name="r")
    return S.rounded(sc.generate_candidates(contexts.drop("vec_id"), support, bounds, ["label"], "vec_id", CONTROLS, ranked.filter("r <= 20")))


# ---- scenario table: one predicted scenario per supplier, from its lines -------------------------
_SCEN = {
    "throughput_p10": "avg(l_quantity) * 0.9", "throughput_p50": "avg(l_quantity)", "throughput_p90": "avg(l_quantity) * 1.2", "quality_failure_probability": "avg(l_discount) * 4.9",
    "energy_p10": "avg(l_extendedprice) / 500.0 - 25.0", "energy_p50": "avg(l_extendedprice) / 500.0", "energy_p90": "avg(l_extendedprice) / 500.0 + 30.0",
    "outer_diameter_deviation_p10": "-avg(l_discount) * 20.0", "outer_diameter_deviation_p90": "avg(l_discount) * 23.0", "wall_eccentricity_p90": "avg(l_tax) * 85.0", "ovality_p90": "avg(l_quantity) / 11.0",
    "downtime_probability": "avg(l_tax) * 7.0", "downtime_duration_p50": "avg(l_extendedprice) / 900.0", "distance_ratio": "stddev_pop(l_quantity) / 14.6",
}
# fixed rounding first: every later comparison then sees the same numbers in both engines
view("scen", "", "SELECT *, throughput_p50 <= 27 AS within_conditional_bounds FROM (SELECT l_suppkey AS scenario_id, " + ", ".join(f"round(({e.replace('0.9', '0.9::DOUBLE')}) * 1.000000000001::DOUBLE, 6) AS {n}" for n, e in _SCEN.items()) + " FROM lineitem GROUP BY 1) x")
_CONS = {n: (v, "1.0" if k is None else str(sc.LIMITS[k])) for n, (v, k) in sc.CONSTRAINTS.items()}
view("scored", "scen", f"""SELECT *, {', '.join(f"{v} - {m}::DOUBLE AS constraint_{n}" for n, (v, m) in _CONS.items())}, greatest({', '.join(f"{v} - {m}::DOUBLE" for v, m in _CONS.values())}) <= 1e-9 AND within_conditional_bounds AS hard_constraints_pass,
  -estimated_tbh_proxy AS objective_negative_tbh_proxy, quality_failure_probability AS objective_quality_risk, energy_p50 AS objective_energy, downtime_probability AS objective_downtime_risk,
  expected_downtime_minutes AS objective_expected_downtime, abs(throughput_p50 - 25.5) / 25.5 AS objective_intervention_magnitude FROM (
  SELECT *, 1.0::DOUBLE - quality_failure_probability AS estimated_fpy, throughput_p50 * (1.0::DOUBLE - quality_failure_probability) AS estimated_tbh_proxy, downtime_probability * downtime_duration_p50 AS expected_downtime_minutes,
    throughput_p90 - throughput_p10 AS throughput_interval_width, energy_p90 - energy_p10 AS energy_interval_width, greatest(abs(outer_diameter_deviation_p10), abs(outer_diameter_deviation_p90)) AS max_abs_outer_diameter_deviation FROM scen) s""")
OBJECTIVES = (*sc.OBJECTIVES, "objective_intervention_magnitude")


def scenario_table(b):
    aggs = [(F.round(F.expr(e.replace("0.9", "0.9D").replace("1.2", "1.2D").replace("4.9", "4.9D").replace("20.0", "20.0D").replace("23.0", "23.0D").replace("85.0", "85.0D").replace("11.0", "11.0D")
             .replace("7.0", "7.0D").replace("500.0", "500.0D").replace("900.0", "900.0D").replace("14.6", "14.6D").replace("25.0", "25.0D").replace("30.0", "30.0D")) * F.lit(S.NUDGE), 6)).alias(n) for n, e in _SCEN.items()]
    return b.table("lineitem").groupBy(F.col("l_suppkey").alias("scenario_id")).agg(*aggs).withColumn("within_conditional_bounds", F.col("throughput_p50") <= 27)


def scored(b):
    df = sc.score_scenarios(scenario_table(b))
    return sc.with_objectives(df, F.abs(F.col("throughput_p50") - 25.5) / 25.5)


_SC8 = "estimated_fpy estimated_tbh_proxy expected_downtime_minutes throughput_interval_width energy_interval_width " + " ".join(f"constraint_{n}" for n in sc.CONSTRAINTS)


@query("sc8_scenario_scores", sql("scored", f"SELECT scenario_id, hard_constraints_pass, {cols(_SC8, 5)} FROM scored"))
def sc8(b):
    return S.rounded(scored(b).select("scenario_id", "hard_constraints_pass", *_SC8.split()), 5)


_BEATS = " AND ".join(f"o.{c} <= s.{c} + 1e-12" for c in OBJECTIVES) + " AND (" + " OR ".join(f"o.{c} < s.{c} - 1e-12" for c in OBJECTIVES) + ")"
# of feasible scenarios with equal controls the one with the smallest id stands for all
view("feasible", "scored", "SELECT * FROM scored WHERE hard_constraints_pass QUALIFY row_number() OVER (PARTITION BY throughput_p50, energy_p50 ORDER BY scenario_id) = 1")
view("front", "feasible", f"SELECT * FROM feasible s WHERE NOT EXISTS (SELECT 1 FROM feasible o WHERE {_BEATS})")

view("whole_front", "scored", f"SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE {_BEATS})")


def front(b):
    """Non-dominated ones of the distinct scenarios that keep all hard limits: nothing infeasible can be recommended."""
    table = written(scored(b), "scored")  # read by the filter, the choice of one per setting, and the front
    return skyline(sc.feasible_distinct(table, ["throughput_p50", "energy_p50"], "scenario_id"), OBJECTIVES, "scenario_id")


@query("sc9_pareto_front", sql("whole_front", f"SELECT scenario_id, {cols(' '.join(OBJECTIVES), 5)} FROM whole_front"))
def sc9(b):
    """Front of all scenarios, whether they keep the hard limits or not; recommendations (sc12) come from `front`."""
    return S.rounded(skyline(written(scored(b), "scored"), OBJECTIVES, "scenario_id").select("scenario_id", *OBJECTIVES), 5)


@query("sc9_line_skyline", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem JOIN (
  SELECT l_quantity, cheapest, min(cheapest) OVER (ORDER BY l_quantity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cheapest_above
  FROM (SELECT l_quantity, min(l_extendedprice) AS cheapest FROM lineitem GROUP BY 1) q) m USING (l_quantity)
  WHERE l_extendedprice = cheapest AND (cheapest_above IS NULL OR l_extendedprice < cheapest_above)""")
def sc9_lines(b):
    """Cheapest lines for their quantity, over the whole line table."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    lines = b.table("lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", key.alias("k"), F.col("l_extendedprice").alias("price"), (-F.col("l_quantity")).alias("less"))
    return skyline(lines, ["price", "less"], "k").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("dq30_front_is_nondominated", sql("front", f"SELECT count(*) AS dominated FROM front s WHERE EXISTS (SELECT 1 FROM front o WHERE {_BEATS})"))
def dq30(b):
    members = front(b)
    again = skyline(members, OBJECTIVES, "scenario_id")
    return members.join(again, "scenario_id", "left_anti").agg(F.count(F.lit(1)).alias("dominated"))


@query("sc10_feasible_set", sql("scored", "SELECT DISTINCT throughput_p50, energy_p50 FROM scored WHERE hard_constraints_pass"))
def sc10(b):
    return sc.feasible_distinct(scored(b), ["throughput_p50", "energy_p50"]).select("throughput_p50", "energy_p50")


@query("sc11_normalised", sql("scored", "SELECT scenario_id, " + ", ".join(f"{rnd(f'({c} - min({c}) OVER ()) / coalesce(NULLIF(max({c}) OVER () - min({c}) OVER (), 0), 1)')} AS n_{c}" for c in OBJECTIVES) + " FROM scored"))
def sc11(b):
    return S.rounded(sc.normalised(scored(b), OBJECTIVES).select("scenario_id", *[f"n_{c}" for c in OBJECTIVES]))


_N = lambda c: f"(({c} - min({c}) OVER ()) / coalesce(NULLIF(max({c}) OVER () - min({c}) OVER (), 0), 1))"
_UNC = ("throughput_interval_width", "energy_interval_width")
view("alt_scores", "front", f"""SELECT scenario_id, objective_negative_tbh_proxy AS productivity, {' + '.join(_N(c) for c in OBJECTIVES[1:-1])} + ({_N(_UNC[0])} + {_N(_UNC[1])}) / 2.0::DOUBLE + greatest(distance_ratio, 0.0::DOUBLE) + objective_intervention_magnitude AS conservative,
  sqrt({' + '.join(_N(c) + ' * ' + _N(c) for c in OBJECTIVES)}) AS balanced FROM front""")
view("alt1", "alt_scores", "SELECT scenario_id FROM alt_scores ORDER BY productivity, scenario_id LIMIT 1")
view("alt2", "alt_scores alt1", "SELECT scenario_id FROM alt_scores WHERE scenario_id NOT IN (SELECT scenario_id FROM alt1) ORDER BY conservative, scenario_id LIMIT 1")
view("alt3", "alt_scores alt1 alt2", "SELECT scenario_id FROM alt_scores WHERE scenario_id NOT IN (SELECT scenario_id FROM alt1 UNION ALL SELECT scenario_id FROM alt2) ORDER BY balanced, scenario_id LIMIT 1")


def alternatives(b):
    scores = written(sc.alternative_scores(written(front(b), "front"), OBJECTIVES, _UNC, "distance_ratio", "objective_intervention_magnitude"), "scores")
    return sc.select_alternatives(scores, "scenario_id", [], ["estimated_tbh_proxy", "quality_failure_probability", "energy_p50"])


@query("sc12_alternatives", sql("alt1 alt2 alt3", "SELECT 'productivity' AS scenario_label, scenario_id FROM alt1 UNION ALL SELECT 'conservative', scenario_id FROM alt2 UNION ALL SELECT 'balanced', scenario_id FROM alt3"))
def sc12(b):
    return alternatives(b).select("scenario_label", "scenario_id")


@query("sc13_intervention", sql("scen", f"SELECT scenario_id, {rnd('(abs(throughput_p50 - 25.5) / greatest(throughput_p90 - throughput_p10, 1e-12) + abs(energy_p50 - 105.0) / greatest(energy_p90 - energy_p10, 1e-12)) / 2.0::DOUBLE')} AS magnitude FROM scen"))
def sc13(b):
    df = scenario_table(b).withColumns({"now_t": F.lit(25.5), "now_e": F.lit(105.0)})
    size = sc.intervention(["throughput_p50", "energy_p50"], {"throughput_p50": "now_t", "energy_p50": "now_e"}, {"throughput_p50": "throughput_p10", "energy_p50": "energy_p10"}, {"throughput_p50": "throughput_p90", "energy_p50": "energy_p90"})
    return S.rounded(df.select("scenario_id", size.alias("magnitude")))


view("safe", "downtime", "SELECT downtime_event_id, line_id, sensor_degradation_index AS probability, duration_minutes FROM downtime WHERE sensor_degradation_index <= 0.3 AND sensor_degradation_index * duration_minutes <= 20")


@query("sc14_safe_context", sql("safe", f"""SELECT line_id, downtime_event_id, {rnd('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score, downtime_event_id) AS r FROM (
  SELECT s.*, abs(probability - m1) / 0.3::DOUBLE + abs(duration_minutes - m2) / 20.0::DOUBLE AS score FROM safe s JOIN (SELECT line_id, median(probability) AS m1, median(duration_minutes) AS m2 FROM safe GROUP BY 1) m USING (line_id)) x) y WHERE r = 1"""))
def sc14(b):
    d = b.downtime_events.select("downtime_event_id", "line_id", F.col("sensor_degradation_index").alias("probability"), "duration_minutes")
    safe = d.filter((F.col("probability") <= 0.3) & (F.col("probability") * F.col("duration_minutes") <= 20))
    return S.rounded(sc.nearest_to_median(safe, ["line_id"], "downtime_event_id", "probability", "duration_minutes", 0.3, 20.0))


_LONG = " UNION ALL ".join(f"SELECT scenario_id, '{n}' AS name, {v} AS observed, {m}::DOUBLE AS maximum, {m}::DOUBLE - {v} AS margin, CASE WHEN {v} <= {m}::DOUBLE + 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM scored" for n, (v, m) in _CONS.items())


@query("sc16_constraint_table", sql("scored", f"SELECT scenario_id, name, {cols('observed maximum margin', 5)}, status FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY margin, name) AS r FROM ({_LONG}) l) x WHERE r <= 3"))
def sc16(b):
    return S.rounded(sc.constraint_table(scored(b), "scenario_id", tightest=3).drop("rank"), 5)


_PARAMS = {"throughput_p50": (25.5, 3.0), "energy_p50": (105.0, 12.0), "ovality_p90": (2.3, 0.3), "wall_eccentricity_p90": (3.4, 0.4)}


@query("sc17_top_changes", sql("scen", f"SELECT scenario_id, control, {rnd('change')} AS normalised_change, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY change DESC, control) AS r FROM (" + " UNION ALL ".join(
    f"SELECT scenario_id, '{c}' AS control, abs({c} - {now}::DOUBLE) / {reach}::DOUBLE AS change FROM scen" for c, (now, reach) in _PARAMS.items()) + ") l) x WHERE r <= 3"))
def sc17(b):
    now, reach = {c: v[0] for c, v in _PARAMS.items()}, {c: v[1] for c, v in _PARAMS.items()}
    return S.rounded(sc.top_changes(scenario_table(b), "scenario_id", list(_PARAMS), now, reach))


@query("sc18_context_fingerprint")
def sc18(b):
    """Rows that differ in controls only share the hash of their fixed context."""
    df = b.table("part").select("p_brand", "p_type", "p_size", "p_retailprice")
    hashed = sc.context_fingerprint(df, ["p_size", "p_retailprice"])
    return hashed.groupBy("p_brand", "p_type").agg(F.countDistinct("context_hash").alias("hashes"), F.min("context_hash").alias("context_hash"))


# ---- scenario documents --------------------------------------------------------------------------
DOC = ("context_id string, scenario_label string, scenario_id long, parameters map<string, struct<value: double, current: double>>, "
       "prediction struct<throughput: struct<p10: double, p50: double, p90: double>, energy: struct<p10: double, p50: double, p90: double>, quality_failure_probability: double, downtime_probability: double>, "
       "distance_ratio double, in_distribution boolean, constraints array<struct<name: string, margin: double, status: string>>")


def documents(b):
    df = scored(b)
    params = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.struct(F.col(c).alias("value"), F.lit(now).alias("current")).alias("v")) for c, (now, _) in _PARAMS.items()]))
    q = lambda m: F.struct(F.col(f"{m}_p10").alias("p10"), F.col(f"{m}_p50").alias("p50"), F.col(f"{m}_p90").alias("p90")).alias(m)
    cons = F.array(*[F.struct(F.lit(n).alias("name"), (-F.col(f"constraint_{n}")).alias("margin"), F.when(F.col(f"constraint_{n}") <= 1e-9, "PASS").otherwise("FAIL").alias("status")) for n in sc.CONSTRAINTS])
    doc = df.select(F.concat(F.lit("ctx-"), (F.col("scenario_id") % 5).cast("string")).alias("context_id"), F.when(F.col("hard_constraints_pass"), "feasible").otherwise("refused").alias("scenario_label"), "scenario_id",
                    params.alias("parameters"), F.struct(q("throughput"), q("energy"), "quality_failure_probability", "downtime_probability").alias("prediction"), "distance_ratio",
                    (F.col("distance_ratio") <= 1.0).alias("in_distribution"), cons.alias("constraints"))
    path = f"{scratch(b.spark)}/scenarios"
    doc.write.mode("overwrite").json(path)
    return b.spark.read.schema(DOC).json(path)


@query("rm16_quantile_comparison", sql("scored", f"SELECT scenario_id, {rnd('throughput_p50 - throughput_p10')} AS lower_error, {rnd('throughput_p90 - throughput_p50')} AS upper_error, {rnd('throughput_p50')} AS p50 FROM scored WHERE hard_constraints_pass"))
def rm16(b):
    flat = scenario_documents(documents(b), label="feasible").select("scenario_id", "prediction.throughput.*")
    return S.rounded(sc.error_widths(flat).select("scenario_id", "lower_error", "upper_error", "p50"))


@query("rm17_risk_table", sql("scored", " UNION ALL ".join(f"SELECT scenario_id, '{c}' AS risk, {rnd(c)} AS value FROM scored" for c in ("quality_failure_probability", "downtime_probability", "distance_ratio"))))
def rm17(b):
    flat = documents(b).select("scenario_id", "prediction.quality_failure_probability", "prediction.downtime_probability", "distance_ratio")
    return S.rounded(sc.risk_rows(flat, "scenario_id", ["quality_failure_probability", "downtime_probability", "distance_ratio"]))


@query("rm20_distribution_monitor", sql("scored", f"SELECT scenario_id, distance_ratio <= 1.0 AS in_distribution, {rnd('distance_ratio')} AS distance_ratio, list_sum([{', '.join(f'(constraint_{n} > 1e-9)::INT' for n in sc.CONSTRAINTS)}])::BIGINT AS failed FROM scored"))
def rm20(b):
    d = documents(b)
    failed = F.size(F.filter("constraints", lambda x: x["status"] == "FAIL")).cast("long")
    return S.rounded(d.select("scenario_id", "in_distribution", "distance_ratio", failed.alias("failed")))


@query("rm21_alternative_table", sql("scen", f"SELECT scenario_id, parameter, {rnd('value')} AS value, {rnd('value - now')} AS change FROM (" + " UNION ALL ".join(f"SELECT scenario_id, '{c}' AS parameter, {c} AS value, {now}::DOUBLE AS now FROM scen" for c, (now, _) in _PARAMS.items()) + ") x"))
def rm21(b):
    long = documents(b).select("scenario_id", F.explode("parameters").alias("parameter", "v"))
    return S.rounded(long.select("scenario_id", "parameter", F.col("v.value").alias("value"), (F.col("v.value") - F.col("v.current")).alias("change")))


@query("dq29_scenario_package", sql("scored", "SELECT CAST(scenario_id % 5 AS VARCHAR) AS ctx, count(*) AS scenarios, count(*) FILTER (hard_constraints_pass AND NOT distance_ratio <= 1.0) AS feasible_but_outside FROM scored GROUP BY 1"))
def dq29(b):
    d = documents(b)
    return d.groupBy(F.regexp_replace("context_id", "ctx-", "").alias("ctx")).agg(F.count(F.lit(1)).alias("scenarios"), F.count_if((F.col("scenario_label") == "feasible") & ~F.col("in_distribution")).alias("feasible_but_outside"))


# ---- sensor windows ------------------------------------------------------------------------------
_SW = "mean_value minimum_value maximum_value standard_deviation amplitude out_of_range_pct"
SW_SQL = sql("", f"""SELECT user_id, event_type, strftime(w, {TS}) AS window_start_ts, strftime(w + INTERVAL 1 DAY, {TS}) AS feature_available_at_ts, reading_count, {cols(_SW, 5)}, round(slope * 1e6, 3) + 0.0 AS slope_micro FROM (
  SELECT user_id, event_type, date_trunc('day', ts) AS w, count(*) AS reading_count, avg(value) AS mean_value, min(value) AS minimum_value, max(value) AS maximum_value, stddev_pop(value) AS standard_deviation,
    max(value) - min(value) AS amplitude, avg((NOT value BETWEEN 1 AND 60)::INT) * 100.0::DOUBLE AS out_of_range_pct,
    CASE WHEN count(*) > 1 THEN regr_slope(value, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000.0::DOUBLE) END AS slope FROM events GROUP BY 1, 2, 3) x""")


def _sw_rows(df):
    out = texted(df, "window_start_ts", "feature_available_at_ts").withColumn("slope_micro", F.round(F.col("slope") * 1e6, 3) + 0.0)
    names = ["user_id", "event_type", "window_start_ts", "feature_available_at_ts", "reading_count", *_SW.split(), "slope_micro"]
    micro = out.select(*names)
    return S.rounded(micro, 5, {"slope_micro": 3})


_SW_ALL = SW_SQL.replace("round(slope * 1e6, 3) + 0.0", "round(round(slope * 1e6, 3) * 1.000000000001::DOUBLE, 3) + 0.0")
# a stream emits the windows that the watermark, an hour behind the newest event, has passed
_SW_FINISHED = _SW_ALL + " WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("sw1_window_summary", _SW_ALL)
def sw1(b):
    return _sw_rows(window_summary(b.table("events"), "user_id", "event_type", "ts", "value", 1.0, 60.0, width="1 day"))


@query("sw1_streaming_windows", _SW_FINISHED)
def sw1_stream(b):
    """The same plan as a stream over the event files: finished windows only, appended once."""
    path = scratch(b.spark)
    source = b.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.mode("overwrite").parquet(f"{path}/in")
    stream = b.spark.readStream.schema(source.schema).parquet(f"{path}/in")
    running = stream_window_summary(stream, f"{path}/out", f"{path}/state", watermark="1 hour", entity="user_id", sensor="event_type", ts="ts", value="value", low=1.0, high=60.0, width="1 day")
    running.awaitTermination()
    return _sw_rows(b.spark.read.parquet(f"{path}/out"))


@query("sw1_restarted_stream", _SW_FINISHED)
def sw1_restarted(b):
    """Events in two deliveries, the query stopped between them: the second brings the last odd events of the first half
    late and every even event of it again. Each event counts once."""
    path = scratch(b.spark)
    source = b.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = source.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    half = F.lit(ends["a"] + (ends["z"] - ends["a"]) / 2)
    early, held = F.col("ts") < half, (F.col("ts") >= half - F.expr("INTERVAL 30 MINUTES")) & (F.col("event_id") % 2 == 1)
    columns = dict(entity="user_id", sensor="event_type", ts="ts", value="value", low=1.0, high=60.0, width="1 day", identity="event_id")
    for delivery in (source.filter(early & ~held), source.filter(~early | held | (F.col("event_id") % 2 == 0))):
        delivery.write.mode("append").parquet(f"{path}/in")
        stream = b.spark.readStream.schema(source.schema).parquet(f"{path}/in")
        stream_window_summary(stream, f"{path}/out", f"{path}/state", watermark="1 hour", **columns).awaitTermination()
    return _sw_rows(b.spark.read.parquet(f"{path}/out"))
