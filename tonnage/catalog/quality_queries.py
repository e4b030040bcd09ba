"""Data-quality rules over the bound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tonnage.catalog.base import query, rnd, sql
from tonnage.functions import scalar as S
from tonnage.plans import contracts, packages, quality
from tonnage.plans.quality import Rule
from tonnage.sources import sinks
from tonnage.sources.scratch import scratch


def _report(df):
    return S.rounded(df.select("check_id", "observed", "status"))


def _dq(name, frames, rules, needs, observed, stored=False):
    """`observed` maps check_id to a scalar SQL query; the verdict follows from the rule."""
    parts = []
    for r in rules:
        ok = f"o >= {r.at_least}" if r.at_least is not None else f"o = {r.equals}"
        parts.append(f"SELECT '{r.id}' AS check_id, CAST(o AS DOUBLE) AS observed, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status FROM ({observed[r.id]}) t(o)")

    def plan(b):
        return _report(quality.run_rules(frames(b.stored if stored else b), rules))

    query(name, sql(needs, " UNION ALL ".join(parts)))(plan)


def _tables(*names):
    return lambda b: {n: b.table(n) for n in names}


_ALL = contracts.SOURCE_TABLES
_dq("dq1_row_counts", _tables(*_ALL), [Rule(f"row_count.{t}", "count", t, at_least=1) for t in _ALL], "", {f"row_count.{t}": f"SELECT count(*) FROM {t}" for t in _ALL})

_KEYS = {t: (k,) for t, k in {**contracts.BOUND_KEYS, "nation": "n_nationkey", "region": "r_regionkey", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id"}.items()}
_KEYS |= {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "conversations": ("conv_id", "turn")}
_MART_KEYS = {"mt1": ("order_id",), "mt2": ("date_key", "line_key", "shift_key"), "fp": ("tube_id",)}
_KEYED = _KEYS | _MART_KEYS
_dq("dq2_primary_keys", lambda b: _tables(*_KEYS)(b) | {"mt1": b.stored.order_mart, "mt2": b.stored.shift_mart, "fp": b.production}, [Rule(f"primary_key.{t}", "key", t, columns=k) for t, k in _KEYED.items()], "mt1 mt2 fp",
    {f"primary_key.{t}": f"SELECT coalesce(sum(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in k)} THEN n ELSE n - 1 END), 0) FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY ALL) g" for t, k in _KEYED.items()})
_dq("dq3_lineage", _tables("documents", "conversations"), [
    Rule("lineage.documents", "rows", "documents", "source <> 'web' OR source IS NULL"), Rule("lineage.conversations", "rows", "conversations", "role NOT IN ('user', 'assistant') OR role IS NULL")], "",
    {"lineage.documents": "SELECT count(*) FROM documents WHERE source <> 'web' OR source IS NULL", "lineage.conversations": "SELECT count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') OR role IS NULL"})

_REFS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
         ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
         ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id")]
_dq("dq4_foreign_keys", _tables("lineitem", "orders", "part", "supplier", "customer", "nation", "region", "documents", "labels"),
    [Rule(f"foreign_key.{c}.{ck}", "reference", c, columns=(ck, pk), other=p) for c, ck, p, pk in _REFS], "",
    {f"foreign_key.{c}.{ck}": f"SELECT count(*) FROM {c} c LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {p}) p ON c.{ck} = p.k WHERE p.k IS NULL" for c, ck, p, pk in _REFS})

_TEMPORAL = {"lines": ("fp", "actual_start_ts >= actual_end_ts"), "downtime": ("downtime", "event_start_ts >= event_end_ts"),
             "maintenance": ("maintenance", "actual_start_ts >= actual_end_ts OR scheduled_start_ts > actual_start_ts"), "sensors": ("sensors", "feature_available_at_ts < window_start_ts")}
_dq("dq5_temporal_order", lambda b: {"fp": b.production, "downtime": b.downtime_events, "maintenance": b.maintenance_events, "sensors": b.sensor_windows},
    [Rule(f"temporal_order.{n}", "rows", t, w) for n, (t, w) in _TEMPORAL.items()], "fp downtime maintenance sensors",
    {f"temporal_order.{n}": f"SELECT count(*) FROM {t} WHERE {w}" for n, (t, w) in _TEMPORAL.items()})


@query("dq5_shipped_before_ordered", "SELECT 'temporal_order.shipping' AS check_id, CAST(count(*) AS DOUBLE) AS observed, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def dq5b(b):
    joined = b.table("lineitem").join(b.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _report(quality.run_rules({"s": joined}, [Rule("temporal_order.shipping", "rows", "s", "l_shipdate < o_orderdate")]))


_dq("dq6_domains", lambda b: {"fp": b.production, "sensors": b.sensor_windows, "part": b.table("part")},
    [Rule("domain.disposition", "rows", "fp", "disposition NOT IN ('FIRST_PASS', 'REWORK', 'SCRAP')"), Rule("domain.missingness", "rows", "sensors", "missingness_type NOT IN ('NONE', 'MCAR', 'MAR', 'BLOCK', 'NOT_APPLICABLE')"),
     Rule("domain.part_type", "rows", "part", "p_type NOT IN ('ECONOMY', 'SMALL')")], "fp sensors",
    {"domain.disposition": "SELECT count(*) FROM fp WHERE disposition NOT IN ('FIRST_PASS', 'REWORK', 'SCRAP')", "domain.missingness": "SELECT count(*) FROM sensors WHERE missingness_type NOT IN ('NONE', 'MCAR', 'MAR', 'BLOCK', 'NOT_APPLICABLE')",
     "domain.part_type": "SELECT count(*) FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')"})

_ENVELOPES = {"tool_wear_index": (0, 1), "sensor_degradation_index": (0, 0.7), "roll_speed_rpm": (40, 240), "thermal_uniformity_index": (0, 1), "hours_since_maintenance": (0, 72)}
_dq("dq7_envelopes", lambda b: {"process": b.process_parameters}, [Rule(f"range.{c}", "rows", "process", f"{c} NOT BETWEEN {lo} AND {hi}") for c, (lo, hi) in _ENVELOPES.items()], "process",
    {f"range.{c}": f"SELECT count(*) FROM process WHERE {c} NOT BETWEEN {lo} AND {hi}" for c, (lo, hi) in _ENVELOPES.items()})
_COMPLETE = "(missingness_type = 'NONE' AND (mean_value IS NULL OR out_of_range_pct IS NULL)) OR (missingness_type <> 'NONE' AND (mean_value IS NOT NULL OR out_of_range_pct IS NOT NULL))"
_dq("dq8_completeness", lambda b: {"sensors": b.sensor_windows}, [Rule("completeness.sensors", "rows", "sensors", _COMPLETE)], "sensors", {"completeness.sensors": f"SELECT count(*) FROM sensors WHERE {_COMPLETE}"})
_dq("dq9_missingness", lambda b: {"sensors": b.sensor_windows}, [Rule(f"missingness.{m}", "rows", "sensors", f"missingness_type = '{m}'", at_least=1) for m in ("MCAR", "MAR", "BLOCK")], "sensors",
    {f"missingness.{m}": f"SELECT count(*) FROM sensors WHERE missingness_type = '{m}'" for m in ("MCAR", "MAR", "BLOCK")})
_dq("dq10_coverage", _tables("part"), [Rule("coverage.products", "distinct", "part", columns=("p_brand",), equals=25), Rule("coverage.grades", "distinct", "part", columns=("p_type",), equals=6)], "",
    {"coverage.products": "SELECT count(DISTINCT p_brand) FROM part", "coverage.grades": "SELECT count(DISTINCT p_type) FROM part"})


@query("dq11_profile_statistics", sql("fp stops", f"""SELECT {rnd('avg(approved_first_pass::INT)')} AS first_pass_yield, {rnd("avg((disposition = 'REWORK')::INT)")} AS rework_rate,
  {rnd("avg((disposition = 'SCRAP')::INT)")} AS scrap_rate, {rnd('(SELECT avg(duration_minutes) FROM stops)')} AS mean_downtime_minutes FROM fp"""))
def dq11(b):
    rate = lambda d: F.avg(S.flag(F.col("disposition") == d))
    mean = b.stop_facts.agg(F.avg("duration_minutes").alias("m")).scalar()
    stats = b.production.agg(F.avg(S.flag(F.col("approved_first_pass"))).alias("first_pass_yield"), rate("REWORK").alias("rework_rate"), rate("SCRAP").alias("scrap_rate"))
    return S.rounded(stats.withColumn("mean_downtime_minutes", mean))


def _pairs(name, needs, rows):
    """Reconciliations: (id, left total, right total, left SQL, right SQL); a total is an observed (frame, measure) or a function."""
    parts = [f"SELECT '{i}' AS check_id, {rnd(f'({ls})', 4)} AS observed, CASE WHEN abs(({ls}) - ({rs})) <= greatest(1e-12 * greatest(abs(({ls})), abs(({rs}))), 1e-8) THEN 'PASS' ELSE 'FAIL' END AS status" for i, _, _, ls, rs in rows]

    def plan(b):
        total = lambda t: t(b.stored) if callable(t) else b.stored.total(*t)
        out = quality.reconcile_totals(b.spark, [(i, total(left), total(right)) for i, left, right, _, _ in rows])
        return S.rounded(out.select("check_id", "observed", "status"), 4)

    query(name, sql(needs, " UNION ALL ".join(parts)))(plan)


def _size(frame):
    """Row count as a total; of a scan it comes from the file footers."""
    return lambda b: float(frame(b).count())


_FACT_COUNTS = [("production", "lineitem", 1, "fp"), ("energy_events", "lineitem", 3, "fe"), ("quality_results", "lineitem", 4, "fq"), ("process_parameters", "lineitem", 1, "process"), ("stop_facts", "orders", 1, "stops")]
_pairs("dq12_layer_counts", "fp fe fq process stops", [
    (f"count.{f}", lambda b, t=t, k=k: float(k * b.table(t).count()), (f, "rows"), f"SELECT {k}.0 * count(*)::DOUBLE FROM {t}", f"SELECT count(*)::DOUBLE FROM {v}") for f, t, k, v in _FACT_COUNTS])


@query("dq12_curated_counts", " UNION ALL ".join(f"SELECT 'curated.{t}' AS check_id, count(*)::DOUBLE AS observed, 'PASS' AS status FROM {t}" for t in _ALL))
def dq12_curated(b):
    """Rows observed while each raw table was copied, against the rows of the copy."""
    copied = sinks.export_report({t: b.table(t) for t in _ALL}, scratch(b.spark), ("parquet",))
    ok = F.col("rows") == F.col("source_rows")
    return copied.select(F.concat(F.lit("curated."), "table_name").alias("check_id"), F.col("source_rows").cast("double").alias("observed"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


_GRAINS = {"mt1": ("order_id",), "mt2": ("date_key", "line_key", "shift_key"), "mt4": ("date_key", "product_key", "line_key", "grade_family", "characteristic", "unit")}
_dq("dq13_grain_unique", lambda b: {"mt1": b.order_mart, "mt2": b.shift_mart, "mt4": b.quality_mart}, [Rule(f"grain.{m}", "key", m, columns=k) for m, k in _GRAINS.items()], "mt1 mt2 mt4",
    {f"grain.{m}": f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {m} GROUP BY {', '.join(k)}) g" for m, k in _GRAINS.items()}, stored=True)
_pairs("dq14_reconciliations", "fp fe stops mt1 mt2 mt4 mt5", [
    ("good.order", ("production", "good_mass_t"), ("order_mart", "good_tonnes"), "SELECT sum(good_mass_t) FROM fp", "SELECT sum(good_tonnes) FROM mt1"),
    ("good.shift", ("production", "good_mass_t"), ("shift_mart", "good_tonnes"), "SELECT sum(good_mass_t) FROM fp", "SELECT sum(good_tonnes) FROM mt2"),
    ("hours.shift", ("production", "productive_hours"), ("shift_mart", "productive_hours"), "SELECT sum(productive_hours) FROM fp", "SELECT sum(productive_hours) FROM mt2"),
    ("energy.order", ("energy_events", "energy_kwh"), ("order_mart", "energy_kwh"), "SELECT sum(energy_kwh) FROM fe", "SELECT sum(energy_kwh) FROM mt1"),
    ("energy.mart", ("energy_events", "energy_kwh"), ("energy_mart", "energy_kwh"), "SELECT sum(energy_kwh) FROM fe", "SELECT sum(energy_kwh) FROM mt5"),
    ("downtime.shift", ("stop_facts", "duration_minutes"), ("shift_mart", "unplanned_downtime_minutes"), "SELECT sum(duration_minutes) FROM stops", "SELECT sum(unplanned_downtime_minutes) FROM mt2"),
    ("inspections", ("quality_results", "rows"), ("quality_mart", "inspection_count"), "SELECT count(*)::DOUBLE FROM fq", "SELECT sum(inspection_count)::DOUBLE FROM mt4")])
_F1, _F2, _F3 = ("abs(tbh - good_tonnes / NULLIF(productive_hours, 0)) > 1e-10",) * 2 + ("abs(mix_adjusted_tbh_gap - (actual_tbh - mix_expected_tbh)) > 1e-10",)
_dq("dq15_formulas", lambda b: {"mt1": b.order_mart, "mt2": b.shift_mart, "dg2": b.mix}, [Rule("formula.order_tbh", "rows", "mt1", _F1), Rule("formula.shift_tbh", "rows", "mt2", _F2), Rule("formula.mix_gap", "rows", "dg2", _F3)], "mt1 mt2 dg2",
    {"formula.order_tbh": f"SELECT count(*) FROM mt1 WHERE {_F1}", "formula.shift_tbh": f"SELECT count(*) FROM mt2 WHERE {_F2}", "formula.mix_gap": f"SELECT count(*) FROM dg2 WHERE {_F3}"}, stored=True)
_BOUNDS = {"mt2": ("fpy", "rework_rate", "scrap_rate", "availability", "performance", "quality", "oee"), "mt8": ("loss_share", "cumulative_loss_share")}
_dq("dq16_bounds", lambda b: {"mt2": b.shift_mart, "mt8": b.pareto}, [Rule(f"bounds.{t}.{c}", "rows", t, f"{c} NOT BETWEEN 0 AND 1 + 1e-9") for t, cs in _BOUNDS.items() for c in cs], "mt2 mt8",
    {f"bounds.{t}.{c}": f"SELECT count(*) FROM {t} WHERE {c} NOT BETWEEN 0 AND 1 + 1e-9" for t, cs in _BOUNDS.items() for c in cs}, stored=True)
_dq("dq17_point_in_time", lambda b: {"pt1": b.pre_order, "pt2": b.in_process, "pt3": b.asset_snapshot}, [Rule(f"leak.{t}", "rows", t, "feature_max_source_ts > snapshot_ts") for t in ("pt1", "pt2", "pt3")], "pt1 pt2 pt3",
    {f"leak.{t}": f"SELECT count(*) FROM {t} WHERE feature_max_source_ts > snapshot_ts" for t in ("pt1", "pt2", "pt3")})
_pairs("dq19_snapshot_counts", "pt1 pt2 pt3 ev cal ev_assets", [
    ("count.pre_order", _size(lambda b: b.pre_order), _size(lambda b: b.event_orders), "SELECT count(*)::DOUBLE FROM pt1", "SELECT count(*)::DOUBLE FROM ev WHERE event_type = 'purchase'"),
    ("count.in_process", _size(lambda b: b.in_process), _size(lambda b: b.user_process.join(b.stage_events.select("tube_id").distinct(), "tube_id")), "SELECT count(*)::DOUBLE FROM pt2",
     "SELECT count(*)::DOUBLE FROM (SELECT DISTINCT user_id, line_id FROM ev WHERE event_type = 'view') v JOIN (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase') p USING (user_id)"),
    ("count.asset_window", _size(lambda b: b.asset_snapshot), _size(lambda b: b.windows), "SELECT count(*)::DOUBLE FROM pt3", "SELECT (SELECT date_diff('day', first_day, last_day) + 1 FROM cal) * (SELECT count(*) FROM ev_assets) * 12.0")])


@query("dq20_required_kpis", "SELECT p_type AS kpi_name FROM (VALUES ('ECONOMY'), ('LUXURY'), ('SMALL'), ('VINTAGE')) r(p_type) WHERE p_type NOT IN (SELECT p_type FROM part)")
def dq20(b):
    """Names a contract requires that the table does not hold."""
    required = b.spark.createDataFrame([(n,) for n in ("ECONOMY", "LUXURY", "SMALL", "VINTAGE")], "p_type string")
    return quality.missing_names(required, b.table("part"), "p_type").withColumnRenamed("p_type", "kpi_name")


_STAR = [("fp", "line_key", "dim_line"), ("fp", "product_key", "dim_product"), ("fp", "shift_key", "dim_shift"), ("fq", "line_key", "dim_line")]
_dq("dq21_star_keys", lambda b: {"fp": b.production, "fq": b.quality, "dim_line": b.lines_dim, "dim_product": b.products, "dim_shift": b.shifts_dim},
    [Rule(f"star.{f}.{k}", "reference", f, columns=(k, k), other=d) for f, k, d in _STAR], "fp fq dim_line dim_product dim_shift",
    {f"star.{f}.{k}": f"SELECT count(*) FROM {f} WHERE {k} NOT IN (SELECT {k} FROM {d})" for f, k, d in _STAR})


@query("dq22_key_alignment", sql("grid pt6", "SELECT window_id, 'left' AS side FROM grid WHERE window_id NOT IN (SELECT window_id FROM pt6)"))
def dq22(b):
    return quality.key_difference(b.windows, b.window_labels, "window_id")


_dq("dq23_targets_after_snapshot", lambda b: {"pt6": b.window_labels}, [Rule("targets.asset_window", "rows", "pt6", "target_available_at_ts <= snapshot_ts")], "pt6", {"targets.asset_window": "SELECT count(*) FROM pt6 WHERE target_available_at_ts <= snapshot_ts"})


#: SQL view behind each exported table.
EXPORT_VIEWS = {
    "dim_date": "dim_date", "dim_product": "dim_product", "dim_line": "dim_line", "dim_shift": "dim_shift", "dim_asset": "ev_assets", "fact_line_shift": "mt2", "fact_order": "mt1", "fact_quality": "mt4",
    "fact_energy": "mt5", "fact_downtime": "fd", "fact_maintenance": "fm", "fact_losses": "mt8", "fact_asset_condition": "mt7", "daily_trend": "dg1", "mix_adjustment": "dg2", "spc_tbh": "dg3",
    "spc_quality": "dg4", "process_interactions": "dg5", "segment_associations": "dg6", "loss_pareto": "mt8",
}


@query("dq24_export_counts", sql(" ".join(dict.fromkeys(EXPORT_VIEWS.values())), " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, f AS format, count(*) AS rows, 'PASS' AS status FROM {v} CROSS JOIN (VALUES ('parquet'), ('csv')) x(f) GROUP BY f" for t, v in EXPORT_VIEWS.items())))
def dq24(b):
    """Both packages: rows in the files of each format against the rows observed while they were written."""
    frames = packages.package(b.stored, packages.BI_TABLES) | packages.package(b.stored, packages.DIAGNOSTIC_TABLES)
    report = sinks.export_report(frames, scratch(b.spark))
    return report.select("table_name", "format", "rows", F.when(F.col("rows") == F.col("source_rows"), "PASS").otherwise("FAIL").alias("status"))


_dq("dq25_spc_guardrails", lambda b: {"dg3": b.tbh_chart, "dg4": b.quality_chart}, [
    Rule("spc.tbh_order", "rows", "dg3", "NOT (lower_control_tbh <= centerline_tbh AND centerline_tbh <= upper_control_tbh)"), Rule("spc.tbh_support", "rows", "dg3", "control_signal AND NOT limits_reliable"),
    Rule("spc.quality_order", "rows", "dg4", "NOT (lower_control_value <= centerline_value AND centerline_value <= upper_control_value)"), Rule("spc.quality_support", "rows", "dg4", "control_signal AND NOT limits_reliable")], "dg3 dg4",
    {"spc.tbh_order": "SELECT count(*) FROM dg3 WHERE NOT (lower_control_tbh <= centerline_tbh AND centerline_tbh <= upper_control_tbh)", "spc.tbh_support": "SELECT count(*) FROM dg3 WHERE control_signal AND NOT limits_reliable",
     "spc.quality_order": "SELECT count(*) FROM dg4 WHERE NOT (lower_control_value <= centerline_value AND centerline_value <= upper_control_value)", "spc.quality_support": "SELECT count(*) FROM dg4 WHERE control_signal AND NOT limits_reliable"}, stored=True)
_dq("dq26_interaction_cells", lambda b: {"dg5": b.cells}, [Rule("cells.empty", "rows", "dg5", "tube_count <= 0"), Rule("cells.present", "count", "dg5", at_least=1)], "dg5",
    {"cells.empty": "SELECT count(*) FROM dg5 WHERE tube_count <= 0", "cells.present": "SELECT count(*) FROM dg5"})


@query("snk8_publish_gate", "SELECT 'refused' AS outcome, count(*) AS bad_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def snk8(b):
    """The shipping rule fails on the data, so the gate refuses and nothing is written."""
    from tonnage.sources.sinks import PublicationRefused, gate

    report = dq5b(b)
    try:
        gate(report)
        outcome = "published"
    except PublicationRefused:
        outcome = "refused"
    return report.select(F.lit(outcome).alias("outcome"), F.col("observed").cast("long").alias("bad_rows"))
