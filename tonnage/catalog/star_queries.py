"""Star, mart, measure, snapshot, diagnostic and read-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonnage.catalog.base import cols, query, sql
from tonnage.functions.scalar import rounded, text_ts
from tonnage.plans import contracts, diagnostics, features, marts, measures, packages, readmodel

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def tx(name: str) -> str:
    return f"strftime({name}, {TS}) AS {name}"


def texted(df, *names: str):
    return df.withColumns({n: text_ts(n) for n in names})


def day(df, *names: str):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def dtx(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d') AS {name}"


# ---- dimensions ----------------------------------------------------------------------------------
@query("dm1_dim_date", sql("dim_date", f"SELECT * REPLACE ({dtx('full_date')}) FROM dim_date"))
def dm1(b):
    return day(b.dates, "full_date")


@query("dm2_dim_product", sql("dim_product", "SELECT * FROM dim_product"))
def dm2(b):
    return b.products


@query("dm3_dim_line", sql("dim_line", "SELECT * FROM dim_line"))
def dm3(b):
    return b.lines_dim


@query("dm4_dim_shift", sql("dim_shift", "SELECT * FROM dim_shift"))
def dm4(b):
    return b.shifts_dim


@query("dm5_dim_asset", sql("ev_assets ev_lines", "SELECT asset_key, asset_id, line_key, line_id, asset_type, criticality FROM ev_assets JOIN ev_lines USING (line_id)"))
def dm5(b):
    return b.ev_assets


# ---- facts ---------------------------------------------------------------------------------------
_FP = "tube_id order_id date_key product_key line_key shift_key product_code grade_family line_id shift_id approved_first_pass disposition"


@query("fc1_fact_production", sql("fp", f"SELECT {cols(_FP)}, {tx('actual_end_ts')}, {cols('total_mass_t good_mass_t productive_hours actual_tph rework_mass_t scrap_mass_t', 6)} FROM fp"))
def fc1(b):
    return rounded(texted(b.production, "actual_end_ts").drop("actual_start_ts", "tube_key", "grade_key"))


@query("fc2_fact_quality", sql("fq", f"SELECT {cols('quality_result_id tube_id order_id date_key product_key line_key shift_key characteristic unit passed')}, {cols('measured_value', 6)} FROM fq"))
def fc2(b):
    names = "quality_result_id tube_id order_id date_key product_key line_key shift_key characteristic unit passed measured_value"
    return rounded(b.quality.select(*names.split()))


@query("fc3_fact_energy", sql("fe", f"SELECT {cols('energy_event_id tube_id order_id date_key product_key line_key shift_key stage_name')}, {cols('energy_kwh good_mass_t energy_per_good_tonne_kwh_t', 5)} FROM fe"))
def fc3(b):
    names = "energy_event_id tube_id order_id date_key product_key line_key shift_key stage_name energy_kwh good_mass_t energy_per_good_tonne_kwh_t"
    return rounded(b.energy.select(*names.split()), 5)


_FD = "downtime_event_id date_key line_key shift_key asset_key line_id shift_id asset_id reason_code maintenance_deferred unplanned"


@query("fc4_fact_downtime", sql("fd", f"SELECT {cols(_FD)}, {tx('event_start_ts')}, {tx('event_end_ts')}, {cols('duration_minutes hours_since_maintenance sensor_degradation_index production_impact_t', 6)} FROM fd"))
def fc4(b):
    names = _FD.split() + "event_start_ts event_end_ts duration_minutes hours_since_maintenance sensor_degradation_index production_impact_t".split()
    return rounded(texted(b.downtime.select(*names), "event_start_ts", "event_end_ts"))


@query("fc5_fact_maintenance", sql("fm", f"SELECT {cols('maintenance_event_id date_key line_key asset_key line_id asset_id maintenance_type was_deferred work_order_status')}, {tx('actual_end_ts')}, {cols('duration_minutes', 6)} FROM fm"))
def fc5(b):
    names = "maintenance_event_id date_key line_key asset_key line_id asset_id maintenance_type was_deferred work_order_status actual_end_ts duration_minutes"
    return rounded(texted(b.maintenance.select(*names.split()), "actual_end_ts"))


# ---- marts ---------------------------------------------------------------------------------------
_M1K = "order_id date_key product_key line_key shift_key product_code grade_family line_id shift_id tube_count"
_M1D = "total_tonnes good_tonnes productive_hours rework_tonnes scrap_tonnes fpy rework_rate scrap_rate energy_kwh tbh energy_per_good_tonne_kwh_t"


@query("mt1_order_performance", sql("mt1", f"SELECT {cols(_M1K)}, {cols(_M1D, 6)} FROM mt1"))
def mt1(b):
    return rounded(b.order_mart)


_M2K = "date_key line_key shift_key line_id shift_id tube_count"
_M2D = _M1D + " unplanned_downtime_minutes availability performance quality oee"
MT2_SQL = sql("mt2", f"SELECT {cols(_M2K)}, {cols(_M2D, 6)} FROM mt2")


@query("mt2_line_shift_performance", MT2_SQL)
def mt2(b):
    return rounded(b.shift_mart)


_M3D = "total_tonnes good_tonnes productive_hours rework_tonnes scrap_tonnes energy_kwh unplanned_downtime_minutes tbh quality energy_per_good_tonne_kwh_t availability performance"


@query("mt3_line_shift_summary", sql("mt3", f"SELECT {cols('line_key shift_key line_id shift_id tube_count')}, {cols(_M3D, 5)} FROM mt3"))
def mt3(b):
    return rounded(b.shift_summary, 5)


_M4K = "date_key product_key line_key product_code grade_family line_id characteristic unit inspection_count nonconforming_count"


@query("mt4_quality_summary", sql("mt4", f"SELECT {cols(_M4K)}, {cols('mean_value standard_deviation minimum_value maximum_value conformance_rate', 5)} FROM mt4"))
def mt4(b):
    return rounded(b.quality_mart, 5)


@query("mt5_energy_summary", sql("mt5", f"SELECT {cols('date_key line_key shift_key line_id shift_id')}, {cols('energy_kwh good_tonnes energy_per_good_tonne_kwh_t', 6)} FROM mt5"))
def mt5(b):
    return rounded(b.energy_mart)


_M6D = "unplanned_downtime_minutes production_impact_t mean_sensor_degradation deferred_context_rate maintenance_minutes maintenance_deferred_rate"


@query("mt6_downtime_maintenance", sql("mt6", f"SELECT {cols('date_key line_key line_id downtime_event_count maintenance_event_count')}, {cols(_M6D, 6)} FROM mt6"))
def mt6(b):
    return rounded(b.stops_and_works)


_M7D = "mean_tool_wear_index maximum_tool_wear_index mean_sensor_degradation_index mean_hours_since_maintenance maintenance_deferred_rate unplanned_downtime_minutes"


@query("mt7_asset_condition", sql("mt7", f"SELECT {cols('date_key line_key line_id maintenance_event_count')}, {cols(_M7D, 6)} FROM mt7"))
def mt7(b):
    return rounded(b.condition_mart)


_M8K = "date_key line_key shift_key line_id shift_id loss_type event_count"


@query("mt8_loss_pareto", sql("mt8", f"SELECT {cols(_M8K)}, {cols('loss_tonnes_equivalent loss_share cumulative_loss_share', 6)} FROM mt8"))
def mt8(b):
    return rounded(b.pareto)


# ---- measures ------------------------------------------------------------------------------------
def _measure_query(name, mart, by, needs, table, exprs, digits=6):
    body = ", ".join(f"round(({e}) * 1.000000000001::DOUBLE, {digits}) + 0.0 AS {n}" for n, e in exprs.items())
    text = sql(needs, f"SELECT {by}, {body} FROM {table} GROUP BY {by}")

    def plan(b):
        return rounded(measures.measure(mart(b), list(exprs), [by]), digits)

    query(name, text)(plan)


_W = "sum({0} * {1}) / NULLIF(sum({1}), 0)"
_AV = "sum(productive_hours) / NULLIF(sum(productive_hours) + sum(unplanned_downtime_minutes) / 60.0::DOUBLE, 0)"
_PE = "least(sum(total_tonnes) / NULLIF(42.0::DOUBLE * sum(productive_hours), 0), 1.0::DOUBLE)"
_QU = "sum(good_tonnes) / NULLIF(sum(total_tonnes), 0)"
_measure_query("me1_volume_measures", lambda b: b.shift_mart, "line_id", "mt2", "mt2", {
    "good_tonnes": "sum(good_tonnes)", "productive_hours": "sum(productive_hours)", "energy_kwh": "sum(energy_kwh)", "downtime_minutes": "sum(unplanned_downtime_minutes)"}, 4)
_measure_query("me2_ratio_measures", lambda b: b.shift_mart, "date_key", "mt2", "mt2", {
    "tbh": "sum(good_tonnes) / NULLIF(sum(productive_hours), 0)", "energy_per_good_tonne": "sum(energy_kwh) / NULLIF(sum(good_tonnes), 0)"})
_measure_query("me3_yield_measures", lambda b: b.shift_mart, "shift_id", "mt2", "mt2", {n: _W.format(n, "tube_count") for n in ("fpy", "scrap_rate", "rework_rate")})
_measure_query("me4_oee_measures", lambda b: b.shift_mart, "line_id", "mt2", "mt2", {
    "availability": _AV, "performance": _PE, "quality": _QU, "oee": f"({_AV}) * ({_PE}) * ({_QU})"})
_measure_query("me5_characteristic_mean", lambda b: b.quality_mart, "characteristic", "mt4", "mt4", {"characteristic_mean": _W.format("mean_value", "inspection_count")})
_measure_query("me6_mechanical_conformance", lambda b: b.quality_mart, "product_code", "mt4", "mt4", {
    "mechanical_conformance": "sum(conformance_rate * inspection_count) FILTER (characteristic IN ('yield_strength_mpa', 'tensile_strength_mpa')) / NULLIF(sum(inspection_count) FILTER (characteristic IN ('yield_strength_mpa', 'tensile_strength_mpa')), 0)"})


_P1F = "ambient_temperature_c carbon_pct manganese_pct chromium_pct molybdenum_pct billet_diameter_mm billet_mass_kg"


# ---- snapshots and labels ------------------------------------------------------------------------
_P1 = "order_id product_code grade_family line_id shift_id committed_sequence hours_since_last_maintenance"


@query("pt1_pre_order_snapshot", sql("pt1", f"SELECT {cols(_P1)}, {tx('snapshot_ts')}, {tx('last_maintenance_ts')}, {tx('feature_max_source_ts')}, {cols('carbon_pct billet_diameter_mm billet_mass_kg', 6)} FROM pt1"))
def pt1(b):
    names = _P1.split() + "snapshot_ts last_maintenance_ts feature_max_source_ts carbon_pct billet_diameter_mm billet_mass_kg".split()
    return rounded(texted(b.pre_order.select(*names), "snapshot_ts", "last_maintenance_ts", "feature_max_source_ts"))


_P2D = ("tool_wear_index observed_furnace_zone_temperature observed_reheat_exit_temperature observed_roll_speed observed_rolling_load "
        "observed_lubrication_flow observed_mill_vibration mean_sensor_out_of_range_pct valid_sensor_window_rate")


@query("pt2_in_process_snapshot", sql("pt2", f"SELECT {cols('tube_id line_id pass_count')}, {tx('snapshot_ts')}, {tx('feature_max_source_ts')}, {cols(_P2D, 6)} FROM pt2"))
def pt2(b):
    return rounded(texted(b.in_process.drop("process_start_ts"), "snapshot_ts", "feature_max_source_ts"))


_P3K = ("window_id asset_id asset_type criticality line_id shift_id window_hour month_number day_of_week is_weekend prior_7d_downtime_events "
        "prior_30d_downtime_events prior_7d_maintenance_events hours_since_last_maintenance")
_P3D = "prior_7d_downtime_minutes prior_30d_downtime_minutes prior_7d_maintenance_minutes prior_mean_sensor_degradation prior_mean_tool_wear"


@query("pt3_asset_window_snapshot", sql("pt3", f"SELECT {cols(_P3K)}, {tx('snapshot_ts')}, {tx('feature_max_source_ts')}, {cols(_P3D, 6)} FROM pt3"))
def pt3(b):
    return rounded(texted(b.asset_snapshot, "snapshot_ts", "feature_max_source_ts"))


@query("pt4_order_labels", sql("mt1 fp", f"""SELECT order_id, {tx('target_available_at_ts')}, {cols('tbh fpy energy_per_good_tonne_kwh_t rework_rate scrap_rate', 6)}
  FROM mt1 JOIN (SELECT order_id, max(actual_end_ts) AS target_available_at_ts FROM fp GROUP BY 1) a USING (order_id)"""))
def pt4(b):
    return rounded(texted(features.order_labels(b.order_rows), "target_available_at_ts"))


PT5 = """SELECT fp.tube_id, actual_end_ts AS target_available_at_ts, actual_tph, approved_first_pass, disposition = 'REWORK' AS is_rework, disposition = 'SCRAP' AS is_scrap,
  energy_kwh / NULLIF(good_mass_t, 0) AS energy_per_good_tonne_kwh_t, outer_diameter_deviation_mm, wall_eccentricity_pct, ovality_pct
  FROM fp JOIN q_tube q ON q.tube_id = fp.tube_id JOIN e_tube e ON e.tube_id = fp.tube_id"""


@query("pt5_tube_labels", sql("fp q_tube e_tube", f"""SELECT {cols('tube_id approved_first_pass is_rework is_scrap')}, {tx('target_available_at_ts')},
  {cols('actual_tph energy_per_good_tonne_kwh_t outer_diameter_deviation_mm wall_eccentricity_pct ovality_pct', 5)} FROM ({PT5}) l"""))
def pt5(b):
    return rounded(texted(b.tube_labels, "target_available_at_ts"), 5)


@query("pt6_next_window_labels", sql("pt6", f"SELECT window_id, {tx('snapshot_ts')}, {tx('target_available_at_ts')}, next_window_downtime_occurred, {cols('next_window_downtime_duration_minutes', 6)} FROM pt6"))
def pt6(b):
    return rounded(texted(b.window_labels, "snapshot_ts", "target_available_at_ts"))


_PT7 = [c for c in contracts.ASSET_WINDOW_FEATURES if c not in ("asset_criticality", *_P3D.split())]


@query("pt7_contract_selection", sql("pt3 pt6", f"""SELECT p.window_id AS sample_key, {cols(' '.join(_PT7))}, criticality AS asset_criticality, {cols(_P3D, 6)},
  strftime(p.snapshot_ts, {TS}) AS snapshot_ts, {tx('feature_max_source_ts')}, {tx('target_available_at_ts')}, next_window_downtime_occurred, {cols('next_window_downtime_duration_minutes', 6)}
  FROM pt3 p JOIN pt6 l USING (window_id)"""))
def pt7(b):
    snapshot, labels, key, chosen, targets = packages.contract_frames(b)["asset_window"]
    x, index, y = features.select_xy(snapshot, labels, key, chosen, targets)
    joined = x.join(index.drop("entity_id"), "sample_key").join(y, "sample_key")
    return rounded(texted(joined, "snapshot_ts", "feature_max_source_ts", "target_available_at_ts"))


@query("pt7_pre_order_selection", sql("pt1 mt1 fp", f"""SELECT p.order_id AS sample_key, p.product_code, p.grade_family, p.line_id, p.shift_id, committed_sequence, {cols(_P1F, 6)}, strftime(p.snapshot_ts, {TS}) AS snapshot_ts,
  {tx('feature_max_source_ts')}, {tx('target_available_at_ts')}, {cols('tbh fpy energy_per_good_tonne_kwh_t rework_rate scrap_rate', 6)}
  FROM pt1 p JOIN mt1 USING (order_id) JOIN (SELECT order_id, max(actual_end_ts) AS target_available_at_ts FROM fp GROUP BY 1) a USING (order_id)"""))
def pt7_orders(b):
    snapshot, labels, key, chosen, targets = packages.contract_frames(b)["pre_order"]
    x, index, y = features.select_xy(snapshot, labels, key, chosen, targets)
    joined = x.join(index.drop("entity_id"), "sample_key").join(y, "sample_key")
    return rounded(texted(joined, "snapshot_ts", "feature_max_source_ts", "target_available_at_ts"))


# ---- diagnostics ---------------------------------------------------------------------------------
@query("dg1_daily_trend", sql("dg1", f"SELECT {cols(_M2K)}, {dtx('full_date')}, {cols(_M2D + ' tbh_change_from_previous_window fpy_change_from_previous_window', 6)} FROM dg1"))
def dg1(b):
    return rounded(day(b.trend, "full_date"))


_D2D = "good_tonnes productive_hours mix_expected_good_tonnes actual_tbh mix_expected_tbh mix_adjusted_tbh_gap"


@query("dg2_mix_adjustment", sql("dg2", f"SELECT {cols('date_key line_key line_id order_count low_support_segment_orders')}, {cols(_D2D, 6)} FROM dg2"))
def dg2(b):
    return rounded(b.stored.mix)


@query("dg3_spc_tbh", sql("dg3", f"SELECT {cols('date_key line_key shift_key line_id shift_id baseline_observations baseline_end_date_key limits_reliable control_signal')}, {cols('tbh centerline_tbh lower_control_tbh upper_control_tbh', 6)} FROM dg3"))
def dg3(b):
    return rounded(b.stored.tbh_chart)


_D4K = "date_key product_key line_key product_code grade_family line_id characteristic unit inspection_count baseline_observations baseline_end_date_key limits_reliable control_signal"


@query("dg4_spc_quality", sql("dg4", f"SELECT {cols(_D4K)}, {cols('mean_value conformance_rate centerline_value lower_control_value upper_control_value', 5)} FROM dg4"))
def dg4(b):
    return rounded(b.stored.quality_chart, 5)


_D5K = "product_code grade_family line_id roll_speed_band thermal_uniformity_band tube_count"
_D5D = ("mean_actual_tph fpy rework_rate scrap_rate mean_wall_eccentricity_pct mean_outer_diameter_deviation_mm mean_ovality_pct mean_energy_kwh "
        "mean_roll_speed_rpm mean_thermal_uniformity_index mean_tool_wear_index")


@query("dg5_process_interactions", sql("dg5", f"SELECT {cols(_D5K)}, {cols(_D5D, 5)} FROM dg5"))
def dg5(b):
    return rounded(b.cells, 5)


_D6D = "association_roll_speed_tph association_uniformity_eccentricity association_wear_eccentricity association_sensor_degradation_tph"


@query("dg6_segment_associations", sql("dg6", f"SELECT {cols('product_code grade_family line_id tube_count')}, {cols(_D6D, 6)} FROM dg6"))
def dg6(b):
    return rounded(b.segment_links)


@query("dg7_diagnostic_summary", sql("fp dg2 mt8 dg3 dg4 dg5", """
  SELECT round(sum(good_mass_t) / NULLIF(sum(productive_hours), 0), 6) AS global_tbh, round(avg(approved_first_pass::INT), 6) AS global_fpy,
    (SELECT round(regr_slope(tbh, date_key), 9) FROM (SELECT date_key, sum(good_mass_t) / NULLIF(sum(productive_hours), 0) AS tbh FROM fp GROUP BY 1) d) AS daily_tbh_linear_slope,
    (SELECT round(avg(mix_adjusted_tbh_gap), 6) FROM dg2) AS mean_mix_adjusted_tbh_gap,
    (SELECT round(max(abs(mix_adjusted_tbh_gap)), 6) FROM dg2) AS maximum_absolute_mix_adjusted_tbh_gap,
    (SELECT loss_type FROM mt8 GROUP BY 1 ORDER BY sum(loss_tonnes_equivalent) DESC, loss_type LIMIT 1) AS top_loss_type,
    (SELECT round(sum(loss_tonnes_equivalent), 6) AS t FROM mt8 GROUP BY loss_type ORDER BY 1 DESC LIMIT 1) AS top_loss_tonnes_equivalent,
    (SELECT count(*) FROM dg3 WHERE limits_reliable AND control_signal) AS tbh_control_signals, (SELECT count(*) FROM dg3 WHERE limits_reliable) AS tbh_windows_with_reliable_limits,
    (SELECT count(*) FROM dg4 WHERE limits_reliable AND control_signal) AS quality_control_signals, (SELECT count(*) FROM dg4 WHERE limits_reliable) AS quality_rows_with_reliable_limits,
    (SELECT product_code FROM spread) AS spread_product_code, (SELECT grade_family FROM spread) AS spread_grade_family, (SELECT line_id FROM spread) AS spread_line_id,
    (SELECT round(s, 6) FROM spread) AS spread_tbh
  FROM fp""".replace("FROM spread", "FROM (SELECT product_code, grade_family, line_id, max(mean_actual_tph) - min(mean_actual_tph) AS s FROM dg5 GROUP BY 1, 2, 3 ORDER BY s DESC, 1, 2, 3 LIMIT 1) z")))
def dg7(b):
    b = b.stored
    return diagnostics.diagnostic_summary(b.production, b.mix, b.pareto, b.tbh_chart, b.quality_chart, b.cells)


# ---- read model ----------------------------------------------------------------------------------
_R1 = "total_tonnes good_tonnes productive_hours fpy energy_kwh unplanned_downtime_minutes tbh energy_per_good_tonne_kwh_t oee"


@query("rm1_executive_trend", sql("dg1", f"SELECT {dtx('full_date')}, line_id, shift_id, tube_count, {cols(_R1, 6)} FROM dg1 ORDER BY 1, 2, 3"))
def rm1(b):
    return rounded(day(readmodel.executive_trend(b.trend), "full_date"))


@query("rm2_line_summary", sql("mt2", """SELECT line_id, CAST(sum(tube_count) AS BIGINT) AS tube_count, round((sum(good_tonnes) / NULLIF(sum(productive_hours), 0)) * 1.000000000001::DOUBLE, 6) AS tbh,
  round((sum(good_tonnes) / NULLIF(sum(total_tonnes), 0)) * 1.000000000001::DOUBLE, 6) AS quality, round((sum(energy_kwh) / NULLIF(sum(good_tonnes), 0)) * 1.000000000001::DOUBLE, 6) AS energy_per_good_tonne_kwh_t,
  round((sum(unplanned_downtime_minutes)) * 1.000000000001::DOUBLE, 5) AS unplanned_downtime_minutes, round((sum(oee * tube_count) / NULLIF(sum(tube_count), 0)) * 1.000000000001::DOUBLE, 6) AS oee FROM mt2 GROUP BY 1 ORDER BY 1"""))
def rm2(b):
    return rounded(readmodel.line_summary(b.shift_mart), 6, {"unplanned_downtime_minutes": 5})


@query("rm3_loss_pareto", sql("mt8", "SELECT loss_type, CAST(sum(event_count) AS BIGINT) AS event_count, round((sum(loss_tonnes_equivalent)) * 1.000000000001::DOUBLE, 4) AS loss_tonnes_equivalent FROM mt8 GROUP BY 1 ORDER BY 3 DESC"))
def rm3(b):
    return rounded(readmodel.loss_totals(b.pareto), 4)


_MONTHKEY = "strftime(strptime(CAST(date_key AS VARCHAR) || '01', '%Y%m%d'), '%Y-%m-%d')"


@query("rm4_mix_by_date", sql("dg2", f"SELECT {_MONTHKEY} AS full_date, line_id, order_count, {cols('actual_tbh mix_expected_tbh mix_adjusted_tbh_gap', 6)} FROM dg2 ORDER BY 1, 2"))
def rm4(b):
    return rounded(day(readmodel.mix_by_date(b.stored.mix), "full_date"))


@query("rm5_quality_alerts", sql("dg4", f"""SELECT * FROM (SELECT {_MONTHKEY} AS full_date, line_id, product_code, grade_family, characteristic, {cols('mean_value conformance_rate', 5)}, control_signal
  FROM dg4 WHERE limits_reliable AND control_signal) x ORDER BY full_date DESC, line_id, product_code, grade_family, characteristic LIMIT 100"""))
def rm5(b):
    return rounded(day(readmodel.quality_alerts(b.stored.quality_chart), "full_date"), 5)


@query("rm5_tight_quality_alerts", sql("dg4_tight", f"""SELECT * FROM (SELECT {_MONTHKEY} AS full_date, line_id, product_code, grade_family, characteristic, {cols('mean_value conformance_rate', 5)}, control_signal
  FROM dg4_tight WHERE limits_reliable AND control_signal) x ORDER BY full_date DESC, line_id, product_code, grade_family, characteristic LIMIT 100"""))
def rm5_tight(b):
    """The same report under narrow limits (1.5 sigma), which these data do cross."""
    return rounded(day(readmodel.quality_alerts(diagnostics.spc_quality(b.stored.quality_mart, k=1.5)), "full_date"), 5)


@query("rm6_tbh_control", sql("dg3", f"SELECT {_MONTHKEY} AS full_date, line_id, shift_id, control_signal, {cols('tbh lower_control_tbh upper_control_tbh', 6)} FROM dg3 WHERE limits_reliable ORDER BY 1, 2, 3"))
def rm6(b):
    return rounded(day(readmodel.tbh_control(b.tbh_chart), "full_date"))


@query("rm7_asset_condition", sql("mt7", f"SELECT strftime(strptime(CAST(date_key AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS full_date, line_id, {cols('mean_tool_wear_index mean_sensor_degradation_index mean_hours_since_maintenance maintenance_deferred_rate unplanned_downtime_minutes', 6)} FROM mt7 ORDER BY 1, 2"))
def rm7(b):
    return rounded(day(readmodel.asset_condition_by_date(b.condition_mart), "full_date"))


@query("rm8_interactions_and_associations", sql("dg5 dg6", f"""SELECT * FROM (SELECT product_code, grade_family, line_id, roll_speed_band, thermal_uniformity_band, {cols('mean_actual_tph fpy', 6)}, round((association_roll_speed_tph) * 1.000000000001::DOUBLE, 6) + 0.0 AS association_roll_speed_tph
  FROM dg5 JOIN dg6 USING (product_code, grade_family, line_id)) x ORDER BY 1, 2, 3, 4, 5"""))
def rm8(b):
    keys = ["product_code", "grade_family", "line_id"]
    wide = b.cells.select(*keys, "roll_speed_band", "thermal_uniformity_band", "mean_actual_tph", "fpy")
    linked = wide.join(b.segment_links.select(*keys, "association_roll_speed_tph"), keys)
    return rounded(linked.orderBy(*keys, "roll_speed_band", "thermal_uniformity_band"))


@query("rm10_monthly_by_line", sql("dg1", """SELECT strftime(date_trunc('month', full_date), '%Y-%m-%d') AS month, line_id, round((sum(good_tonnes)) * 1.000000000001::DOUBLE, 6) AS good_tonnes, round((sum(productive_hours)) * 1.000000000001::DOUBLE, 6) AS productive_hours,
  round((sum(energy_kwh)) * 1.000000000001::DOUBLE, 6) AS energy_kwh, round((avg(fpy)) * 1.000000000001::DOUBLE, 6) AS unweighted_fpy, round((sum(good_tonnes) / NULLIF(sum(productive_hours), 0)) * 1.000000000001::DOUBLE, 6) AS tbh,
  round((sum(energy_kwh) / NULLIF(sum(good_tonnes), 0)) * 1.000000000001::DOUBLE, 6) AS energy_per_good_tonne_kwh_t FROM dg1 GROUP BY 1, 2"""))
def rm10(b):
    return rounded(day(readmodel.monthly_by_line(b.trend), "month"))


@query("rm11_line_tbh", sql("dg1", """SELECT line_id, round((sum(good_tonnes)) * 1.000000000001::DOUBLE, 5) AS good_tonnes, round((sum(productive_hours)) * 1.000000000001::DOUBLE, 5) AS productive_hours, round((sum(good_tonnes) / NULLIF(sum(productive_hours), 0)) * 1.000000000001::DOUBLE, 5) AS tbh
  FROM dg1 WHERE shift_id = '1-URGENT' AND full_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1"""))
def rm11(b):
    return rounded(readmodel.line_tbh(b.trend, shift="1-URGENT", start="1996-01-01", end="1999-12-31"), 5)


@query("rm12_monthly_mix_gap", sql("dg2", f"SELECT {_MONTHKEY} AS month, line_id, round((avg(mix_adjusted_tbh_gap)) * 1.000000000001::DOUBLE, 6) + 0.0 AS mix_adjusted_tbh_gap FROM dg2 GROUP BY 1, 2"))
def rm12(b):
    return rounded(day(readmodel.monthly_mix_gap(b.stored.mix), "month"))


@query("rm13_loss_share", sql("mt8", """SELECT loss_type, round((t) * 1.000000000001::DOUBLE, 4) AS loss_tonnes_equivalent, round((t / sum(t) OVER ()) * 1.000000000001::DOUBLE, 6) AS share,
  round((sum(t) OVER (ORDER BY t DESC, loss_type ROWS UNBOUNDED PRECEDING) / sum(t) OVER ()) * 1.000000000001::DOUBLE, 6) AS cumulative_share FROM (SELECT loss_type, sum(loss_tonnes_equivalent) AS t FROM mt8 GROUP BY 1) x"""))
def rm13(b):
    return rounded(readmodel.loss_share(b.pareto), 6, {"loss_tonnes_equivalent": 4})


@query("rm14_executive_card", sql("dg1", """SELECT round((sum(good_tonnes) / greatest(sum(productive_hours), 1e-12)) * 1.000000000001::DOUBLE, 6) AS tbh, round((sum(fpy * tube_count) / greatest(sum(tube_count), 1e-12)) * 1.000000000001::DOUBLE, 6) AS fpy,
  round((sum(oee * tube_count) / greatest(sum(tube_count), 1e-12)) * 1.000000000001::DOUBLE, 6) AS oee, round((sum(energy_kwh) / greatest(sum(good_tonnes), 1e-12)) * 1.000000000001::DOUBLE, 6) AS energy_per_good_tonne_kwh_t,
  round((sum(unplanned_downtime_minutes)) * 1.000000000001::DOUBLE, 4) AS unplanned_downtime_minutes, round((sum(good_tonnes)) * 1.000000000001::DOUBLE, 4) AS good_tonnes FROM dg1"""))
def rm14(b):
    return rounded(readmodel.executive_card(b.trend), 6, {"unplanned_downtime_minutes": 4, "good_tonnes": 4})


@query("rm15_interaction_heatmap", sql("dg5", """SELECT product_code, grade_family, thermal_uniformity_band, round((avg(mean_actual_tph) FILTER (roll_speed_band = 1)) * 1.000000000001::DOUBLE, 6) AS speed_1,
  round((avg(mean_actual_tph) FILTER (roll_speed_band = 2)) * 1.000000000001::DOUBLE, 6) AS speed_2, round((avg(mean_actual_tph) FILTER (roll_speed_band = 3)) * 1.000000000001::DOUBLE, 6) AS speed_3 FROM dg5 GROUP BY 1, 2, 3"""))
def rm15(b):
    return rounded(readmodel.interaction_heatmap(b.cells, "mean_actual_tph"))
