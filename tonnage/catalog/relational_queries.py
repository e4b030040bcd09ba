"""Source, sink, projection, filter, join, aggregate, window, sort and reshape queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonnage.catalog.base import cols, query, rnd, sql
from tonnage.catalog.star_queries import TS, day, dtx, texted, tx
from tonnage.catalog.views import corr_sql
from tonnage.functions import scalar as S
from tonnage.operators import asof, lookup, ordered
from tonnage.catalog.quality_queries import EXPORT_VIEWS
from tonnage.plans import contracts, packages
from tonnage.sources import sinks, tables
from tonnage.sources.scratch import scratch


# ---- sources -------------------------------------------------------------------------------------
@query("src1_parquet_scan", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def src1(b):
    return tables.read_table(b.spark, b.sf_dir, "orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src2_named_views", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in contracts.SOURCE_TABLES))
def src2(b):
    """Every given table as a named view, read through SQL."""
    views = tables.register_layer(b.spark, {t: b.table(t) for t in contracts.SOURCE_TABLES}, "raw")
    return b.spark.sql(" UNION ALL ".join(f"SELECT '{v.removeprefix('raw_')}' AS table_name, count(*) AS rows FROM {v}" for v in views))


@query("src3_column_scan", f"SELECT l_returnflag AS m, {rnd('sum(l_quantity)')} AS x FROM lineitem GROUP BY 1")
def src3(b):
    narrow = tables.read_table(b.spark, b.sf_dir, "lineitem.parquet", columns=["l_returnflag", "l_quantity"])
    return S.rounded(narrow.groupBy(F.col("l_returnflag").alias("m")).agg(F.sum("l_quantity").alias("x")))


@query("src4_date_series", "SELECT strftime(d, '%Y-%m-%d') AS full_date FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) x")
def src4(b):
    bounds = b.table("orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return day(tables.date_series(bounds, "lo", "hi"), "full_date")


@query("src5_step_series", sql("ev_assets", "SELECT asset_id, CAST(h AS INTEGER) AS window_hour FROM ev_assets CROSS JOIN range(0, 24, 2) r(h)"))
def src5(b):
    return tables.step_series(b.event_assets.select("asset_id"), 0, 24, 2, "window_hour")


_OVER = "sum({0} * {1}) / nullif(sum({1}), 0)"
_AVAIL = "sum(productive_hours) / nullif(sum(productive_hours) + sum(unplanned_downtime_minutes) / 60.0, 0)"
_PERF = "least(sum(total_tonnes) / nullif(42.0 * sum(productive_hours), 0), 1.0)"
_QUAL = "sum(good_tonnes) / nullif(sum(total_tonnes), 0)"
_OF = "sum(CASE WHEN characteristic IN ({1}) THEN {0} * inspection_count END) / nullif(sum(CASE WHEN characteristic IN ({1}) THEN inspection_count END), 0)"
#: Formulas over the line-shift mart, and over the quality mart. The probability stays empty until a model's output is stored.
_KPI_VALUES = {
    "good_tonnes": "sum(good_tonnes)", "productive_hours": "sum(productive_hours)", "tbh": "sum(good_tonnes) / nullif(sum(productive_hours), 0)",
    "fpy": _OVER.format("fpy", "tube_count"), "availability": _AVAIL, "performance": _PERF, "quality": _QUAL, "oee": f"({_AVAIL}) * ({_PERF}) * ({_QUAL})",
    "scrap_rate": _OVER.format("scrap_rate", "tube_count"), "rework_rate": _OVER.format("rework_rate", "tube_count"),
    "energy_per_good_tonne": "sum(energy_kwh) / nullif(sum(good_tonnes), 0)", "unplanned_downtime": "sum(unplanned_downtime_minutes)",
}
_QUALITY_KPIS = {
    "outer_diameter_deviation": _OF.format("mean_value", "'outer_diameter_deviation_mm'"), "wall_eccentricity": _OF.format("mean_value", "'wall_eccentricity_pct'"),
    "ovality": _OF.format("mean_value", "'ovality_pct'"), "simulated_mechanical_conformance": _OF.format("conformance_rate", "'yield_strength_mpa', 'tensile_strength_mpa'"),
}


@query("src6_table_contracts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS primary_key, count(*) AS row_count, count(DISTINCT {k}) AS distinct_keys FROM {t}" for t, k in contracts.BOUND_KEYS.items()))
def src6(b):
    """Contract table joined with what the bound tables really hold."""
    declared = tables.literal_table(b.spark, list(contracts.BOUND_KEYS.items()), "table_name string, primary_key string")
    seen = None
    for t, k in contracts.BOUND_KEYS.items():
        one = b.table(t).groupBy(k).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("row_count"), F.count(k).alias("distinct_keys"))
        one = one.withColumn("table_name", F.lit(t))
        seen = one if seen is None else seen.unionByName(one)
    return declared.join(seen, "table_name")


_AS_DOUBLE = lambda e: e.replace("60.0", "60.0::DOUBLE").replace("42.0", "42.0::DOUBLE").replace("1.0)", "1.0::DOUBLE)")


@query("mt9_kpi_catalog", sql("mt2 mt4", "SELECT kpi_name, value FROM (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS kpi_name, {rnd(_AS_DOUBLE(e), 4)} AS value FROM {t}" for t, kpis in (("mt2", _KPI_VALUES), ("mt4", _QUALITY_KPIS)) for n, e in kpis.items()]
    + ["SELECT 'next_window_downtime_probability', NULL::DOUBLE"]) + ") k"))
def mt9(b):
    """All catalogue entries with the value each KPI has on the data (null while nothing defines one)."""
    catalogue = tables.literal_table(b.spark, [(n,) for n in contracts.KPI_NAMES], "kpi_name string")
    long = None
    for mart, kpis in ((b.stored.shift_mart, _KPI_VALUES), (b.stored.quality_mart, _QUALITY_KPIS)):
        part = mart.agg(*[F.expr(e).cast("double").alias(n) for n, e in kpis.items()]).unpivot([], list(kpis), "kpi_name", "value")
        long = part if long is None else long.unionByName(part)
    return S.rounded(catalogue.join(long, "kpi_name", "left"), 4)


@query("src7_document_scan")
def src7(b):
    """Conversations written as JSON documents, read back under a declared schema and filtered."""
    path = f"{scratch(b.spark)}/documents"
    docs = b.table("conversations").select(F.concat(F.lit("c"), "conv_id").alias("context_id"), F.col("role").alias("scenario_label"), "turn", F.length("text").alias("size"))
    docs.write.mode("overwrite").json(path)
    back = b.spark.read.schema("context_id string, scenario_label string, turn int, size int").json(path)
    return tables.scenario_documents(back, label="user")


# ---- sinks ---------------------------------------------------------------------------------------
@query("snk1_curated_copy", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in contracts.SOURCE_TABLES))
def snk1(b):
    return sinks.export_package({t: b.table(t) for t in contracts.SOURCE_TABLES}, scratch(b.spark), ("parquet",))


def _counted(views):
    """SQL row counts of exported tables, from table name to view."""
    return sql(" ".join(dict.fromkeys(views.values())), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {v}" for t, v in views.items()))


@query("snk2_partitioned_write", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def snk2(b):
    path = f"{scratch(b.spark)}/orders"
    sinks.write_partitioned(b.table("orders"), path, "o_orderdate")
    # recursive lookup hides the partition directory again, so the month comes from the data
    back = tables.read_table(b.spark, path, schema=b.table("orders").schema)
    return back.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("snk3_bi_export", _counted({t: EXPORT_VIEWS[t] for t in packages.BI_TABLES}))
def snk3(b):
    return sinks.export_package(packages.package(b.stored, packages.BI_TABLES), scratch(b.spark))


@query("snk4_diagnostic_export", _counted({t: EXPORT_VIEWS[t] for t in packages.DIAGNOSTIC_TABLES}))
def snk4(b):
    return sinks.export_package(packages.package(b.stored, packages.DIAGNOSTIC_TABLES), scratch(b.spark))


@query("snk5_feature_package", sql("pt1 pt3 pt6 mt1", "SELECT s || '_' || t AS table_name, count(*) AS rows FROM (SELECT 'pre_order' AS s FROM pt1 JOIN mt1 USING (order_id) UNION ALL SELECT 'asset_window' FROM pt3 JOIN pt6 USING (window_id)) k "
    "CROSS JOIN (VALUES ('X'), ('index'), ('y')) v(t) GROUP BY 1"))
def snk5(b):
    return sinks.export_package(packages.feature_package(b.stored), scratch(b.spark), ("parquet",))


@query("snk6_fingerprint")
def snk6(b):
    return sinks.fingerprint(b.table("lineitem"))


@query("snk7_bi_views", _counted({t: EXPORT_VIEWS[t] for t in packages.BI_TABLES}))
def snk7(b):
    """Every table of the BI package as a named view, read through SQL."""
    views = tables.register_layer(b.spark, packages.package(b.stored, packages.BI_TABLES), "bi")
    return b.spark.sql(" UNION ALL ".join(f"SELECT '{v.removeprefix('bi_')}' AS table_name, count(*) AS rows FROM {v}" for v in views))


@query("snk9_flat_rows")
def snk9(b):
    """Nested rows flattened to prefixed columns."""
    nested = b.table("part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("parameter"),
                                    F.struct(F.struct((F.col("p_retailprice") * 0.8).alias("p10"), F.col("p_retailprice").alias("p50")).alias("price")).alias("prediction"))
    return nested.select(F.col("p_partkey").alias("scenario_id"), F.col("parameter.size").alias("parameter__size"), F.col("parameter.price").alias("parameter__price"),
                         F.col("prediction.price.p10").alias("prediction__price__p10"), F.col("prediction.price.p50").alias("prediction__price__p50"))


# ---- projections and filters ---------------------------------------------------------------------
@query("prj1_projection", "SELECT *, o_totalprice / 1000.0::DOUBLE AS price_k FROM (SELECT o_orderkey AS order_id, o_orderstatus, o_totalprice FROM orders) x")
def prj1(b):
    return b.table("orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus", "o_totalprice").withColumn("price_k", F.col("o_totalprice") / 1000.0)


@query("prj2_date_key", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key FROM orders")
def prj2(b):
    return b.table("orders").select("o_orderkey", S.period_key("o_orderdate").alias("date_key"))


@query("prj3_case_split", f"SELECT l_linestatus, {rnd('sum(CASE WHEN l_returnflag = ' + repr('N') + ' THEN l_quantity ELSE 0.0 END)')} AS rework_t, {rnd('sum(CASE WHEN l_returnflag = ' + repr('R') + ' THEN l_quantity ELSE 0.0 END)')} AS scrap_t FROM lineitem GROUP BY 1")
def prj3(b):
    part = lambda c: F.sum(F.when(F.col("l_returnflag") == c, F.col("l_quantity")).otherwise(0.0))
    return S.rounded(b.table("lineitem").groupBy("l_linestatus").agg(part("N").alias("rework_t"), part("R").alias("scrap_t")))


@query("prj4_safe_ratio", f"SELECT l_orderkey, {rnd('sum(l_extendedprice) / NULLIF(sum(CASE WHEN l_returnflag = ' + repr('A') + ' THEN l_quantity ELSE 0.0 END), 0)')} AS price_per_good FROM lineitem GROUP BY 1")
def prj4(b):
    good = F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0))
    return S.rounded(b.table("lineitem").groupBy("l_orderkey").agg(S.safe_ratio(F.sum("l_extendedprice"), good).alias("price_per_good")))


@query("prj5_capped_ratio", f"SELECT o_orderkey, {rnd('least(o_totalprice / 250000.0::DOUBLE, 1.0::DOUBLE)')} AS capped, {rnd('greatest(o_totalprice - 250000.0::DOUBLE, 0.0::DOUBLE)')} AS above FROM orders")
def prj5(b):
    return S.rounded(b.table("orders").select("o_orderkey", S.capped(F.col("o_totalprice") / 250000.0, 1.0).alias("capped"), S.floored(F.col("o_totalprice") - 250000.0, 0.0).alias("above")))


@query("flt1_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def flt1(b):
    return b.table("orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")


@query("flt2_domain", "SELECT count(*) FILTER (p_type IN ('ECONOMY', 'SMALL')) AS inside, count(*) FILTER (p_type NOT IN ('ECONOMY', 'SMALL')) AS outside FROM part")
def flt2(b):
    known = F.col("p_type").isin("ECONOMY", "SMALL")
    return b.table("part").agg(F.count_if(known).alias("inside"), F.count_if(~known).alias("outside"))


@query("flt3_range", "SELECT count(*) AS outside FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45 OR l_discount NOT BETWEEN 0.01 AND 0.09")
def flt3(b):
    bad = ~F.col("l_quantity").between(5, 45) | ~F.col("l_discount").between(0.01, 0.09)
    return b.table("lineitem").filter(bad).agg(F.count(F.lit(1)).alias("outside"))


@query("flt4_null_state", sql("sensors", "SELECT missingness_type, count(*) FILTER (mean_value IS NULL) AS missing, count(*) FILTER (mean_value IS NOT NULL) AS present FROM sensors GROUP BY 1"))
def flt4(b):
    return b.sensor_windows.groupBy("missingness_type").agg(F.count_if(F.col("mean_value").isNull()).alias("missing"), F.count_if(F.col("mean_value").isNotNull()).alias("present"))


@query("flt6_positive_shares", f"SELECT user_id, event_type, {rnd('t / sum(t) OVER (PARTITION BY user_id)')} AS share FROM (SELECT user_id, event_type, sum(value - 20) AS t FROM events GROUP BY 1, 2) x WHERE t > 0")
def flt6(b):
    sums = b.table("events").groupBy("user_id", "event_type").agg(F.sum(F.col("value") - 20).alias("t")).filter(F.col("t") > 0)
    return S.rounded(sums.select("user_id", "event_type", S.safe_ratio("t", F.sum("t").over(Window.partitionBy("user_id"))).alias("share")))


@query("flt7_coverage", sql("grid", f"SELECT window_id, {tx('snapshot_ts')} FROM grid WHERE snapshot_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)"))
def flt7(b):
    end = b.table("events").agg(F.max("ts").alias("t")).scalar()
    kept = b.windows.filter(S.add_seconds("snapshot_ts", "7200") <= end)
    return texted(kept.select("window_id", "snapshot_ts"), "snapshot_ts")


@query("flt8_slice_filter", "SELECT o_orderpriority AS shift_id, strftime(o_orderdate, '%Y-%m-%d') AS full_date, o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'")
def flt8(b):
    from tonnage.plans.readmodel import slice_filter

    df = b.table("orders").select(F.col("o_orderpriority").alias("shift_id"), F.to_date("o_orderdate").alias("full_date"), "o_orderkey")
    return day(slice_filter(df, shift="2-HIGH", start="1997-01-01", end="1998-06-30"), "full_date")


@query("flt9_tolerance", "SELECT count(*) AS off FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > greatest(0.5 * greatest(abs(l_extendedprice), abs(l_quantity * p_retailprice)), 1e-8)")
def flt9(b):
    both = b.table("lineitem").join(b.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.filter(~S.close_to("l_extendedprice", F.col("l_quantity") * F.col("p_retailprice"), relative=0.5)).agg(F.count(F.lit(1)).alias("off"))


# ---- joins ---------------------------------------------------------------------------------------
@query("jn1_star_join", sql("tubes dim_product dim_line dim_shift", f"SELECT product_key, line_key, shift_key, count(*) AS n, {rnd('sum(good_mass_t)')} AS good FROM tubes JOIN dim_product USING (product_code) JOIN dim_line USING (line_id) JOIN dim_shift USING (shift_id) GROUP BY 1, 2, 3"))
def jn1(b):
    return S.rounded(b.production.groupBy("product_key", "line_key", "shift_key").agg(F.count(F.lit(1)).alias("n"), F.sum("good_mass_t").alias("good")))


@query("jn2_fact_join", sql("fp quality_results", "SELECT fp.line_id, q.characteristic, count(*) AS n FROM quality_results q JOIN fp USING (tube_id) GROUP BY 1, 2"))
def jn2(b):
    return b.quality_results.join(b.production.select("tube_id", "line_id"), "tube_id").groupBy("line_id", "characteristic").agg(F.count(F.lit(1)).alias("n"))


@query("jn3_derived_key", sql("downtime ev_shifts", f"SELECT s.shift_id, count(*) AS n, {rnd('sum(duration_minutes)')} AS minutes FROM downtime JOIN ev_shifts s ON start_hour = 8 * floor(hour(event_start_ts) / 8) GROUP BY 1"))
def jn3(b):
    keyed = b.downtime_events.withColumn("start_hour", S.shift_start_hour("event_start_ts")).join(b.event_shifts, "start_hour")
    return S.rounded(keyed.groupBy("shift_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_minutes").alias("minutes")))


@query("jn4_left_chain", sql("fd fm", """SELECT line_key, date_key, n, coalesce(m.works, 0) AS works, coalesce(w.wear, 0) AS views FROM (SELECT line_key, date_key, count(*) AS n FROM fd GROUP BY 1, 2) d
  LEFT JOIN (SELECT line_key, date_key, count(*) AS works FROM fm WHERE maintenance_type = 'CORRECTIVE' GROUP BY 1, 2) m USING (line_key, date_key)
  LEFT JOIN (SELECT line_key, date_key, count(*) AS wear FROM fm WHERE was_deferred GROUP BY 1, 2) w USING (line_key, date_key)"""))
def jn4(b):
    keys = ["line_key", "date_key"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    joined = count(b.downtime, "n").join(count(b.maintenance.filter("maintenance_type = 'CORRECTIVE'"), "works"), keys, "left").join(count(b.maintenance.filter("was_deferred"), "views"), keys, "left")
    return joined.fillna(0, ["works", "views"])


@query("jn5_full_outer", "SELECT k, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (k)")
def jn5(b):
    left = b.table("customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    right = b.table("supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return left.join(right, "k", "full").fillna(0)


@query("jn6_recovered_label", "SELECT coalesce(c.k, s.k) AS nation_key, n_name FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000) s ON c.k = s.k LEFT JOIN nation ON n_nationkey = coalesce(c.k, s.k)")
def jn6(b):
    left = b.table("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("a")).distinct()
    right = b.table("supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("z")).distinct()
    both = left.join(right, F.col("a") == F.col("z"), "full").withColumn("nation_key", F.coalesce("a", "z"))
    return both.join(b.table("nation"), F.col("nation_key") == F.col("n_nationkey"), "left").select("nation_key", "n_name")


@query("jn7_grid", sql("grid", f"SELECT asset_id, count(*) AS windows, strftime(min(snapshot_ts), {TS}) AS first_ts, strftime(max(snapshot_ts), {TS}) AS last_ts FROM grid GROUP BY 1"))
def jn7(b):
    g = b.windows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("windows"), F.min("snapshot_ts").alias("first_ts"), F.max("snapshot_ts").alias("last_ts"))
    return texted(g, "first_ts", "last_ts")


@query("jn8_scalar_cutoff", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def jn8(b):
    o = b.table("orders")
    return o.filter(F.col("o_totalprice") > o.agg(F.avg("o_totalprice").alias("m")).scalar()).select("o_orderkey", "o_totalprice")


@query("jn9_asof", "SELECT e.event_id, strftime((SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts <= e.ts), " + TS + ") AS last_signup FROM events e WHERE event_type = 'view'")
def jn9(b):
    e = b.table("events")
    known = asof.asof_last(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts")), ["user_id"], "ts", "signup_ts", "last_signup")
    return texted(known.select("event_id", "last_signup"), "last_signup")


@query("jn10_lookback", sql("pt3", f"SELECT window_id, prior_7d_downtime_events, prior_30d_downtime_events, {cols('prior_7d_downtime_minutes prior_30d_downtime_minutes')} FROM pt3".replace("prior_7d_downtime_minutes, prior_30d_downtime_minutes FROM", f"{rnd('prior_7d_downtime_minutes')} AS prior_7d_downtime_minutes, {rnd('prior_30d_downtime_minutes')} AS prior_30d_downtime_minutes FROM")))
def jn10(b):
    specs = [asof.Lookback("prior_7d_downtime_events", "count", days=7), asof.Lookback("prior_7d_downtime_minutes", "sum", "duration_minutes", 7),
             asof.Lookback("prior_30d_downtime_events", "count", days=30), asof.Lookback("prior_30d_downtime_minutes", "sum", "duration_minutes", 30)]
    grid = b.windows.select("window_id", "asset_id", "snapshot_ts")
    return S.rounded(asof.lookback_agg(grid, [asof.EventSource(b.downtime_events, "event_end_ts", specs)], "asset_id", "snapshot_ts", 7200).drop("asset_id", "snapshot_ts"))


@query("jn11_lookahead", sql("grid downtime", f"SELECT window_id, count(d.downtime_event_id) AS events, {rnd('sum(d.duration_minutes)')} AS minutes FROM grid g LEFT JOIN downtime d ON d.asset_id = g.asset_id AND event_start_ts >= snapshot_ts AND event_start_ts < snapshot_ts + INTERVAL 2 HOUR GROUP BY 1"))
def jn11(b):
    aggs = [F.count(F.lit(1)).alias("events"), F.sum("duration_minutes").alias("minutes")]
    ahead = asof.lookahead_agg(b.windows.select("window_id", "asset_id", "snapshot_ts"), b.downtime_events, "asset_id", "snapshot_ts", "event_start_ts", 7200, aggs)
    return S.rounded(ahead.select("window_id", F.coalesce("events", F.lit(0)).alias("events"), "minutes"))


@query("jn12_availability_join", sql("sensors ev", "SELECT s.tube_id, count(*) AS usable FROM sensors s JOIN (SELECT user_id AS tube_id, max(ts) AS snapshot_ts FROM ev WHERE event_type = 'purchase' GROUP BY 1) r USING (tube_id) WHERE feature_available_at_ts <= snapshot_ts GROUP BY 1"))
def jn12(b):
    ends = b.stage_events.groupBy("tube_id").agg(F.max("event_end_ts").alias("snapshot_ts"))
    return b.sensor_windows.join(ends, "tube_id").filter("feature_available_at_ts <= snapshot_ts").groupBy("tube_id").agg(F.count(F.lit(1)).alias("usable"))


@query("jn13_orphans", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def jn13(b):
    return b.table("documents").join(b.table("labels"), "doc_id", "left_anti").select("doc_id")


@query("jn14_key_difference", "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_right FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def jn14(b):
    l = b.table("lineitem")
    left = l.filter("l_quantity > 40").select(F.col("l_partkey").alias("a")).distinct()
    right = l.filter(F.col("l_discount") > 0.09).select(F.col("l_partkey").alias("z")).distinct()
    both = left.join(right, F.col("a") == F.col("z"), "full").filter("a IS NULL OR z IS NULL")
    return both.select(F.coalesce("a", "z").alias("k"), F.col("a").isNull().alias("only_right"))


@query("jn15_one_to_one", "SELECT count(*) AS matched, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS duplicates_left, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS duplicates_right FROM documents JOIN labels USING (doc_id)")
def jn15(b):
    d, l = b.table("documents").select("doc_id"), b.table("labels")
    extra = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("x")).scalar()
    return d.join(l, "doc_id").agg(F.count(F.lit(1)).alias("matched")).select("matched", extra(d).alias("duplicates_left"), extra(l).alias("duplicates_right"))


@query("jn16_lookup_fallback", f"SELECT o_orderkey, {rnd('coalesce(m, (SELECT avg(o_totalprice) FROM orders))')} AS estimate FROM orders LEFT JOIN (SELECT o_custkey AS k, o_orderpriority AS p, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) s ON k = o_custkey AND p = o_orderpriority")
def jn16(b):
    o = b.table("orders")
    keys = ["o_custkey", "o_orderpriority"]
    stats = lookup.conditioned_stat(o.filter("o_orderstatus = 'F'"), "o_totalprice", keys, "mean")
    fallback = lookup.global_stat(o, "o_totalprice", "mean").scalar()
    return S.rounded(lookup.apply_conditioned(o, stats, keys, fallback).select("o_orderkey", "estimate"))


_LEVELS = (("product_code", "grade_family", "line_id", "shift_id"), ("product_code", "grade_family", "line_id"), ("product_code", "grade_family"), ("grade_family", "line_id"))


def _levels_sql(minimum: int) -> str:
    joins, cases, supports = [], [], []
    for i, keys in enumerate(_LEVELS):
        k = ", ".join(keys)
        joins.append(f"LEFT JOIN (SELECT {k}, count(*) AS n{i} FROM tubes GROUP BY {k}) s{i} USING ({k})")
        cases.append(f"WHEN n{i} >= {minimum} THEN {i + 1}")
        supports.append(f"WHEN n{i} >= {minimum} THEN n{i}")
    return (f"SELECT product_code, grade_family, line_id, shift_id, CASE {' '.join(cases)} END AS level, CASE {' '.join(supports)} END AS support "
            f"FROM (SELECT DISTINCT product_code, grade_family, line_id, shift_id FROM tubes) c {' '.join(joins)}")


@query("jn17_hierarchical_fallback", sql("tubes", _levels_sql(150)))
def jn17(b):
    contexts = b.tubes.select(*_LEVELS[0]).distinct()
    return lookup.fallback_support(b.tubes, contexts, _LEVELS, 150)


# ---- aggregations --------------------------------------------------------------------------------
def _agg(name, table, by, exprs, digits=6):
    """Aggregation written once: the expressions below mean the same in both engines."""
    body = ", ".join(f"{rnd(e[1:], digits)} AS {n}" if e.startswith("~") else f"{e} AS {n}" for n, e in exprs.items())
    text = f"SELECT {by + ', ' if by else ''}{body} FROM {table}" + (f" GROUP BY {by}" if by else "")

    def plan(b):
        aggs = [F.expr(e.lstrip("~")).alias(n) for n, e in exprs.items()]
        df = b.table(table)
        return S.rounded(df.groupBy(*by.split(", ")).agg(*aggs) if by else df.agg(*aggs), digits)

    query(name, text)(plan)


_agg("ag1_group_aggregates", "lineitem", "l_returnflag, l_linestatus", {"n": "count(*)", "qty": "~sum(l_quantity)", "low": "min(l_extendedprice)", "high": "max(l_extendedprice)", "mean": "~avg(l_extendedprice)"})
_agg("ag2_attribute_carry", "orders", "o_custkey", {"first_priority": "min(o_orderpriority)", "first_status": "min(o_orderstatus)"})
_agg("ag3_flag_rate", "lineitem", "l_suppkey", {"good_rate": "~avg(CAST(l_returnflag = 'A' AS INT))"}, 7)
_agg("ag4_conditional_count", "lineitem", "l_partkey", {"rework": "count(CASE WHEN l_returnflag = 'N' THEN 1 END)"})
_agg("ag5_filtered_aggregate", "events", "user_id", {"views": "~avg(value) FILTER (WHERE event_type = 'view')", "top_click": "max(value) FILTER (WHERE event_type = 'click')"})
_agg("ag6_deviation", "events", "user_id, event_type", {"pop": "~stddev_pop(value)", "samp": "~stddev_samp(value)"})
_agg("ag16_distinct_count", "lineitem", "l_returnflag", {"parts": "count(DISTINCT l_partkey)", "suppliers": "count(DISTINCT l_suppkey)"})
_agg("ag19_spread", "orders", "o_orderpriority", {"spread": "~max(o_totalprice) - min(o_totalprice)"})
_agg("ag20_value_counts", "events", "event_type", {"n": "count(*)"})
_agg("ag22_global_aggregate", "lineitem", "", {"n": "count(*)", "qty": "~sum(l_quantity)", "disc": "~avg(l_discount)"})


@query("ag7_exact_median", f"SELECT o_orderpriority, {rnd('median(o_totalprice)')} AS median_price FROM orders GROUP BY 1")
def ag7(b):
    return S.rounded(ordered.exact_quantiles(b.table("orders"), ["o_orderpriority"], "o_totalprice", {"median_price": 0.5}))


@query("ag8_discrete_quantile", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.30) AS p30 FROM orders GROUP BY 1")
def ag8(b):
    return ordered.exact_quantiles(b.table("orders"), ["o_orderstatus"], "o_totalprice", {"p30": 0.30}, "disc")


@query("ag9_continuous_quantiles", f"SELECT l_returnflag, {rnd('quantile_cont(l_extendedprice, 0.02)')} AS p02, {rnd('quantile_cont(l_extendedprice, 0.98)')} AS p98, {rnd('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1")
def ag9(b):
    return S.rounded(ordered.exact_quantiles(b.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"p02": 0.02, "p98": 0.98, "p95": 0.95}))


@query("ag10_correlation", f"SELECT l_suppkey, {rnd(corr_sql('l_quantity', 'l_extendedprice'))} AS r FROM lineitem GROUP BY 1")
def ag10(b):
    return S.rounded(b.table("lineitem").groupBy("l_suppkey").agg(S.safe_corr("l_quantity", "l_extendedprice").alias("r")))


_RANK = "rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2.0::DOUBLE"


@query("ag11_spearman", f"SELECT l_returnflag, count(*) AS pairs, {rnd(corr_sql('a', 'b'))} AS rho FROM (SELECT l_returnflag, {_RANK.format('l_quantity')} AS a, {_RANK.format('l_extendedprice')} AS b FROM lineitem) r GROUP BY 1")
def ag11(b):
    from tonnage.plans.audit import spearman

    return S.rounded(spearman(b.table("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("ag12_slope", f"SELECT o_orderpriority, {rnd('regr_slope(o_totalprice, o_custkey)', 6)} AS slope FROM orders GROUP BY 1")
def ag12(b):
    return S.rounded(b.table("orders").groupBy("o_orderpriority").agg(F.regr_slope("o_totalprice", F.col("o_custkey").cast("double")).alias("slope")))


@query("ag13_two_stage", f"SELECT o_orderpriority, {rnd('sum(p) / sum(n)')} AS price_per_order FROM (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1, 2) x GROUP BY 1")
def ag13(b):
    first = b.table("orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n"))
    return S.rounded(first.groupBy("o_orderpriority").agg(S.safe_ratio(F.sum("p"), F.sum("n")).alias("price_per_order")))


@query("ag14_weighted_mean", f"SELECT l_returnflag, {rnd('sum(l_discount * l_extendedprice) / NULLIF(sum(l_extendedprice), 0)', 8)} AS weighted_discount FROM lineitem GROUP BY 1")
def ag14(b):
    return S.rounded(b.table("lineitem").groupBy("l_returnflag").agg(S.safe_ratio(F.sum(F.col("l_discount") * F.col("l_extendedprice")), F.sum("l_extendedprice")).alias("weighted_discount")), 8)


@query("ag15_repeated_measure", sql("energy_events", f"SELECT stage_name, order_id % 10 AS bucket, {rnd('sum(good_mass_t) / 3.0::DOUBLE')} AS good FROM energy_events GROUP BY 1, 2"))
def ag15(b):
    return S.rounded(b.energy_events.groupBy("stage_name", (F.col("order_id") % 10).alias("bucket")).agg((F.sum("good_mass_t") / 3.0).alias("good")))


@query("ag17_having", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ag17(b):
    return b.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("ag18_all_keys", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def ag18(b):
    return b.table("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("ag21_fold_summary", f"SELECT event_type, {rnd('avg(m)')} AS mean, {rnd('stddev_pop(m)')} AS sd, {rnd('min(m)')} AS low, {rnd('max(m)')} AS high FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) f GROUP BY 1")
def ag21(b):
    folds = b.table("events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return S.rounded(folds.groupBy("event_type").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.min("m").alias("low"), F.max("m").alias("high")))


# ---- windows -------------------------------------------------------------------------------------
@query("wn1_surrogate_key", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS order_number FROM orders")
def wn1(b):
    return ordered.row_numbers(b.table("orders").select("o_orderkey", "o_custkey"), [], "o_orderkey", name="order_number")


@query("wn2_lag", sql("mt2", f"SELECT line_key, shift_key, date_key, {rnd('tbh - lag(tbh) OVER (PARTITION BY line_key, shift_key ORDER BY date_key)')} AS change FROM mt2"))
def wn2(b):
    past = Window.partitionBy("line_key", "shift_key").orderBy("date_key")
    return S.rounded(b.shift_mart.select("line_key", "shift_key", "date_key", (F.col("tbh") - F.lag("tbh").over(past)).alias("change")))


@query("wn3_partition_share", f"SELECT o_orderpriority, o_orderstatus, {rnd('t / sum(t) OVER (PARTITION BY o_orderpriority)')} AS share FROM (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) x")
def wn3(b):
    t = b.table("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("t"))
    return S.rounded(t.select("o_orderpriority", "o_orderstatus", S.safe_ratio("t", F.sum("t").over(Window.partitionBy("o_orderpriority"))).alias("share")))


@query("wn4_running_sum", f"SELECT user_id, {TS and 'strftime(ts, ' + TS + ')'} AS ts, {rnd('sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)', 5)} AS running FROM events")
def wn4(b):
    return S.rounded(texted(ordered.running(b.table("events"), ["user_id"], "ts", {"running": ("sum", "value")}), "ts"), 5)


@query("wn5_ntile", "SELECT o_orderkey, CAST(ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS band FROM orders")
def wn5(b):
    return ordered.tiles(b.table("orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 3, "band").select("o_orderkey", "band")


@query("wn6_cumulative_share", f"SELECT p_brand, {rnd('sum(t) OVER (ORDER BY t DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(t) OVER ()')} AS cumulative_share FROM (SELECT p_brand, sum(p_retailprice) AS t FROM part GROUP BY 1) x")
def wn6(b):
    t = b.table("part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("t"))
    cumulative = ordered.running(t, [], "t", {"c": ("sum", "t")}, descending=True, totals=True)
    return S.rounded(t.join(cumulative, "t").select("p_brand", S.safe_ratio("c", "c_total").alias("cumulative_share")))


@query("wn7_range_frame", sql("pt3", f"SELECT window_id, {rnd('prior_mean_tool_wear')} AS wear_7d FROM pt3"))
def wn7(b):
    spec = [asof.Lookback("wear_7d", "avg", "tool_wear_index", 7)]
    source = asof.EventSource(b.event_process, "process_start_ts", spec, closed="left")
    return S.rounded(asof.lookback_agg(b.windows.select("window_id", "line_id", "snapshot_ts"), [source], "line_id", "snapshot_ts", 7200).select("window_id", "wear_7d"))


@query("wn8_average_rank", "SELECT DISTINCT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS average_rank FROM lineitem")
def wn8(b):
    return ordered.average_ranks(b.table("lineitem"), ["l_returnflag"], "l_quantity", "average_rank").drop("average_rank_ties")


@query("wn9_ranked_cut", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) x WHERE r <= greatest(1, ceil(n * 0.05))")
def wn9(b):
    ranked = ordered.row_numbers(b.table("orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice", "o_orderkey", descending=True, name="r", total="n")
    return ranked.filter(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.05)))).select("o_orderkey")


@query("wn10_top_per_group", "SELECT o_custkey, o_orderkey, r AS position FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3")
def wn10(b):
    ranked = ordered.row_numbers(b.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", descending=True, name="position")
    return ranked.filter("position <= 3").select("o_custkey", "o_orderkey", "position")


# ---- sorts, limits, samples ----------------------------------------------------------------------
@query("sr1_multi_key_sort", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY 1, 2")
def sr1(b):
    return b.table("orders").select("o_orderpriority", "o_orderkey").orderBy("o_orderpriority", "o_orderkey")


@query("sr2_total_order", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY ALL")
def sr2(b):
    s = b.table("supplier")
    return s.orderBy(*s.columns)


@query("sr3_top_one", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 1")
def sr3(b):
    return b.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(1)


@query("sr4_latest_rows", f"SELECT * FROM (SELECT event_id, strftime(ts, {TS}) AS ts, value FROM events WHERE event_type = 'error') x ORDER BY ts DESC, event_id LIMIT 100")
def sr4(b):
    newest = b.table("events").filter("event_type = 'error'").orderBy(F.col("ts").desc(), "event_id").limit(100)
    return texted(newest.select("event_id", "ts", "value"), "ts")


@query("sr5_head_of_ranked", "SELECT p_type, p_brand, n FROM (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) x WHERE r <= 5")
def sr5(b):
    n = b.table("part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return ordered.row_numbers(n, ["p_type"], "n", "p_brand", descending=True, name="r").filter("r <= 5").drop("r")


@query("sr6_even_sample", "SELECT o_orderkey, r FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders) x WHERE r IN (SELECT CAST(floor(i * (n - 1) / 499.0) AS BIGINT) + 1 FROM range(0, 500) t(i))")
def sr6(b):
    from tonnage.plans.explain import even_sample

    return even_sample(b.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 500).select("o_orderkey", "r")


@query("sr7_slicer_values", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def sr7(b):
    from tonnage.plans.readmodel import slicer_values

    return slicer_values(b.table("orders"), "o_orderpriority")


@query("sr8_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def sr8(b):
    return b.table("orders").orderBy("o_orderkey").limit(1000).select("o_orderkey", "o_totalprice")


# ---- set operations and reshaping ----------------------------------------------------------------
@query("st1_union_all", sql("losses", f"SELECT loss_type, count(*) AS cells, CAST(sum(event_count) AS BIGINT) AS events, {rnd('sum(loss_tonnes_equivalent)', 4)} AS tonnes FROM losses GROUP BY 1"))
def st1(b):
    from tonnage.plans.marts import losses

    return S.rounded(losses(b.production, b.stop_facts).groupBy("loss_type").agg(F.count(F.lit(1)).alias("cells"), F.sum("event_count").alias("events"), F.sum("loss_tonnes_equivalent").alias("tonnes")), 4)


@query("st3_concatenate", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier")
def st3(b):
    left = b.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    right = b.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return left.unionByName(right, allowMissingColumns=True)


@query("st4_drop_duplicates", "SELECT DISTINCT l_partkey, l_quantity FROM lineitem")
def st4(b):
    return b.table("lineitem").select("l_partkey", "l_quantity").dropDuplicates(["l_partkey", "l_quantity"])


@query("st5_pivot", "SELECT p_brand, " + ", ".join(f"{rnd(f'avg(p_retailprice) FILTER (p_type = {chr(39)}{t}{chr(39)})')} AS {t.lower()}" for t in ("ECONOMY", "STANDARD", "SMALL")) + " FROM part GROUP BY 1")
def st5(b):
    wide = b.table("part").groupBy("p_brand").pivot("p_type", ["ECONOMY", "STANDARD", "SMALL"]).agg(F.avg("p_retailprice"))
    return S.rounded(wide.toDF("p_brand", "economy", "standard", "small"))


@query("st6_unpivot", "SELECT s_suppkey, 'balance' AS measure, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def st6(b):
    s = b.table("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "measure", "value")


@query("st7_keyed_assembly", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def st7(b):
    return b.table("documents").select("doc_id", "lang").join(b.table("labels"), "doc_id")


@query("st8_explode_json", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def st8(b):
    parsed = b.table("events").withColumn("p", F.from_json("props", "k bigint")).select("event_type", F.explode(F.array("p.k")).alias("k"))
    return parsed.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


# ---- scalar functions ----------------------------------------------------------------------------
@query("fn_calendar", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(week(o_orderdate) AS INTEGER) AS w, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, dayname(o_orderdate) AS name, strftime(o_orderdate, '%Y-%m') AS ym, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders")
def fn_calendar(b):
    d = F.col("o_orderdate")
    return b.table("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.weekofyear(d).alias("w"), (F.dayofweek(d) - 1).alias("dow"), F.date_format(d, "EEEE").alias("name"), F.date_format(d, "yyyy-MM").alias("ym"), F.hour(d).alias("h"))


@query("fn_hour_boundaries", sql("ev", "SELECT event_id, date_diff('hour', ts, end_ts) AS hours FROM ev"))
def fn_hours(b):
    e = b.table("events").withColumn("end_ts", S.add_seconds("ts", "floor(value * 60)"))
    return e.select("event_id", S.hour_boundaries("ts", "end_ts").alias("hours"))


@query("fn_math", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rnd('sqrt(l_extendedprice)')} AS root, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS cents, CAST(ceil(l_quantity / 7) AS BIGINT) AS boxes, abs(l_quantity - 25) AS off FROM lineitem")
def fn_math(b):
    q = F.col("l_quantity")
    return S.rounded(b.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sqrt("l_extendedprice").alias("root"), F.floor(F.col("l_discount") * 100 + 0.5).alias("cents"), F.ceil(q / 7).alias("boxes"), F.abs(q - 25).alias("off")))


@query("fn_hash_id", "SELECT o_orderkey, 'ORD-' || upper(substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus)), 1, 20)) AS id FROM orders")
def fn_hash(b):
    return b.table("orders").select("o_orderkey", S.hash_id("ORD", ["o_orderkey", "o_orderstatus"]).alias("id"))


@query("fn_strings", "SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS code, replace(lower(s_name), 'supplier#', '') AS short FROM supplier")
def fn_strings(b):
    return b.table("supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("code"), S.strip_prefix("s_name", "supplier#").alias("short"))


@query("fn_nested_json")
def fn_nested(b):
    """Parameters as a map, constraints as an array of structs, and a canonical hash of the fixed context."""
    c = b.table("customer")
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.struct(F.col(n).cast("double").alias("value"), F.lit("u").alias("unit")).alias("v")) for n in ("c_acctbal", "c_nationkey")]))
    return c.select("c_custkey", F.to_json(entries).alias("parameters"), F.sha2(F.to_json(F.struct("c_mktsegment", "c_nationkey")), 256).alias("context_hash"))


@query("fn_bins", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' WHEN p_size < 51 THEN 'large' END AS left_closed, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'mid' ELSE 'large' END AS right_closed FROM part")
def fn_bins(b):
    inf, names = float("inf"), ["small", "mid", "large"]
    return b.table("part").select("p_partkey", S.bands("p_size", [0, 10, 30, 51], names).alias("left_closed"), S.bands("p_size", [-inf, 10, 30, inf], names, right=True).alias("right_closed"))
