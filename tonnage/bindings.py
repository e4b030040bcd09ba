"""Roles the generic tables play for the manufacturing plans.

Two plants: the *order plant* reads lineitem/orders/part/supplier/customer (production, quality, energy, process
and stop facts); the *event plant* reads events (assets, calendar, downtime, maintenance, process, orders,
sensors). Every frame is lazy and covers its whole source table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonnage.functions.scalar import add_seconds
from tonnage.sources.tables import literal_table

CHARACTERISTICS = (
    # name, measured column, lower limit, upper limit, unit
    ("outer_diameter_deviation_mm", "l_discount", 0.0, 0.08, "mm"),
    ("wall_eccentricity_pct", "l_tax", 0.0, 0.06, "pct"),
    ("ovality_pct", "l_quantity", 1.0, 45.0, "pct"),
    ("yield_strength_mpa", "l_extendedprice", 1000.0, 90000.0, "MPa"),
)
TUBE_PARTS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_COLUMNS = (*TUBE_PARTS, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ENERGY_STAGES = (("REHEAT", 0.5), ("ROLLING_SIZING", 0.25), ("HEAT_TREATMENT", 0.25))
SENSORS = (
    "furnace_zone_temperature",
    "reheat_exit_temperature",
    "roll_speed",
    "rolling_load",
    "lubrication_flow",
    "mill_vibration",
)


class Plant:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- order plant -------------------------------------------------------------------------
    @cached_property
    def line_rows(self) -> DataFrame:
        """lineitem with tube_key, a 64-bit number spread over the orders, so that tubes lie with their order (the identity stays tube_id)."""
        return self.table("lineitem").select(F.xxhash64("l_orderkey").alias("tube_key"), *LINE_COLUMNS)

    @cached_property
    def lines(self) -> DataFrame:
        """lineitem with its order, part and supplier context."""
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        supplier = self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        return (
            self.line_rows
            .join(self.table("part").select("p_partkey", "p_brand", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        )

    @cached_property
    def tubes(self) -> DataFrame:
        return self._as_tubes(self.lines)

    def _as_tubes(self, lines: DataFrame, *keep: str) -> DataFrame:
        hours = F.col("l_extendedprice") / 10000.0
        return lines.select(
            "tube_key",
            *keep,
            self._tube_id,
            F.col("l_orderkey").alias("order_id"),
            F.col("p_brand").alias("product_code"),
            F.col("p_type").alias("grade_family"),
            F.col("r_name").alias("line_id"),
            F.col("o_orderpriority").alias("shift_id"),
            F.col("l_shipdate").alias("actual_start_ts"),
            add_seconds("l_shipdate", "floor(l_extendedprice)").alias("actual_end_ts"),
            (F.col("l_quantity") * 1000.0).alias("tube_mass_kg"),
            F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0).alias("good_mass_t"),
            hours.alias("productive_hours"),
            (F.col("l_quantity") / hours).alias("actual_tph"),
            (F.col("l_returnflag") == "A").alias("approved_first_pass"),
            F.when(F.col("l_returnflag") == "A", "FIRST_PASS").when(F.col("l_returnflag") == "N", "REWORK").otherwise("SCRAP").alias("disposition"),
        )

    @property
    def _tube_id(self):
        return F.concat_ws("-", *[F.col(c).cast("string") for c in TUBE_PARTS]).alias("tube_id")

    @cached_property
    def energy_events(self) -> DataFrame:
        good = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)
        stages = F.array(*[F.struct(F.lit(s).alias("stage_name"), F.lit(w).alias("share")) for s, w in ENERGY_STAGES])
        rows = self.line_rows.select(
            "tube_key", self._tube_id, F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("event_ts"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("kwh"), good.alias("good_mass_t"), F.explode(stages).alias("s"),
        )
        kwh = F.col("kwh") * F.col("s.share") + F.lit(0.0)
        return rows.select(
            F.concat_ws("-", "tube_id", "s.stage_name").alias("energy_event_id"), "tube_key", "tube_id", "order_id",
            F.col("s.stage_name").alias("stage_name"), "event_ts", kwh.alias("energy_kwh"), "good_mass_t",
            F.try_divide(kwh, F.col("good_mass_t")).alias("energy_per_good_tonne_kwh_t"),
        )

    @cached_property
    def quality_results(self) -> DataFrame:
        tests = F.array(*[
            F.struct(F.lit(n).alias("characteristic"), (F.col(c) + F.lit(0.0)).alias("measured_value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(u).alias("unit"))
            for n, c, lo, hi, u in CHARACTERISTICS
        ])
        rows = self.line_rows.select(
            "tube_key", self._tube_id, F.col("l_orderkey").alias("order_id"),
            add_seconds("l_shipdate", "floor(l_extendedprice)").alias("inspection_ts"), F.explode(tests).alias("t"),
        )
        return self._as_results(rows)

    def _as_results(self, rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(
            F.concat_ws("-", "tube_id", "t.characteristic").alias("quality_result_id"), "tube_key", "tube_id", "order_id",
            F.col("t.characteristic").alias("characteristic"), F.col("t.measured_value").alias("measured_value"),
            F.col("t.lo").alias("internal_simulated_lower_limit"), F.col("t.hi").alias("internal_simulated_upper_limit"),
            F.col("t.unit").alias("unit"), F.col("t.measured_value").between(F.col("t.lo"), F.col("t.hi")).alias("passed"), "inspection_ts", *keep,
        )

    @cached_property
    def process_parameters(self) -> DataFrame:
        return self.line_rows.select(
            "tube_key",
            self._tube_id,
            F.col("l_shipdate").alias("process_start_ts"),
            *[c.alias(n) for n, c in self._process.items()],
        )

    @property
    def _process(self) -> dict[str, Column]:
        return {
            "tool_wear_index": F.col("l_discount") * 10.0 + 0.0,
            "sensor_degradation_index": F.col("l_tax") * 10.0 + 0.0,
            "roll_speed_rpm": F.col("l_quantity") * 4.0 + 40.0,
            "thermal_uniformity_index": F.col("l_extendedprice") / 105000.0,
            "hours_since_maintenance": F.col("l_linenumber") * 12.0,
            "maintenance_deferred": F.col("l_linestatus") == "O",
        }

    @cached_property
    def stops(self) -> DataFrame:
        """Unplanned stops of the order plant: one per order."""
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        customer = self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
        minutes = F.col("o_totalprice") / 1000.0
        return self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("downtime_event_id"), F.col("r_name").alias("line_id"), F.col("o_orderpriority").alias("shift_id"),
            F.col("o_orderdate").alias("event_start_ts"), minutes.alias("duration_minutes"), (minutes / 60.0 * 18.0).alias("production_impact_t"),
        )

    @cached_property
    def dim_products(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_brand").alias("product_code")).agg(
            F.min("p_type").alias("product_family"), F.max("p_size").cast("double").alias("outer_diameter_mm"),
            F.min("p_size").cast("double").alias("wall_thickness_mm"), F.count(F.lit(1)).cast("double").alias("nominal_length_m"),
            F.max("p_retailprice").alias("nominal_mass_kg"),
        ).withColumn("internal_simulated_spec", F.lit(True))

    @cached_property
    def dim_lines(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_name").alias("line_id"), (F.col("r_regionkey") * 10.0 + 50.0).alias("minimum_outer_diameter_mm"),
            (F.col("r_regionkey") * 5.0 + 100.0).alias("nominal_roll_speed_rpm"), F.lit(1.0).alias("energy_efficiency_index"),
            F.lit(True).alias("internal_simulated_limits"),
        )

    @cached_property
    def dim_grades(self) -> DataFrame:
        return self.table("part").select(F.col("p_type").alias("grade_family")).distinct()

    @cached_property
    def dim_shifts(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_orderpriority").alias("shift_id")).agg(
            F.min(F.hour("o_orderdate")).alias("start_hour"), F.lit(24).alias("duration_hours"))

    # ---- event plant -------------------------------------------------------------------------
    def events(self, kind: str) -> DataFrame:
        df = self.table("events").filter(F.col("event_type") == kind)
        asset = F.col("user_id") % 15
        return df.withColumn("asset_id", F.concat(F.lit("A"), F.lpad(asset.cast("string"), 2, "0"))).withColumn(
            "line_id", F.concat(F.lit("L"), (asset % 3).cast("string")))

    @cached_property
    def event_assets(self) -> DataFrame:
        asset = (F.col("user_id") % 15).alias("n")
        n = F.col("n")
        return self.table("events").select(asset).distinct().select(
            F.concat(F.lit("A"), F.lpad(n.cast("string"), 2, "0")).alias("asset_id"), F.concat(F.lit("L"), (n % 3).cast("string")).alias("line_id"),
            F.concat(F.lit("TYPE_"), (n % 5).cast("string")).alias("asset_type"), F.when(n % 2 == 0, "HIGH").otherwise("MEDIUM").alias("criticality"),
        )

    @cached_property
    def event_lines(self) -> DataFrame:
        return self.event_assets.groupBy("line_id").agg(
            F.count(F.lit(1)).cast("double").alias("minimum_outer_diameter_mm"), F.lit(100.0).alias("nominal_roll_speed_rpm"),
            F.lit(1.0).alias("energy_efficiency_index"), F.lit(True).alias("internal_simulated_limits"))

    @cached_property
    def event_shifts(self) -> DataFrame:
        return literal_table(self.spark, [("S1", 0, 8), ("S2", 8, 8), ("S3", 16, 8)], "shift_id string, start_hour int, duration_hours int")

    @cached_property
    def event_calendar(self) -> DataFrame:
        """One row: first and last day of the event table."""
        return self.table("events").agg(F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))

    @cached_property
    def downtime_events(self) -> DataFrame:
        return self.events("error").select(
            F.col("event_id").alias("downtime_event_id"), "line_id", "asset_id", F.concat(F.lit("R"), (F.col("event_id") % 4).cast("string")).alias("reason_code"),
            F.col("ts").alias("event_start_ts"), add_seconds("ts", "floor(value * 60)").alias("event_end_ts"), F.col("value").alias("duration_minutes"),
            ((F.col("event_id") % 200) * 1.0).alias("hours_since_maintenance"), ((F.col("event_id") % 100) / 100.0).alias("sensor_degradation_index"),
            (F.col("event_id") % 11 == 0).alias("maintenance_deferred"), (F.col("value") / 60.0 * 18.0).alias("production_impact_t"), F.lit(True).alias("unplanned"),
        )

    @cached_property
    def maintenance_events(self) -> DataFrame:
        return self.events("signup").select(
            F.col("event_id").alias("maintenance_event_id"), "asset_id", "line_id", F.when(F.col("event_id") % 2 == 0, "PREVENTIVE").otherwise("CORRECTIVE").alias("maintenance_type"),
            F.col("ts").alias("scheduled_start_ts"), F.col("ts").alias("actual_start_ts"), add_seconds("ts", "floor(value * 60)").alias("actual_end_ts"),
            F.col("value").alias("duration_minutes"), (F.col("event_id") % 11 == 0).alias("was_deferred"), F.lit("CLOSED").alias("work_order_status"),
        )

    @cached_property
    def event_process(self) -> DataFrame:
        return self.events("view").select(
            F.col("event_id").alias("tube_id"), "line_id", F.col("ts").alias("process_start_ts"), (F.col("value") / 500.0).alias("tool_wear_index"),
            ((F.col("event_id") % 100) / 100.0).alias("sensor_degradation_index"), (F.col("user_id") * 1.0).alias("hours_since_maintenance"),
            (F.col("event_id") % 11 == 0).alias("maintenance_deferred"),
        )

    @cached_property
    def event_orders(self) -> DataFrame:
        e = F.col("event_id")
        return self.events("purchase").select(
            e.alias("order_id"), F.col("ts").alias("release_ts"), F.concat(F.lit("P"), (e % 12).cast("string")).alias("product_code"),
            F.concat(F.lit("G"), (e % 4).cast("string")).alias("grade_family"), "line_id", F.concat(F.lit("S"), (e % 3).cast("string")).alias("shift_id"),
            F.col("user_id").cast("int").alias("committed_sequence"), (F.col("value") / 10.0).alias("ambient_temperature_c"), F.col("value").alias("target_tonnes"),
        )

    @cached_property
    def event_billets(self) -> DataFrame:
        v = F.col("value")
        return self.events("purchase").select(
            F.col("event_id").alias("order_id"), add_seconds("ts", "floor(value) - 60").alias("received_ts"), (v / 1000.0).alias("carbon_pct"),
            (v / 500.0).alias("manganese_pct"), (v / 2000.0).alias("chromium_pct"), (v / 4000.0).alias("molybdenum_pct"),
            (v + 100.0).alias("billet_diameter_mm"), (v * 3.0).alias("billet_mass_kg"),
        )

    @cached_property
    def stage_events(self) -> DataFrame:
        return self.events("purchase").select(F.col("user_id").alias("tube_id"), F.lit("ROLLING_SIZING").alias("stage_name"), F.col("ts").alias("event_end_ts"))

    @cached_property
    def user_process(self) -> DataFrame:
        """Process row per user of the event table."""
        return self.events("view").groupBy(F.col("user_id").alias("tube_id"), "line_id").agg(
            F.min("ts").alias("process_start_ts"), F.max("value").alias("tool_wear_index"), F.count(F.lit(1)).alias("pass_count"))

    @cached_property
    def sensor_windows(self) -> DataFrame:
        e = F.col("event_id")
        kind = F.element_at(F.array(*[F.lit(s) for s in SENSORS]), (e % 6 + 1).cast("int"))
        valid = e % 7 != 0
        return self.events("click").select(
            e.alias("sensor_window_id"), F.col("user_id").alias("tube_id"), kind.alias("sensor_type"), F.col("ts").alias("window_start_ts"),
            add_seconds("ts", "120").alias("feature_available_at_ts"), F.when(valid, F.col("value")).alias("mean_value"),
            F.when(valid, F.col("value") / 10.0).alias("out_of_range_pct"), F.when(valid, "VALID").otherwise("MISSING").alias("data_quality_status"),
            F.when(valid, "NONE").when(e % 3 == 0, "MCAR").when(e % 3 == 1, "MAR").otherwise("BLOCK").alias("missingness_type"),
        )
