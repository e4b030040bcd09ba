"""Bucketed tables, observed totals, joint tiles, packages, pruned neighbours and the merge tree."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonnage.operators.neighbours import knn_distance
from tonnage.operators.ordered import tiles, tiles_together
from tonnage.operators.skyline import skyline
from tonnage.plans import packages, star
from tonnage.plans.build import Build, stored_build
from tonnage.session import configure
from tonnage.sources import sinks
from tonnage.sources.scratch import scratch
from tonnage.sources.warehouse import Totals, bucketed

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def build(spark):
    return Build(configure(spark), SMALL)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_and_aggregate_without_exchange(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("tube_key"), F.col("id").cast("string").alias("tube_id"), (F.col("id") % 7).alias("v"))
    left, right = bucketed(df, "l", "tube_key"), bucketed(df.withColumnRenamed("v", "w"), "r", "tube_key")
    joined = left.join(right.hint("merge"), ["tube_key", "tube_id"]).groupBy("tube_key", "tube_id").agg(F.sum("w").alias("w"))
    assert "Exchange" not in plan_of(joined)
    assert joined.agg(F.sum("w")).first()[0] == df.agg(F.sum("v")).first()[0]


def test_marts_exchange_nothing_below_their_aggregates(build):
    # the one exchange stands between partial and final aggregation; facts of a tube meet where they lie
    for mart in (build.quality_mart, build.energy_mart):
        assert plan_of(mart).count("Exchange") == 1
    assert plan_of(build.order_mart).count("Exchange hashpartitioning(order_id") == plan_of(build.order_mart).count("Exchange hashpartitioning")


def test_totals_of_a_write_equal_a_second_scan(spark, build):
    store = build.stored
    made = store.production.agg(F.count(F.lit(1)).alias("n"), F.sum("good_mass_t").alias("good")).first()
    assert store.total("production", "rows") == made["n"]
    assert store.total("production", "good_mass_t") == pytest.approx(made["good"], rel=1e-12)
    assert store.total("energy_events", "rows") == 3 * made["n"] and store.total("quality_results", "rows") == 4 * made["n"]
    totals = Totals()
    df = totals.watch(spark.range(100), "empty", {"rows": "count(1)", "s": "sum(id)"}).filter("id < 0")
    df.write.format("noop").mode("overwrite").save()
    assert totals.of("empty")["rows"] == 100


def test_facts_are_made_from_the_one_stored_table_of_lines(build):
    for fact in (build.production, build.energy_events, build.quality_results, build.process_parameters):
        assert "tonnage_lines_" in plan_of(fact) and "Exchange" not in plan_of(fact)


def test_repeated_part_repeats_production_only(spark, tmp_path):
    for n in ("lineitem", "orders", "supplier", "customer", "nation", "region"):
        shutil.copyfile(f"{SMALL}/{n}.parquet", tmp_path / f"{n}.parquet")
    part, lines = spark.read.parquet(f"{SMALL}/part.parquet"), spark.read.parquet(f"{SMALL}/lineitem.parquet")
    gone = part.agg(F.max("p_partkey")).first()[0]
    part.filter(F.col("p_partkey") != gone).unionByName(part.filter("p_partkey <= 5")).write.parquet(f"{tmp_path}/part.parquet")
    store, n = stored_build(spark, str(tmp_path)), lines.count()
    twice, never = lines.filter("l_partkey <= 5").count(), lines.filter(F.col("l_partkey") == gone).count()
    assert twice and store.production.count() == n + twice - never
    assert store.energy_events.count() == 3 * n and store.quality_results.count() == 4 * n and store.process_parameters.count() == n


def test_training_rows_of_tubes_meet_where_they_lie(build):
    from tonnage.catalog.model_queries import tube_samples

    samples = tube_samples(build)
    assert "Exchange hashpartitioning(tube_id" not in plan_of(samples)
    assert samples.select("sample_key").distinct().count() == build.production.select("tube_id").distinct().count()


def test_store_is_shared_until_a_file_changes(spark, tmp_path):
    names = ("lineitem", "orders", "part", "supplier", "customer", "nation", "region")
    for n in names:
        shutil.copyfile(f"{SMALL}/{n}.parquet", tmp_path / f"{n}.parquet")
    first = stored_build(spark, str(tmp_path))
    assert stored_build(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SMALL}/region.parquet").limit(3).toPandas().to_parquet(tmp_path / "region.parquet")
    assert stored_build(spark, str(tmp_path)) is not first


def test_surrogates_are_dense_in_key_order(spark):
    names = [f"k{n:05d}" for n in range(3000)]
    random.Random(1).shuffle(names)
    got = star.with_surrogate(spark.createDataFrame([(n,) for n in names], "name string").repartition(7), "name", "key").collect()
    assert [r["key"] for r in sorted(got, key=lambda r: r["name"])] == list(range(1, 3001))


def test_tiles_together_equal_tiles_apart(spark):
    draw = random.Random(5)
    rows = [(k, f"g{k % 3}", draw.choice([0.0, 1.0, draw.random()]), draw.choice([None, 2.0, draw.random()])) for k in range(900)]
    df = spark.createDataFrame(rows, "k int, g string, x double, y double")
    both = tiles_together(df, ["g"], {"x": "tx", "y": "ty"}, "k", 3)
    apart = tiles(tiles(df, ["g"], "x", "k", 3, "tx"), ["g"], "y", "k", 3, "ty")
    assert {tuple(r) for r in both.select("k", "tx", "ty").collect()} == {tuple(r) for r in apart.select("k", "tx", "ty").collect()}


def test_export_report_counts_what_was_written(spark):
    frames = {"a": spark.range(1000).withColumn("t", F.concat(F.lit('x,"\n'), F.col("id").cast("string"))), "none": spark.range(0)}
    report = {(r["table_name"], r["format"]): (r["source_rows"], r["rows"]) for r in sinks.export_report(frames, scratch(spark)).collect()}
    assert report == {("a", "parquet"): (1000, 1000), ("a", "csv"): (1000, 1000), ("none", "parquet"): (0, 0), ("none", "csv"): (0, 0)}


def test_feature_package_follows_the_contract(build):
    made = packages.feature_package(build.stored)
    for name, (_, _, _, features, targets) in packages.contract_frames(build.stored).items():
        x, index, y = made[f"{name}_X"], made[f"{name}_index"], made[f"{name}_y"]
        assert x.columns == ["sample_key", *features] and y.columns == ["sample_key", "target_available_at_ts", *targets]
        # no result of the predicted period among the features, and no feature newer than its snapshot
        assert not set(features) & set(targets)
        assert index.filter("feature_max_source_ts > snapshot_ts").isEmpty()
        assert index.join(y, "sample_key").filter("target_available_at_ts <= snapshot_ts").isEmpty() or name == "pre_order"


@pytest.mark.parametrize("by", [[], ["g"]])
def test_skyline_over_a_deep_tree(spark, by):
    draw = random.Random(9)
    rows = []
    for k in range(700):  # nearly all rows of an anti-correlated cloud are on the front
        a = round(draw.random(), 4)
        rows.append((k, None if k % 5 == 0 else f"g{k % 2}", a, round(1 - a + draw.random() * 0.02, 4)))
    df = spark.createDataFrame(rows, "k int, g string, a double, b double")
    beats = lambda o, s: o[2] <= s[2] and o[3] <= s[3] and (o[2] < s[2] or o[3] < s[3])
    want = {s[0] for s in rows if not any(beats(o, s) and (not by or o[1] == s[1]) for o in rows)}
    assert {r["k"] for r in skyline(df, ["a", "b"], "k", by, block_rows=12, fan_in=2).collect()} == want


def test_neighbours_visit_clearly_fewer_pairs_than_the_square(spark):
    def run(n):
        draw = np.random.default_rng(2)
        rows = [(i, [float(v) for v in draw.random(2)]) for i in range(n)]
        df = spark.createDataFrame(rows, "k int, v array<double>")
        seen = []
        got = knn_distance(df.withColumn("g", F.lit("g")), df.withColumn("g", F.lit("g")), ["g"], "k", "k", "v", 4, block_rows=25, visited=seen).collect()
        points = np.array([r[1] for r in rows])
        for r in got[:: max(1, n // 40)]:
            assert r["distance"] == pytest.approx(np.sort(np.linalg.norm(points - points[r["k"]], axis=1))[3], abs=1e-12)
        assert len(got) == n
        return seen[0]

    assert run(4000) < 100 * run(200)  # the square would be 400 times as many
