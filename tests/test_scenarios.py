"""Skyline, neighbours, envelopes, alternatives, quality rules, sinks and streaming on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonnage.catalog import run, scenario_queries
from tonnage.operators import neighbours
from tonnage.operators.neighbours import knn_distance
from tonnage.operators.skyline import skyline
from tonnage.plans import quality, scenarios
from tonnage.plans.quality import Rule
from tonnage.sources import sinks, tables
from tonnage.streaming.windows import stream_window_summary, window_summary


@pytest.mark.parametrize("by", [[], ["g"]])
def test_skyline_against_brute_force(spark, by):
    rng = random.Random(3)
    rows = [(i, f"g{i % 2}", round(rng.random(), 2), round(rng.random(), 2), round(rng.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, g string, a double, b double, c double")
    beats = lambda o, s: all(x <= y for x, y in zip(o[2:], s[2:])) and any(x < y for x, y in zip(o[2:], s[2:]))
    want = {s[0] for s in rows if not any(beats(o, s) and (not by or o[1] == s[1]) for o in rows)}
    assert {r["k"] for r in skyline(df, ["a", "b", "c"], "k", by, block_rows=50).collect()} == want


def test_skyline_keeps_equal_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0), (3, 1.0, 1.0)], "k int, a double, b double")
    assert {r["k"] for r in skyline(df, ["a", "b"], "k").collect()} == {1, 2}


def test_knn_distance_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 4))
    rows = [(i, "g" if i % 4 else "h", [float(x) for x in points[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g string, v array<double>")
    got = {r["k"]: r["distance"] for r in knn_distance(df, df, ["g"], "k", "k", "v", 6, block_rows=40).collect()}
    for i in range(300):
        mine = [np.linalg.norm(points[i] - points[j]) for j in range(300) if rows[j][1] == rows[i][1]]
        assert got[i] == pytest.approx(sorted(mine)[5], abs=1e-9)


def test_nearest_in_runs_equals_all_pairs():
    rng = np.random.default_rng(5)
    clouds = {
        "plain": rng.normal(size=(1500, 11)),
        "copies": np.repeat(rng.normal(size=(150, 4)), 10, axis=0),
        "near copies": np.vstack([1.0 + rng.normal(size=(900, 4)) * 1e-9, rng.normal(size=(300, 4))]),
        "far out": rng.normal(size=(1200, 3)) + 1e9,
        "beyond single precision": rng.normal(size=(1200, 3)) * 1e25,
        "tiny": rng.normal(size=(1200, 3)) * 1e-25,
        "one outlier": np.vstack([rng.normal(size=(1200, 5)), np.full((1, 5), 1e7)]),
        "not a number": np.vstack([rng.normal(size=(700, 4)), np.full((3, 4), np.nan)]),
        "fewer than k": rng.normal(size=(3, 2)),
    }
    for name, cloud in clouds.items():
        want = np.full((len(cloud), 6), np.nan)
        want[:, : min(6, len(cloud))] = neighbours._pairwise(cloud, cloud, 6)
        unbounded = neighbours._nearest(cloud, cloud, 6, np.full(len(cloud), np.inf))
        assert np.array_equal(unbounded, want, equal_nan=True), name
        bounded = neighbours._nearest(cloud, cloud, 6, want[:, 4])
        assert np.array_equal(bounded[:, :5], np.where(want[:, 4:5] == 0, np.nan, want[:, :5]), equal_nan=True), name


def test_runs_out_of_reach_are_not_compared():
    line = np.sort(np.random.default_rng(6).random(8192))[:, None]
    counted = []
    neighbours._nearest(line, line, 6, np.full(len(line), np.inf), counted)
    assert sum(counted) < len(line) ** 2 / 8


def test_one_search_gives_several_distances_and_is_not_repeated(spark):
    points = np.random.default_rng(8).normal(size=(200, 3))
    df = spark.createDataFrame([(i, "g", [float(x) for x in points[i]]) for i in range(200)], "k int, g string, v array<double>")
    found = knn_distance(df, df, ["g"], "k", "k", "v", {"fourth": 4, "sixth": 6}, block_rows=40)
    assert "CoGroup" not in found._jdf.queryExecution().toString()  # a second reader reads rows, it does not search again
    for r in found.collect():
        near = np.sort(np.linalg.norm(points - points[r["k"]], axis=1))
        assert (r["fourth"], r["sixth"]) == pytest.approx((near[3], near[5]), abs=1e-12)


def test_batch_evaluation_searches_once(spark, monkeypatch):
    searches = []

    def counting(*args, **kwargs):
        searches.append(args[2])
        return knn_distance(*args, **kwargs)

    monkeypatch.setattr(scenario_queries, "knn_distance", counting)
    monkeypatch.setattr(scenarios, "knn_distance", counting)
    run("sc20_batch_evaluation", spark, "/root/testdata/sf0.001")
    assert len(searches) == 1


def test_envelope_accepts_medoid_and_refuses_probe(spark):
    rng = np.random.default_rng(7)
    names = [f"c{i}" for i in range(11)]
    rows = [(i, "ctx", *[float(x) for x in rng.normal(100, 5, 11)]) for i in range(300)]
    support = spark.createDataFrame(rows, "k int, g string, " + ", ".join(f"{n} double" for n in names))
    limits, change = {n: (0.0, 500.0) for n in names}, {n: 0.15 for n in names}
    ranges = scenarios.control_ranges(support, ["g"], names)
    medoid = support.join(scenarios.medoids(support, ["g"], "k", names).filter("rank = 1").select("g", "k"), ["g", "k"], "left_semi")
    bounds = scenarios.envelopes(ranges, medoid.drop("k"), ["g"], names, limits, change)
    assert {r["status"] for r in bounds.collect()} == {"OK"}
    scaled = scenarios.scaled_vectors(support, ranges, ["g"], "k", names)
    thresholds = scenarios.distance_thresholds(scaled, ["g"], "k")
    for candidate, accepted in ((medoid, True), (scenarios.ood_probes(medoid, bounds, ["g"], "c0"), False)):
        vectors = scenarios.scaled_vectors(candidate, ranges, ["g"], "k", names)
        distances = knn_distance(vectors, scaled, ["g"], "k", "k", "vector", 5)
        verdict = scenarios.assess(candidate, bounds, distances, thresholds, ["g"], "k", names).first()
        assert verdict["in_distribution"] is accepted


def test_three_distinct_alternatives(spark):
    rows = [(i, -10.0 + i, 0.3 - i * 0.05, 50.0 - i, 0.1, 2.0, 0.1 * i, 4.0, 9.0, 0.5) for i in range(5)]
    cols = ["k", "tbh", "risk", "energy", "stop", "minutes", "change", "w1", "w2", "ratio"]
    df = spark.createDataFrame(rows, cols)
    scores = scenarios.alternative_scores(df, ["tbh", "risk", "energy", "stop", "minutes", "change"], ["w1", "w2"], "ratio", "change")
    picked = scenarios.select_alternatives(scores, "k", [], ["tbh", "risk", "energy"]).collect()
    assert {r["scenario_label"] for r in picked} == {"productivity", "conservative", "balanced"}
    assert len({r["k"] for r in picked}) == 3
    assert next(r["k"] for r in picked if r["scenario_label"] == "productivity") == 0


def test_rules_and_gate(spark, tmp_path):
    child = spark.createDataFrame([(1, 5), (1, 6), (None, 9)], "id int, parent int")
    parent = spark.createDataFrame([(5,), (6,)], "pid int")
    rules = [
        Rule("key", "key", "child", columns=("id",)),
        Rule("ref", "reference", "child", columns=("parent", "pid"), other="parent"),
        Rule("range", "rows", "child", "parent NOT BETWEEN 0 AND 8"),
        Rule("rows", "count", "child", equals=3),
        Rule("kinds", "distinct", "child", columns=("parent",), equals=3),
    ]
    report = quality.run_rules({"child": child, "parent": parent}, rules)
    got = {r["check_id"]: (r["observed"], r["status"]) for r in report.collect()}
    assert got == {"key": (2.0, "FAIL"), "ref": (1.0, "FAIL"), "range": (1.0, "FAIL"), "rows": (3.0, "PASS"), "kinds": (3.0, "PASS")}
    with pytest.raises(sinks.PublicationRefused):
        sinks.publish(report, {"child": child}, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    same = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    other = spark.createDataFrame([(2, None), (1, "y")], "i int, s string")
    print_of = lambda df: tuple(sinks.fingerprint(df).first())
    assert print_of(a) == print_of(same) != print_of(other)


def test_recursive_scan_hides_partition_column(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-06")], "i int, d string").withColumn("ts", F.to_timestamp("d"))
    sinks.write_partitioned(df, str(tmp_path / "t"), "ts")
    back = tables.read_table(spark, str(tmp_path), "t")
    assert sorted(back.columns) == ["d", "i", "ts"] and back.count() == 2


def test_stream_equals_batch_for_finished_windows(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS e, 'temp' AS s, timestampadd(SECOND, CAST(id * 20 AS INT), TIMESTAMP '2024-01-01') AS ts, CAST(id AS DOUBLE) AS v FROM range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    columns = dict(entity="e", sensor="s", ts="ts", value="v", low=0.0, high=150.0)
    stream_window_summary(stream, str(tmp_path / "out"), str(tmp_path / "cp"), watermark="2 minutes", **columns).awaitTermination()
    key = ["e", "window_start_ts"]
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*key, "reading_count", "mean_value").collect()}
    full = {tuple(r) for r in window_summary(rows, **columns).select(*key, "reading_count", "mean_value").collect()}
    assert done and done <= full


def test_restarted_stream_with_late_and_repeated_readings_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id, id % 3 AS e, 'temp' AS s, timestampadd(SECOND, CAST(id * 20 AS INT), TIMESTAMP '2024-01-01') AS ts, CAST(id AS DOUBLE) AS v FROM range(240)")
    late = F.col("id").between(116, 118)  # within the watermark of 2 minutes when the first delivery ends
    deliveries = (
        rows.filter((F.col("id") < 120) & ~late).unionByName(rows.filter("id < 40")),  # repeats in one delivery
        rows.filter(((F.col("id") >= 120) & (F.col("id") < 200)) | late).unionByName(rows.filter("id BETWEEN 90 AND 119")),  # late ones, and repeats of the delivery before
        rows.filter("id >= 200 OR id < 60"),  # repeats of windows long written
    )
    columns = dict(entity="e", sensor="s", ts="ts", value="v", low=0.0, high=150.0, identity="id")
    for delivery in deliveries:
        delivery.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_window_summary(stream, str(tmp_path / "out"), str(tmp_path / "cp"), watermark="2 minutes", **columns).awaitTermination()
    shown = ["e", "window_start_ts", "reading_count", "mean_value"]
    done = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*shown).collect())
    batch = window_summary(rows, **columns).filter(F.col("window_end_ts") <= F.lit("2024-01-01 01:17:40").cast("timestamp"))  # newest reading less 2 minutes
    assert done == sorted(tuple(r) for r in batch.select(*shown).collect()) and len(done) > 100


def test_slope_does_not_depend_on_the_calendar(spark):
    # a window across a multiple of 365 days since 1970
    rows = spark.sql("SELECT id, 'e' AS e, 's' AS s, timestamp_seconds(19710 * 86400L + (id - 5) * 10) AS ts, CAST(id AS DOUBLE) AS v FROM range(10)")
    out = window_summary(rows, "e", "s", "ts", "v", 0.0, 9.0, width="7 days").first()
    assert out["reading_count"] == 10 and abs(out["slope"] - 0.1) < 1e-9


def test_repeats_in_a_table_count_once(spark):
    rows = spark.sql("SELECT id, 'e' AS e, 's' AS s, TIMESTAMP '2024-01-01' AS ts, CAST(id AS DOUBLE) AS v FROM range(3)")
    out = window_summary(rows.unionByName(rows), "e", "s", "ts", "v", 0.0, 9.0, identity="id").first()
    assert (out["reading_count"], out["mean_value"]) == (3, 1.0)
