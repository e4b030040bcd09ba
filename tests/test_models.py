"""Splits, metrics, lookups and audits with known answers."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tonnage.operators import lookup
from tonnage.plans import audit, explain, learn, metrics, splits
from tonnage.plans.contracts import TABLE_KEYS, TASKS, Task

START = dt.datetime(2024, 1, 1)


def daily(spark, n, delay, moved=None):
    rows = [(f"k{i:03d}", START + dt.timedelta(days=i), START + dt.timedelta(days=i) + delay) for i in range(n)]
    if moved:
        i, day = moved
        rows[i] = (rows[i][0], rows[i][1], START + dt.timedelta(days=day))
    return spark.createDataFrame(rows, "sample_key string, snapshot_ts timestamp, label_ts timestamp")


def test_temporal_split_and_embargo(spark):
    out = splits.temporal_split(daily(spark, 80, dt.timedelta(hours=1), (43, 70)), "snapshot_ts", "label_ts")
    labels = {r["sample_key"]: r["split"] for r in out.collect()}
    assert labels["k043"] == "embargo"
    assert set(labels.values()) == {"train", "tuning", "calibration", "final_test", "embargo"}
    spans = {r["split"]: (r["a"], r["b"]) for r in out.groupBy("split").agg(F.min("snapshot_ts").alias("a"), F.max("snapshot_ts").alias("b")).collect()}
    assert spans["train"][1] < spans["tuning"][0] and spans["tuning"][1] < spans["calibration"][0] and spans["calibration"][1] < spans["final_test"][0]


def test_too_few_times_are_refused(spark):
    with pytest.raises(splits.SplitError):
        splits.temporal_split(daily(spark, 5, dt.timedelta(hours=1)), "snapshot_ts", "label_ts")


def test_expanding_folds_never_look_ahead(spark):
    out = splits.temporal_split(daily(spark, 120, dt.timedelta(minutes=10)), "snapshot_ts", "label_ts")
    folds = splits.expanding_folds(out, "snapshot_ts", "label_ts", "sample_key", 3).join(out, "sample_key")
    rows = folds.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("snapshot_ts"))).alias("a"), F.min(F.when(F.col("role") == "validation", F.col("snapshot_ts"))).alias("b")).collect()
    assert len(rows) == 3 and all(r["a"] < r["b"] for r in rows)
    assert {r["split"] for r in folds.select("split").distinct().collect()} <= {"train", "tuning"}


def test_unobservable_target_is_dropped(spark):
    df = spark.createDataFrame([(i, math.nan if i == 1 else float(i)) for i in range(12)], "i int, y double")
    kept = {r["i"] for r in splits.task_rows(df, Task("t", "s", "y", "regression")).collect()}
    assert kept == set(range(12)) - {1}


def test_perfect_regression(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(1, 5)], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    assert (m["mae"], m["rmse"], m["r2"]) == (0.0, 0.0, 1.0)
    q = metrics.quantile_metrics(df.withColumns({"lo": F.col("p") - 0.5, "hi": F.col("p") + 0.5}), "y", "lo", "p", "hi").first()
    assert q["empirical_coverage_80"] == 1.0 and q["p50_mae"] == 0.0


def test_perfect_classification(spark):
    df = spark.createDataFrame([(1, 0, 0.01), (2, 0, 0.10), (3, 1, 0.80), (4, 1, 0.99)], "k int, y int, p double")
    m = metrics.classification_metrics(df, "y", "p", "k", budgets=(0.25, 0.50)).first()
    assert m["pr_auc"] == pytest.approx(1.0) and m["roc_auc"] == pytest.approx(1.0)
    assert (m["tn"], m["tp"], m["fp"], m["fn"]) == (2, 2, 0, 0)
    assert m["recall_at_alert_budget_25pct"] == 0.5


def test_single_class_has_no_roc(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9)], "k int, y int, p double")
    assert metrics.roc_auc(df, "y", "p").first()["roc_auc"] is None


def test_conditioned_median_and_fallback(spark):
    train = spark.createDataFrame([("L1", 1.0), ("L1", 3.0), ("L2", 10.0)], "g string, y double")
    asked = spark.createDataFrame([("L1",), ("NEW",), (None,)], "g string")
    stats = lookup.conditioned_stat(train, "y", ["g"], "median")
    out = lookup.apply_conditioned(asked, stats, ["g"], lookup.global_stat(train, "y").scalar())
    assert {r["g"]: r["estimate"] for r in out.collect()} == {"L1": 2.0, "NEW": 3.0, None: 3.0}


def test_smoothed_rate(spark):
    train = spark.createDataFrame([("L1", 1), ("L1", 1), ("L2", 0), ("L2", 0)], "g string, y int")
    rates = {r["g"]: r["estimate"] for r in lookup.conditioned_stat(train, "y", ["g"], "rate", smoothing=2.0).collect()}
    assert rates == {"L1": 0.75, "L2": 0.25}


def test_spearman_of_monotone_pairs_and_small_sample(spark):
    df = spark.createDataFrame([(float(i), float(i) ** 3) for i in range(30)], "x double, y double")
    assert audit.spearman(df, "x", "y").first()["rho"] == pytest.approx(1.0)
    assert audit.spearman(df.limit(5), "x", "y").first()["rho"] is None


def test_audit_signs_with_and_without_nulls(spark):
    mechanisms = [audit.Mechanism("up", "x", "y", 1), audit.Mechanism("down", "x", "y", -1)]
    df = spark.createDataFrame([(float(i), float(i) + (i % 3)) for i in range(40)], "x double, y double")
    for frame in (df, df.unionByName(spark.createDataFrame([(None, 1.0)], "x double, y double"))):
        got = {r["mechanism"]: (r["associated"], r["pairs"]) for r in audit.audit_pairs(frame, mechanisms).collect()}
        assert got == {"up": (True, 40), "down": (False, 40)}


def test_even_sample_positions(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k int, v double")
    got = sorted(r["k"] for r in explain.even_sample(df, "v", "k", 7).collect())
    assert got == [int(i * 99 / 6) for i in range(7)]


def test_contracts():
    assert len(TABLE_KEYS) == 15 and len(TASKS) == 10 and len({t.name for t in TASKS}) == 10


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_tree_contributions_add_up_and_follow_the_paths(spark, kind):
    rows = spark.range(300).selectExpr("id AS sample_key", "CAST(id % 5 AS STRING) AS c", "CAST(id % 13 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS idle", "CAST(id % 13 AS DOUBLE) * 2 + id % 5 AS y")
    label = F.col("y") if kind == "regression" else (F.col("y") > 14).cast("double")
    rows = rows.withColumn("label", label.cast("double"))
    features = learn.Features(("c",), ("x", "idle"))
    prep = learn.fit_preprocessor(rows, features, one_hot=False)
    task = Task("t", "s", "label", kind, rounds=4, depth=3)
    model = learn.boosted(task, prep.transform(rows), prep.transform(rows))
    fitted = learn.Fitted(task, prep, model)
    out = learn.tree_contributions(fitted, rows, keep=["c"])
    assert out.count() == 300 * 3
    sums = out.groupBy("sample_key").agg((F.first("base") + F.sum("contribution") - F.first("prediction")).alias("gap"))
    assert sums.agg(F.max(F.abs("gap"))).first()[0] < 1e-9
    # by hand, row by row: walk each tree with its own predictions
    bare = {r["sample_key"]: r["features"] for r in prep.transform(rows).select("sample_key", "features").filter("sample_key < 20").collect()}
    got = {(r["sample_key"], r["feature"]): r["contribution"] for r in out.filter("sample_key < 20").collect()}
    for key, vector in bare.items():
        want = [0.0, 0.0, 0.0]
        for tree, weight in zip(model.trees, model.treeWeights):
            node = tree._call_java("rootNode")
            while node.subtreeDepth() > 0:
                split = node.split()
                i = split.featureIndex()
                left = vector[i] in list(split.leftCategories()) if "Categorical" in split.getClass().getName() else vector[i] <= split.threshold()
                below = node.leftChild() if left else node.rightChild()
                want[i] += weight * (below.prediction() - node.prediction())
                node = below
        assert all(abs(got[key, n] - w) < 1e-9 for n, w in zip(features.all, want))


@pytest.mark.parametrize("make", [learn.logistic, lambda train: learn.forest(train, "classification", trees=3, depth=3)])
def test_classifiers_carry_no_training_summary(spark, make):
    draw = random.Random(3)
    rows = [(Vectors.dense(x, draw.random()), 1.0 if x + 0.2 * draw.random() > 0.6 else 0.0) for x in (draw.random() for _ in range(300))]
    train = spark.createDataFrame(rows, ["features", "label"])
    model = make(train)
    assert not model.hasSummary
    right = learn.with_score(model, train, "classification").filter("(prediction > 0.5) = (label = 1.0)").count()
    assert right > 240
