"""Tasks train the rounds and depth of their contract, and read tubes of one line without joining them."""

import inspect
import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tonnage.catalog import model_queries as models
from tonnage.plans import features, learn, splits
from tonnage.plans.build import Build
from tonnage.plans.contracts import Task
from tonnage.session import configure

SMALL = "/root/testdata/sf0.001"


def test_the_round_that_is_kept():
    assert learn.best_round([5.0, 4.0, 4.5, 3.0], 2) == (4, False)
    assert learn.best_round([5.0, 4.0, 4.5, 4.5, 3.0], 2) == (2, True)
    assert learn.best_round([5.0] * 30, 20) == (1, True)
    assert learn.best_round([math.nan] * 6, 2) == (6, False)


def test_tasks_have_no_other_rounds_than_their_own():
    assert not {"rounds", "depth"} & set(inspect.signature(learn.run_tasks).parameters)


def test_tasks_of_two_snapshots_side_by_side(spark):
    rows = spark.range(400).select(
        F.col("id").alias("sample_key"), F.expr("timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01')").alias("snapshot_ts"), (F.col("id") % 3).cast("string").alias("c"),
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 7 > 3).alias("high"))
    rows = splits.temporal_split(rows.withColumn("label_ts", F.col("snapshot_ts")), "snapshot_ts", "label_ts")
    tasks = [Task("a", "one", "y", "regression", depth=2, rounds=3, quantiles=True), Task("b", "two", "high", "classification", depth=2, rounds=2), Task("c", "one", "y", "regression", depth=1, rounds=1)]
    frames, takes = {"one": rows, "two": rows}, learn.Features(("c",), ("x",))
    out = learn.run_tasks(tasks, frames, {n: takes for n in frames}, {n: ["c"] for n in frames}).collect()
    assert [t for i, t in enumerate([r["task"] for r in out]) if i == 0 or out[i - 1]["task"] != t] == ["a", "b", "c"]
    mae = {(r["task"], r["model"]): r["value"] for r in out if r["metric"] == "mae"}
    assert mae["a", "boosted"] < mae["c", "boosted"] and mae["a", "boosted"] < mae["a", "global"]


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(Vectors.dense(float(i % 20)), float(i % 20)) for i in range(200)]
    return spark.createDataFrame(rows, ["features", "label"]).cache()


def test_slow_progress_trains_all_rounds(steps):
    # a round takes less than a hundredth off the tuning error, where Spark's own stop ends
    model = learn.boosted(Task("t", "s", "label", "regression", depth=2, rate=0.002, rounds=33), steps, steps)
    assert len(model.trees) == 33


def test_no_progress_keeps_the_best_round(steps):
    against = steps.withColumn("label", F.lit(9.5))  # every round away from the mean is worse
    task = Task("t", "s", "label", "regression", depth=2, rate=0.5, rounds=40)
    model = learn.boosted(task, steps, against)
    whole = learn.GBTRegressor(labelCol="label", maxDepth=2, stepSize=0.5, maxIter=30, seed=learn.SEED).fit(steps)
    errors = whole.evaluateEachIteration(against, "absolute")
    best = errors.index(min(errors)) + 1
    assert len(model.trees) == best < 30
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:best]]


class OneLineTubes(Build):
    @property
    def production(self):
        raise AssertionError("tubes of one line need no join of facts")


def test_samples_of_tubes(spark):
    b = Build(configure(spark), SMALL)
    made = models.tube_samples(OneLineTubes(configure(spark), SMALL))
    # the joins of whole facts, as a tube that several lines share takes them
    keys, names = ["tube_key", "tube_id"], ["product_code", "shift_id", "is_scrap", "actual_tph", "tool_wear_index", "hours_since_maintenance", "target_available_at_ts"]
    labels = features.tube_labels(b.production, b.quality, b.energy, keep=["tube_key"])
    want = labels.join(b.production.select(*keys, "product_code", "shift_id"), keys).join(b.process_parameters.select(*keys, "tool_wear_index", "hours_since_maintenance"), keys)
    got = made.select(F.col("sample_key").alias("tube_id"), *names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("tube_id", *names).collect()))
