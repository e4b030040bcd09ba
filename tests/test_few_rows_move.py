"""Local cases, even samples and rank audits: what they give, and that all rows are not exchanged for it."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonnage.catalog import model_queries as models
from tonnage.operators.ordered import average_ranks_together
from tonnage.plans import explain
from tonnage.plans.build import Build
from tonnage.session import configure

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tubes_of_one_line_are_explained_without_a_join(spark):
    b = Build(configure(spark), SMALL)
    made = models.explained(b)
    want = b.production.join(b.process_parameters, "tube_id").select(*made.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    singles = made.select("tube_id").join(b.stored.repeated.production.select("tube_id"), "tube_id", "left_anti")
    assert singles.count() == b.stored.single_tubes.count() > 0
    assert "Exchange" not in plan_of(b.stored.single_tubes.select(*made.columns))


def test_cases_are_few_before_contributions_move(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 37 % 5000).cast("double").alias("prediction"))
    contrib = rows.select("k", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), (F.col("prediction") * w).alias("contribution")) for n, w in (("a", 1.0), ("b", -2.0))])))
    out = explain.local_cases(rows, contrib, 10, 1, "k")
    # all rows of neither side are exchanged or sorted by key: both meet the cases, which are known to be few
    assert "SortMergeJoin" not in plan_of(out) and "LeftSemi, BuildRight" in plan_of(out)
    got = sorted(r["prediction"] for r in out.collect())
    assert got == [math.floor(i * 4999 / 9) for i in range(10)]
    assert all('"feature":"b"' in r["top_contributions_json"] for r in out.collect() if r["prediction"] > 0)


@pytest.mark.parametrize("parts", [2, 7, None])
def test_ranks_of_several_columns(spark, parts):
    draw = random.Random(5)
    rows = [(k, float(draw.randrange(4)), draw.choice([0.0, -0.0, math.nan, math.inf, -math.inf, draw.random()]), draw.choice(["a", "b"]), draw.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, few double, odd double, word string, wide double")
    names = {"few": "rf", "odd": "ro", "word": "rw", "wide": "rd"}
    made = average_ranks_together(df, names, parts)
    want = df
    for c, name in names.items():
        want = want.withColumn(name, F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / F.lit(2.0))
    assert sorted(map(str, made.select("k", *names.values()).collect())) == sorted(map(str, want.select("k", *names.values()).collect()))


def test_few_values_are_ranked_without_an_exchange(spark):
    df = spark.range(4000).select((F.col("id") % 9).cast("double").alias("x"))
    assert "hashpartitioning" not in plan_of(average_ranks_together(df, {"x": "r"}))
