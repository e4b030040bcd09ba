"""Joint tiles without an exchange of rows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonnage.operators.ordered import tiles_together


@pytest.mark.parametrize("copies", [1, 3])
def test_joint_tiles_exchange_no_rows_and_equal_ntile(spark, copies):
    draw = random.Random(3)
    base = [(k, draw.choice([None, "a", "b"]), draw.choice([0.0, -0.0, None, math.nan, draw.random()])) for k in range(200)]
    df = spark.createDataFrame(base * copies, "k int, g string, x double")  # equal rows lie on both sides of a tile's start
    made = tiles_together(df, ["g"], {"x": "t"}, "k", 3)
    if copies == 1:  # rows meet the few starts of tiles, no window numbers them
        assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    want = df.withColumn("t", F.ntile(3).over(Window.partitionBy("g").orderBy("x", "k")))
    assert sorted(map(str, made.select("k", "g", "t").collect())) == sorted(map(str, want.select("k", "g", "t").collect()))
