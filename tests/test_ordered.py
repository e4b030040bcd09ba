"""Range-wise ranks, running totals and quantiles against brute force, including skew and ties."""

import decimal
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonnage.operators import asof, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value holds a third of them, with null groups and values."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = 7.0 if i % 3 == 1 else round(rng.uniform(0, 50), 1)
        rows.append((i, group, value, f"id-{rng.randrange(10**6):06d}-{i}"))
    rows.append((3000, "hot", None, "id-none"))
    return spark.createDataFrame(rows, "i int, g string, v double, k string"), rows


def test_row_numbers_with_heavy_value(skewed):
    df, rows = skewed
    got = {r["i"]: r["n"] for r in ordered.row_numbers(df, ["g"], "v", "k", name="n", parts=16).collect()}
    for group in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == group), key=lambda r: (r[2] is not None, r[2] or 0.0, r[3]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))


def test_row_numbers_descending_and_global(skewed):
    df, rows = skewed
    got = {r["i"]: r["n"] for r in ordered.row_numbers(df, [], "v", "i", descending=True, name="n", parts=16).collect()}
    mine = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
    assert [got[r[0]] for r in mine] == list(range(1, len(rows) + 1))


def test_row_numbers_over_strings(skewed):
    df, rows = skewed
    got = {r["k"]: r["n"] for r in ordered.row_numbers(df, [], "k", name="n", parts=16).collect()}
    assert [got[k] for k in sorted(r[3] for r in rows)] == list(range(1, len(rows) + 1))


def test_tiles_match_ntile(skewed, spark):
    df, _ = skewed
    mine = ordered.tiles(df, ["g"], "v", "k", 7, "t").select("i", "t")
    df.createOrReplaceTempView("skewed")
    theirs = spark.sql("SELECT i, ntile(7) OVER (PARTITION BY g ORDER BY v, k) AS t FROM skewed")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))


def test_tiles_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, v double").withColumn("g", F.lit("x"))
    assert sorted(r["t"] for r in ordered.tiles(df, ["g"], "v", "i", 5, "t").collect()) == [1, 2]


@pytest.mark.parametrize("q", [0.0, 0.02, 0.3, 0.5, 0.98, 1.0])
def test_exact_quantiles(skewed, q):
    df, rows = skewed
    got = {r["g"]: r["x"] for r in ordered.exact_quantiles(df, ["g"], "v", {"x": q}, parts=16).collect()}
    for group in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == group and r[2] is not None]
        assert got[group] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_running_sum_with_ties(skewed):
    df, rows = skewed
    clean = df.filter("v IS NOT NULL")
    got = {(r["g"], r["v"]): r["s"] for r in ordered.running(clean, ["g"], "v", {"s": ("sum", F.lit(1))}, parts=16).collect()}
    for (group, value), total in got.items():
        assert total == sum(1 for r in rows if r[1] == group and r[2] is not None and r[2] <= value)


def test_asof_inclusive_and_strict(spark):
    grid = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 10:00:00'), ('a', TIMESTAMP '2024-01-01 08:00:00'), ('b', TIMESTAMP '2024-01-01 10:00:00') t(k, at)")
    events = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 10:00:00'), ('a', TIMESTAMP '2024-01-01 09:00:00') t(k, ev)")
    hours = lambda inclusive: {(r["k"], r["at"].hour): (r["last"].hour if r["last"] else None) for r in asof.asof_last(grid, events, ["k"], "at", "ev", "last", inclusive).collect()}
    assert hours(True) == {("a", 10): 10, ("a", 8): None, ("b", 10): None}
    assert hours(False) == {("a", 10): 9, ("a", 8): None, ("b", 10): None}


def test_lookback_borders(spark):
    """(t-d, t] takes an event at t and drops one at t-d; [t-d, t) does the opposite."""
    grid = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-01-10 00:00:00' AS at")
    events = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-10 00:00:00', 1.0D), ('a', TIMESTAMP '2024-01-03 00:00:00', 10.0D), ('a', TIMESTAMP '2024-01-05 13:07:00', 100.0D) t(k, ev, v)")
    spec = [asof.Lookback("s", "sum", "v", 7)]
    total = lambda closed: asof.lookback_agg(grid, [asof.EventSource(events, "ev", spec, closed)], "k", "at", 7200).first()["s"]
    assert total("right") == 101.0
    assert total("left") == 110.0


def hard_keys(kind):
    """Orders that one double can't tell apart: close large longs and decimals, many nulls, long shared prefixes, heavy values."""
    rng = random.Random(11)
    base = 2**60
    if kind == "long":
        return [base + rng.choice([0, 0, 0, 1, 2, 3, 700, rng.randrange(10**9)]) for _ in range(2000)], "long"
    if kind == "decimal":
        return [None if i % 50 == 0 else decimal.Decimal(base * 10 + rng.choice([1, 1, 2, 3, rng.randrange(500)])) / 10 for i in range(2000)], "decimal(30,1)"
    if kind == "null":
        return [None if i % 10 else rng.randrange(100) for i in range(2000)], "long"
    return [None if i % 40 == 0 else "a" * (i % 2) + "same-prefix-" + rng.choice(["x", "x", "x", str(rng.randrange(1000))]) for i in range(2000)], "string"


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["long", "decimal", "null", "string"])
def test_row_numbers_with_hard_keys(spark, kind, descending):
    values, ddl = hard_keys(kind)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    got = {r["i"]: r["n"] for r in ordered.row_numbers(df, [], "v", "i", descending=descending, name="n", parts=16).collect()}
    mine = Window.orderBy(F.col("v").desc() if descending else F.col("v").asc(), "i")
    assert got == {r["i"]: r["n"] for r in df.select("i", F.row_number().over(mine).alias("n")).collect()}


def test_null_heavy_cells_are_cut(spark):
    df = spark.createDataFrame([(i, None if i % 10 else float(i)) for i in range(4000)], "i int, v double")
    plan = ordered.row_numbers(df, [], "v", "i", name="n", parts=16)
    assert plan.count() == 4000
    splits, heavy = ordered._splits(df, ordered.order_code(df, "v"), 16, isolate_heavy=True)
    assert 0 in heavy and splits[1] < -1e300
