"""Scalar expressions and their traps."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tonnage.functions import scalar as S


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_safe_ratio_on_zero_and_null(spark):
    assert one(spark, S.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.safe_ratio(F.lit(1.0), F.lit(None).cast("double"))) is None
    assert one(spark, S.safe_ratio(F.lit(3.0), F.lit(2.0))) == 1.5


def test_cap_and_floor_skip_nulls(spark):
    assert one(spark, S.capped(F.lit(None).cast("double"), 1.0)) == 1.0
    assert one(spark, S.floored(F.lit(-2.0), 0.0)) == 0.0


def test_hour_boundaries_count_marks_not_elapsed_hours(spark):
    a, b = dt.datetime(2024, 1, 1, 10, 59), dt.datetime(2024, 1, 1, 12, 1)
    assert one(spark, S.hour_boundaries(F.lit(a), F.lit(b))) == 2


def test_bands_closed_sides(spark):
    edges = [0, 0.25, 0.5]
    assert one(spark, S.bands(F.lit(0.25), edges)) == "1"
    assert one(spark, S.bands(F.lit(0.25), edges, right=True)) == "0"
    assert one(spark, S.bands(F.lit(0.5), edges)) is None


def test_equal_bins_use_the_float_edges(spark):
    assert one(spark, S.equal_bins(F.lit(0.3), 10)) == 3
    assert one(spark, S.equal_bins(F.lit(1.0), 10)) == 9
    assert one(spark, S.equal_bins(F.lit(0.0), 10)) == 0


def test_hash_id_matches_sha256(spark):
    expected = "ORD-" + hashlib.sha256(b"a|b|3").hexdigest()[:20].upper()
    assert one(spark, S.hash_id("ORD", [F.lit("a"), F.lit("b"), F.lit(3)])) == expected


@pytest.mark.parametrize("a,b,ok", [(24181229.776240956, 24181229.776241064, True), (24181229.776240956, 24181220.0, False)])
def test_close_to(spark, a, b, ok):
    assert one(spark, S.close_to(F.lit(a), F.lit(b))) is ok


def test_correlation_of_constant_series_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.safe_corr("x", "y").alias("r")).first()["r"] is None


def test_null_keys_match_in_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("k", 20)], "k string, w int")
    assert sorted((r["v"], r["w"]) for r in S.null_safe_join(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]
