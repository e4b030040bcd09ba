"""Tubes of one line read their facts from it, tubes of repeated lines join them."""

import shutil

import pytest
from pyspark.sql import functions as F

from tonnage.plans import diagnostics, features, star
from tonnage.plans.build import PERIOD, Build
from tonnage.session import configure

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, names):
    return sorted(tuple(str(round(v * 1.0000000001, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def repeated_lines(spark, tmp_path_factory):
    """Lines that come twice (alike and with another date), parts that come twice, and identities that miss a part."""
    path = tmp_path_factory.mktemp("repeated")
    for n in ("orders", "supplier", "customer", "nation", "region"):
        shutil.copyfile(f"{SMALL}/{n}.parquet", path / f"{n}.parquet")
    lines, part = spark.read.parquet(f"{SMALL}/lineitem.parquet"), spark.read.parquet(f"{SMALL}/part.parquet")
    again = lines.filter("l_orderkey % 7 = 0").unionByName(lines.filter("l_orderkey % 11 = 0").withColumn("l_shipdate", F.expr("l_shipdate + INTERVAL 40 DAYS")))
    torn = lines.filter("l_orderkey % 13 = 0").withColumn("l_linenumber", F.lit(None).cast(lines.schema["l_linenumber"].dataType))
    lines.unionByName(again).unionByName(torn).write.parquet(f"{path}/lineitem.parquet")
    part.unionByName(part.filter("p_partkey <= 5")).write.parquet(f"{path}/part.parquet")
    return Build(configure(spark), str(path))


def test_both_ways_of_a_tube_give_what_the_joins_give(repeated_lines):
    b = repeated_lines
    assert 0 < b.stored.keyed_lines.filter("single").count() < b.stored.keyed_lines.count()
    quality, energy = star.fact_quality(b.quality_results, b.production, PERIOD), star.fact_energy(b.energy_events, b.production, PERIOD)
    ranked = diagnostics.ranked_tubes(b.production, b.process_parameters, b.quality_results, b.energy_events)
    linked = diagnostics.associated_tubes(b.production, b.process_parameters, b.quality_results)
    for made, want in (
        (b.quality, quality), (b.tube_energy, star.energy_totals(b.energy_events, b.production, PERIOD)),
        (b.tube_labels, features.tube_labels(b.production, quality, energy)),
        (b.segment_links, diagnostics.segment_associations(linked)),
    ):
        assert rows_of(made, sorted(want.columns)) == rows_of(want, sorted(want.columns))
    keys = ["product_code", "grade_family"]
    tubes = b.cells.groupBy(*keys).agg(F.sum("tube_count"))
    assert rows_of(tubes, tubes.columns) == rows_of(ranked.groupBy(*keys).count(), [*keys, "count"])
    orders = b.production.groupBy("order_id").agg(F.count(F.lit(1)).alias("tube_count"), F.max("actual_end_ts").alias("last_end_ts"), F.sum("good_mass_t").alias("good_tonnes"))
    assert rows_of(b.order_rows, orders.columns) == rows_of(orders.filter("order_id IS NOT NULL"), orders.columns)


def test_orders_and_labels_exchange_no_tubes(spark):
    b = Build(configure(spark), SMALL)
    for frame in (b.order_mart, features.order_labels(b.order_rows), b.tube_labels):
        assert "Exchange hashpartitioning" not in plan_of(frame)
