"""The driver contract: names line up, the flagship runs, and a few queries agree with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_line_up():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 180


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["mt2_line_shift_performance", "pt6_next_window_labels", "jn9_asof", "dq4_foreign_keys", "wn5_ntile"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    pick = sorted(names)
    order = [names.index(n) for n in pick]
    want = sorted((tuple(repr(r[i]) for i in order) for r in cursor.fetchall()))
    got = sorted(tuple(repr(v) for v in r) for r in df.select(*pick).collect())
    assert got == want


@pytest.mark.parametrize("name", ["sc15_medoids", "sc19_probes"])
def test_every_label_is_a_context(spark, name):
    directory = "/root/testdata/sf0.01"
    labels = {r[0] for r in spark.read.parquet(f"{directory}/embeddings.parquet").select("label").distinct().collect()}
    assert {r["label"] for r in entry.queries()[name](spark, directory).select("label").distinct().collect()} == labels


def test_front_of_all_scenarios(spark):
    directory = "/root/testdata/sf0.01"
    front = {r["scenario_id"] for r in entry.queries()["sc9_pareto_front"](spark, directory).collect()}
    refused = {r["scenario_id"] for r in entry.queries()["sc8_scenario_scores"](spark, directory).filter("NOT hard_constraints_pass").collect()}
    assert front & refused
