"""Data-quality and reconciliation rules as rows of one report.

Row rules of a table share a single aggregation pass; key, reference and reconciliation rules are joins or small
aggregates. Report columns: check_id, observed, expected, status, detail.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonnage.functions.scalar import close_to


@dataclass(frozen=True)
class Rule:
    """`kind` decides the meaning of `where` and `params`.

    rows: count rows where the SQL predicate `where` holds, expected `equals` (default 0)
    count: count all rows; `equals` gives the target
    key: duplicates plus nulls of `columns`, expected 0
    reference: rows whose `columns[0]` is missing in `other`.`columns[1]`, expected 0
    distinct: number of distinct values of `columns[0]`, expected `equals` (`at_least` also works)
    """

    id: str
    kind: str
    table: str
    where: str | None = None
    columns: tuple[str, ...] = ()
    other: str | None = None
    equals: float | None = 0
    at_least: float | None = None
    detail: str = ""


def _verdict(rule: Rule, observed: Column) -> list[Column]:
    if rule.at_least is not None:
        ok, expected = observed >= F.lit(float(rule.at_least)), f">= {rule.at_least:g}"
    else:
        ok, expected = observed == F.lit(float(rule.equals)), f"{rule.equals:g}"
    return [
        F.lit(rule.id).alias("check_id"),
        observed.alias("observed"),
        F.lit(expected).alias("expected"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        F.lit(rule.detail).alias("detail"),
    ]


def _one_pass(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    counts = [
        (F.count(F.lit(1)) if r.kind == "count" else F.count_if(F.expr(r.where))).cast("double").alias(f"c{i}") for i, r in enumerate(rules)
    ]
    wide = df.agg(*counts)
    structs = F.array(*[F.struct(*_verdict(r, F.col(f"c{i}"))) for i, r in enumerate(rules)])
    return wide.select(F.inline(structs))


def _single(frames: Mapping[str, DataFrame], rule: Rule) -> DataFrame:
    df = frames[rule.table]
    if rule.kind == "key":
        nulls = F.lit(False)
        for c in rule.columns:
            nulls = nulls | F.col(c).isNull()
        grouped = df.groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("__n"))
        bad = F.coalesce(F.sum(F.when(nulls, F.col("__n")).otherwise(F.col("__n") - 1)), F.lit(0))
        observed = grouped.agg(bad.cast("double").alias("__o"))
    elif rule.kind == "reference":
        mine, theirs = rule.columns
        keys = frames[rule.other].select(F.col(theirs).alias(mine)).distinct()
        observed = df.select(mine).join(keys, mine, "left_anti").agg(F.count(F.lit(1)).cast("double").alias("__o"))
    elif rule.kind == "distinct":
        observed = df.groupBy(rule.columns[0]).agg(F.lit(1)).agg(F.count(rule.columns[0]).cast("double").alias("__o"))
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    return observed.select(*_verdict(rule, F.col("__o")))


def run_rules(frames: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """All rules as one report; `rows` and `count` rules of a table need one scan together."""
    report, by_table = None, {}
    for rule in rules:
        if rule.kind in ("rows", "count"):
            by_table.setdefault(rule.table, []).append(rule)
    parts = [_one_pass(frames[t], rs) for t, rs in by_table.items()]
    parts += [_single(frames, r) for r in rules if r.kind not in ("rows", "count")]
    for part in parts:
        report = part if report is None else report.unionByName(part)
    return report


def reconcile(check_id: str, left: DataFrame, left_value: Column, right: DataFrame, right_value: Column, relative: float = 1e-12, absolute: float = 1e-8) -> DataFrame:
    """Compare two totals from different tables within a tolerance."""
    a = left.agg(left_value.cast("double").alias("v")).scalar()
    both = right.agg(right_value.cast("double").alias("__r")).withColumn("__l", a)
    ok = F.coalesce(close_to("__l", "__r", relative, absolute), F.lit(False))
    return both.select(
        F.lit(check_id).alias("check_id"),
        F.col("__l").alias("observed"),
        F.col("__r").cast("string").alias("expected"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        F.lit("both totals must agree").alias("detail"),
    )


def reconcile_totals(spark: SparkSession, pairs: Sequence[tuple[str, float | None, float | None]], relative: float = 1e-12, absolute: float = 1e-8) -> DataFrame:
    """Compare control totals that were observed while their frames were written: (check_id, left, right). No data is read."""
    totals = spark.createDataFrame([(i, a, b) for i, a, b in pairs], "check_id string, __l double, __r double")
    ok = F.coalesce(close_to("__l", "__r", relative, absolute), F.lit(False))
    return totals.select(
        "check_id", F.col("__l").alias("observed"), F.col("__r").cast("string").alias("expected"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"), F.lit("both totals must agree").alias("detail"),
    )


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    a = left.select(F.col(key).alias("__a")).distinct()
    b = right.select(F.col(key).alias("__b")).distinct()
    return a.join(b, F.col("__a") == F.col("__b"), "full").filter("__a IS NULL OR __b IS NULL").select(
        F.coalesce("__a", "__b").alias(key), F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side")
    )


def missing_names(required: DataFrame, present: DataFrame, name: str) -> DataFrame:
    return required.select(name).distinct().join(present.select(name).distinct(), name, "left_anti")


def summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"))
