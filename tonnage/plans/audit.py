"""Rank-correlation audit of expected mechanisms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.functions.scalar import null_safe_join, safe_corr
from tonnage.operators.ordered import average_ranks, average_ranks_together
from tonnage.sources.scratch import written


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_rows: int = 20) -> DataFrame:
    """Spearman correlation per group with average ranks; null below `min_rows` pairs.

    Pairs collapse to distinct (x, y) counts, and each rank table has one row per distinct value.
    """
    by = list(by)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    rx = average_ranks(pairs, by, "__x", "__rx").drop("__rx_ties")
    ry = average_ranks(pairs, by, "__y", "__ry").drop("__ry_ties")
    ranked = null_safe_join(null_safe_join(pairs, rx, [*by, "__x"]), ry, [*by, "__y"])
    n = F.count(F.lit(1))
    out = [n.alias("pairs"), F.when(n >= min_rows, safe_corr("__rx", "__ry")).alias("rho")]
    return ranked.groupBy(*by).agg(*out) if by else ranked.agg(*out)


@dataclass(frozen=True)
class Mechanism:
    name: str
    signal: str
    target: str
    sign: int
    features: tuple[str, ...] = ()


def audit_pairs(df: DataFrame, mechanisms: Sequence[Mechanism], threshold: float = 0.08, min_rows: int = 20) -> DataFrame:
    """One row per mechanism: is the association strong enough and of the expected sign?

    Without nulls each column is ranked once and one aggregation correlates all pairs; with nulls the ranks
    depend on the pair, so each pair is ranked on its own rows.
    """
    columns = sorted({c for m in mechanisms for c in (m.signal, m.target)})
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    rows = None
    if any(gaps):
        for i, m in enumerate(mechanisms):
            row = spearman(df, m.signal, m.target, min_rows=min_rows).select(F.lit(i).alias("__i"), "pairs", "rho")
            rows = row if rows is None else rows.unionByName(row)
    else:
        ranked = average_ranks_together(df.select(*columns), {c: f"__rank_{c}" for c in columns})
        rhos = [safe_corr(f"__rank_{m.signal}", f"__rank_{m.target}").alias(f"r{i}") for i, m in enumerate(mechanisms)]
        wide = ranked.agg(F.count(F.lit(1)).alias("pairs"), *rhos)
        parts = F.array(*[F.struct(F.lit(i).alias("__i"), F.when(F.col("pairs") >= min_rows, F.col(f"r{i}")).alias("rho")) for i in range(len(mechanisms))])
        rows = wide.select("pairs", F.inline(parts))

    def pick(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__i") + 1)

    strong = (F.abs("rho") >= threshold) & (F.signum("rho") == pick([float(m.sign) for m in mechanisms]))
    return rows.select(
        pick([m.name for m in mechanisms]).alias("mechanism"),
        pick([m.signal for m in mechanisms]).alias("signal"),
        pick([m.target for m in mechanisms]).alias("target"),
        "pairs",
        "rho",
        F.coalesce(strong, F.lit(False)).alias("associated"),
    )


def recovered(audit: DataFrame, expected: DataFrame, importance: DataFrame, top: int = 20, needed: int = 4) -> DataFrame:
    """A mechanism counts when associated and one of its expected features ranks in the top; `enough` judges the count.

    `expected`: mechanism, feature. `importance`: feature, rank.
    """
    ranked = expected.join(importance.filter(F.col("rank") <= top), "feature", "left_semi").select("mechanism").distinct()
    # a row for each mechanism, read twice
    hits = written(audit, "audit").join(ranked.withColumn("feature_ranked", F.lit(True)), "mechanism", "left")
    hits = hits.withColumn("feature_ranked", F.coalesce("feature_ranked", F.lit(False)))
    hits = hits.withColumn("recovered", F.col("associated") & F.col("feature_ranked"))
    total = hits.agg(F.count_if("recovered").alias("n")).scalar()
    return hits.withColumn("enough", total >= needed)
