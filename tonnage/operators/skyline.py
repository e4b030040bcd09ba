"""Pareto front: rows that no other row beats on every objective (all minimised)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonnage.functions.scalar import null_safe_join
from tonnage.operators.ordered import row_numbers
from tonnage.sources.scratch import written


def _dominated(victims: np.ndarray, killers: np.ndarray, tolerance: float) -> np.ndarray:
    out = np.zeros(len(victims), dtype=bool)
    step = max(1, 2_000_000 // max(1, len(victims)))
    for start in range(0, len(killers), step):
        part = killers[start : start + step]
        no_worse = np.ones((len(victims), len(part)), dtype=bool)
        better = np.zeros((len(victims), len(part)), dtype=bool)
        for d in range(victims.shape[1]):
            gap = victims[:, d : d + 1] - part[None, :, d]
            no_worse &= gap >= -tolerance
            better |= gap > tolerance
        out |= (no_worse & better).any(axis=1)
    return out


def _front(values: np.ndarray, tolerance: float, first: int = 256) -> np.ndarray:
    """Mask of the rows that no other row beats. The rows with the least sums beat most others, so they go first (exact: who
    is left still meets all that are left)."""
    alive = np.ones(len(values), dtype=bool)
    if len(values) > first:
        best = values[np.argpartition(values.sum(axis=1), first)[:first]]
        alive = ~_dominated(values, best, tolerance)
    rest = np.flatnonzero(alive)
    alive[rest] = ~_dominated(values[rest], values[rest], tolerance)
    return alive


def skyline(
    df: DataFrame, objectives: Sequence[str], key: str, by: Sequence[str] = (), block_rows: int = 4096, tolerance: float = 1e-12, fan_in: int = 8
) -> DataFrame:
    """Non-dominated rows of `df`, per group when `by` is given.

    A tree of merges: every Arrow batch keeps its own front; what is left is cut, per group, into blocks of at most
    `block_rows` along the sum of the objectives; fronts of `fan_in` neighbouring nodes then become the front of one node,
    level by level, and after each level the survivors are packed into fewer blocks. A task compares one block with one other
    block whose box allows it to win, and emits keys of beaten rows. Nothing but row counts reaches the driver, and a level
    works on survivors only; a front that holds nearly all rows must still compare nearly all its blocks.
    """
    objectives, by = list(objectives), list(by)
    slim = df.select(*by, key, *[F.col(c).cast("double").alias(c) for c in objectives])

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [part for _, part in batch.groupby(by, dropna=False, sort=False)] if by else [batch]
            for part in parts:
                yield part[_front(part[objectives].to_numpy(float), tolerance)]

    # the thinning depends on batch borders, so all later steps must see one fixed result
    alive = written(slim.mapInPandas(thin, slim.schema), "thinned").withColumn("__node", F.lit(0).cast("long"))
    score = sum((F.col(c) for c in objectives[1:]), F.col(objectives[0]))
    while True:
        largest = (alive.groupBy(*by, "__node") if by else alive.groupBy("__node")).agg(F.count(F.lit(1)).alias("n"))
        sizes = largest.agg(F.max("n").alias("most"), F.max("__node").alias("nodes")).first()
        nodes, most = (sizes["nodes"] or 0) + 1, sizes["most"] or 0
        if nodes == 1:
            # one node per group: its rows have not met beyond their batch (first turn) or are the front (later turns)
            if most <= block_rows:
                front = _local(alive.withColumn("__block", F.lit(0).cast("long")), by, key, objectives, tolerance)
                return _kept(df, front, by, key)
            blocks = -(-most // block_rows)
            ranked = row_numbers(alive.withColumn("__score", score), by, "__score", key, name="__rank")
            cut = ranked.withColumn("__block", F.floor((F.col("__rank") - 1) / block_rows)).drop("__rank", "__score")
            alive = written(_local(cut, by, key, objectives, tolerance).withColumn("__node", F.col("__block")), "fronts")
            nodes = blocks
        while nodes > 1:
            alive = written(_merged(alive, by, key, objectives, tolerance, block_rows, fan_in, score), "merged")
            nodes = -(-nodes // fan_in)
        return _kept(df, alive, by, key)


def _kept(df: DataFrame, front: DataFrame, by: list[str], key: str) -> DataFrame:
    return df.join(front.select(*by, key).distinct(), [*by, key], "left_semi") if not by else null_safe_join(df, front.select(*by, key).distinct(), [*by, key], "left_semi")


def _local(cut: DataFrame, by: list[str], key: str, objectives: list[str], tolerance: float) -> DataFrame:
    """Front of every (group, block); a block is bounded."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return part[_front(part[objectives].to_numpy(float), tolerance)]

    slim = cut.select(*by, key, *objectives, "__block")
    return slim.groupBy(*by, "__block").applyInPandas(run, slim.schema)


def _merged(alive: DataFrame, by: list[str], key: str, objectives: list[str], tolerance: float, block_rows: int, fan_in: int, score) -> DataFrame:
    """One level: nodes of `fan_in` become one; rows meet the blocks of the other old nodes in their new node."""
    ranked = row_numbers(alive.drop("__block").withColumn("__score", score), [*by, "__node"], "__score", key, name="__rank")
    rows = ranked.withColumn("__block", F.floor((F.col("__rank") - 1) / block_rows)).drop("__rank", "__score")
    rows = written(rows.withColumn("__next", F.floor(F.col("__node") / fan_in)), "packed")
    lows = [f"__lo{i}" for i in range(len(objectives))]
    boxes = rows.groupBy(*by, "__next", "__node", "__block").agg(*[F.min(c).alias(lo) for c, lo in zip(objectives, lows, strict=True)])
    boxes = boxes.withColumnsRenamed({"__node": "__knode", "__block": "__kblock"})
    met = null_safe_join(rows, boxes, [*by, "__next"]).filter(F.col("__knode") != F.col("__node"))
    for c, lo in zip(objectives, lows, strict=True):
        met = met.filter(F.col(lo) <= F.col(c) + F.lit(1e-9))
    cell = [*by, "__next", "__node", "__block", "__knode", "__kblock"]
    victims = met.select(*cell, key, *objectives)
    pairs = victims.select(*cell).distinct()
    rivals = [f"__o_{i}" for i in range(len(objectives))]
    killers = rows.select(*by, "__next", F.col("__node").alias("__knode"), F.col("__block").alias("__kblock"), *[F.col(c).alias(r) for c, r in zip(objectives, rivals, strict=True)])
    killers = null_safe_join(killers, pairs, [*by, "__next", "__knode", "__kblock"])
    names = [f"__r_{i}" for i in range(len(cell))]
    killers = killers.select(*[F.col(c).alias(n) for c, n in zip(cell, names, strict=True)], *rivals)
    out = T.StructType([*[alive.schema[c] for c in by], alive.schema[key]])

    def beat(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        lost = _dominated(a[objectives].to_numpy(float), b[rivals].to_numpy(float), tolerance)
        return a.loc[lost, [*by, key]]

    beaten = victims.groupBy(*cell).cogroup(killers.groupBy(*names)).applyInPandas(beat, out).distinct()
    left = rows.select(*by, key, *objectives, F.col("__next").alias("__node"))
    return null_safe_join(left, beaten, [*by, key], "left_anti")
