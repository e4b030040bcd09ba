"""Tables of the build on shared storage: bucketed by key, with control totals observed while they are written."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonnage.operators.ordered import range_count
from tonnage.sources.scratch import scratch


def bucketed(df: DataFrame, name: str, key: str, exchanged: bool = False, parts: int | None = None) -> DataFrame:
    """Write `df` once, bucketed by `key`; joins and aggregations of such tables on the key need no exchange.

    `parts` buckets, or as many as the session has shuffle partitions. A frame that was `exchanged` into so many partitions by the key is
    written as it is, any other is exchanged first, so that a bucket is one file. `key` must be spread (a hash): a hot key
    would be one hot bucket."""
    spark = df.sparkSession
    table = f"tonnage_{name}_{os.urandom(8).hex()}"
    parts = parts or range_count(df)
    spread = df if exchanged else df.repartition(parts, key)
    writer = spread.write.format("parquet").bucketBy(parts, key)
    writer.option("compression", "zstd").option("path", f"{scratch(spark)}/{name}").saveAsTable(table)
    return spark.table(table)


class Totals:
    """Sums and counts of a frame, taken by Spark while the frame is written.

    The observation stands in the writing stage, whose tasks count once however often they are tried."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, sums: Mapping[str, str | Column]) -> DataFrame:
        """`df`, watched: every entry of `sums` is an SQL aggregate, read as a double."""
        self._seen[name] = Observation(name)
        columns = [(F.expr(e) if isinstance(e, str) else e).cast("double").alias(n) for n, e in sums.items()]
        return df.observe(self._seen[name], *columns)

    def of(self, name: str) -> dict[str, float]:
        return self._seen[name].get


def source_version(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of every file below the paths: what was written from them is stale once this changes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return tuple(sorted((r["path"], r["length"], str(r["modificationTime"])) for r in files.select("path", "length", "modificationTime").collect()))
