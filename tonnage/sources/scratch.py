"""Tables written once to shared storage, to cut lineage or to reuse a frame across several jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which all executors share.

    Where that is unset, only a local master (one machine, as in tests) gets a temporary folder: on a cluster
    each executor would write to its own disk and later reads would miss those files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tonnage-{os.urandom(8).hex()}"
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once and read it back: one fixed content for all later jobs, safe when executors are lost.

    Spark deletes the shuffle files of the write as it ends, not whenever the driver next collects garbage."""
    path = f"{scratch(df.sparkSession)}/{name}"
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
