"""Publication: gated, ordered and partitioned writes, and order-free table fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class PublicationRefused(RuntimeError):
    """The check report contains failures."""


def export(
    df: DataFrame,
    path: str,
    formats: Sequence[str] = ("parquet", "csv"),
    order: Sequence[str] | str = "all",
    partition_by: str | None = None,
    seen: Observation | None = None,
) -> dict[str, str]:
    """Write one table in total order (range-sorted part files) as Parquet zstd and CSV with a header.

    The plan of `df` runs once: later formats sort what the first one wrote. `seen` gets the `rows` of that first write; it stands
    above the sort, whose range borders come from a pass of its own."""
    keys = df.columns if order == "all" else list(order)
    source, written = df, {}
    for kind in formats:
        target = f"{path}/{kind}"
        ordered = source.orderBy(*keys) if keys else source
        if seen is not None and source is df:
            ordered = ordered.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = ordered.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if kind == "parquet":
            writer.option("compression", "zstd").parquet(target)
            source = df.sparkSession.read.schema(df.schema).parquet(target)
        elif kind == "csv":
            writer.option("header", "true").csv(target)
        else:
            raise ValueError(f"unknown export format {kind!r}")
        written[kind] = target
    return written


def _read_back(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", "true").option("multiLine", "true").csv(path)


def export_package(frames: Mapping[str, DataFrame], root: str, formats: Sequence[str] = ("parquet", "csv")) -> DataFrame:
    """Export several tables; returns table, rows as counted from the files just written."""
    return export_report(frames, root, formats).filter(F.col("format") == formats[0]).select("table_name", F.col("rows"))


def export_report(frames: Mapping[str, DataFrame], root: str, formats: Sequence[str] = ("parquet", "csv")) -> DataFrame:
    """Export several tables: table_name, format, source_rows (observed while the table was written) and rows (in its files)."""
    report = None
    for name, df in frames.items():
        seen = Observation(name)
        for kind, path in export(df, f"{root}/{name}", formats, seen=seen).items():
            rows = _read_back(df.sparkSession, kind, path).agg(F.count(F.lit(1)).alias("rows"))
            row = rows.select(F.lit(name).alias("table_name"), F.lit(kind).alias("format"), F.lit(seen.get["rows"]).cast("long").alias("source_rows"), "rows")
            report = row if report is None else report.unionByName(row)
    return report


def write_partitioned(df: DataFrame, path: str, ts: str, pattern: str = "yyyy-MM") -> None:
    """Partition by calendar day or month; zstd, moderate row groups. A hot month spreads over files by AQE rebalance."""
    parted = df.withColumn("partition", F.date_format(ts, pattern)).hint("rebalance", "partition")
    parted.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", 5_000_000).partitionBy("partition").parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of the content; equal reruns give equal rows."""
    encoded = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = F.xxhash64(encoded)
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("digest_xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest_sum")
    )


def gate(report: DataFrame) -> None:
    """Raise unless every check of the report passed."""
    failed = report.filter(F.col("status") == "FAIL").count()
    if failed:
        raise PublicationRefused(f"{failed} checks failed; nothing was published")


def publish(report: DataFrame, frames: Mapping[str, DataFrame], root: str) -> DataFrame:
    gate(report)
    return export_package(frames, root)


PREDICTION_SCHEMA = (
    "prediction_id string, entity_id string, prediction_time_ts timestamp_ntz, target_name string, p10 double, p50 double, "
    "p90 double, calibrated_probability double, model_version string"
)
SCENARIO_SCHEMA = (
    "scenario_id string, context_id string, scenario_label string, in_distribution boolean, requires_human_approval boolean, "
    "payload_json string, model_version string"
)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project a frame onto a contracted schema, casting by name; a missing column is an error."""
    columns = []
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        columns.append(F.col(name).cast(kind).alias(name))
    return df.select(*columns)


def append_contract(df: DataFrame, ddl: str, path: str) -> None:
    conform(df, ddl).write.mode("append").parquet(path)
