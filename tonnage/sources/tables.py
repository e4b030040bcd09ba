"""Table, series and document sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    directory: str,
    name: str | None = None,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Parquet directory read recursively and unioned by column name.

    Partition directories stay out of the schema (`recursiveFileLookup`). A declared schema saves the footer
    merge over all files, which matters with many of them; `columns` is pruned into the reader.
    """
    path = f"{directory}/{name}" if name else directory
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def register_layer(spark: SparkSession, frames: Mapping[str, DataFrame], layer: str = "raw") -> list[str]:
    """Temp views `<layer>_<table>`; returns their names."""
    names = []
    for table, df in frames.items():
        view = f"{layer}_{table}"
        df.createOrReplaceTempView(view)
        names.append(view)
    return names


def date_series(bounds: DataFrame, start: str, end: str, out: str = "full_date") -> DataFrame:
    """One row per day between two date columns of a one-row frame, end day included."""
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))
    return bounds.select(F.explode(days).alias(out))


def step_series(df: DataFrame, start: int, stop: int, step: int, out: str) -> DataFrame:
    """Repeat every row for each integer of range(start, stop, step)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step))))


def time_grid(entities: DataFrame, first_day: Column, last_day: Column, step_hours: int, day: str, hour: str) -> DataFrame:
    """entity x day x step grid made by two explodes, so entity rows stay where they are."""
    days = F.sequence(first_day, last_day, F.expr("INTERVAL 1 DAY"))
    return step_series(entities.withColumn(day, F.explode(days)), 0, 24, step_hours, hour)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A contract table whose size is fixed by the code."""
    return spark.createDataFrame(list(rows), schema)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents (one per file, may span lines) under a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def scenario_documents(df: DataFrame, context: str | None = None, label: str | None = None) -> DataFrame:
    """Optional filters of a scenario document table, in document order."""
    if context is not None:
        df = df.filter(F.col("context_id") == context)
    if label is not None:
        df = df.filter(F.col("scenario_label") == label)
    return df.orderBy("context_id", "scenario_label")
