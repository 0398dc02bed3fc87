"""Landed files: JSON record lists, CSV incidents, historical snapshots.

All readers take an explicit schema (no inference pass over a large landing
zone).  A lake object written as one top-level JSON array on one line is read
as one row per element; such a file cannot be split, so the writers here
produce JSON lines (splittable) and the bronze copy should be Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.operators.clean import csv_to_typed, snapshot_to_raw, type_incidents
from gridwatch.operators.facts import snapshot_limit
from gridwatch.schema import CSV_INCIDENT, SNAPSHOT_INCIDENT
from gridwatch.session import materialised

# ---------------------------------------------------------------------------
# Fixed values
#   lake prefix for raw crime records: raw/crime/<file>
#   snapshot row cap: 300000
# ---------------------------------------------------------------------------
RAW_PREFIX = "raw/crime"
SNAPSHOT_CAP = 300_000


def lake_path(root: str, filename: str, prefix: str = RAW_PREFIX) -> str:
    return f"{root.rstrip('/')}/{prefix}/{filename}"


def read_json_list(spark: SparkSession, path: str, schema: T.StructType,
                   multiline: bool = False) -> DataFrame:
    """A lake object: JSON lines, or (``multiline``) one JSON array per file.

    A missing path raises (the reference returned None on any error; here the
    job fails visibly instead of continuing with no data).
    """
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def write_json_list(df: DataFrame, path: str) -> None:
    """Write records as JSON lines (one object per line), replacing the object."""
    df.write.mode("overwrite").json(path)


def with_file_order(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Add the arrival order of a file read: rows numbered 0, 1, ... by (file path, place in the file).

    Spark packs splits into tasks by size, so neither task order nor
    ``monotonically_increasing_id`` is file order.  The rows are written once (the
    bronze copy) with their path, split start and running number; counting
    rows per split gives each split's offset.  The numbers do not depend on
    how the files were split.
    """
    from pyspark.sql import Window

    rows = materialised(df.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at")), "bronze")
    # One row per split: its rows lie in one task, in order.
    splits = rows.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.join(offsets, ["_path", "_start"])
            .withColumn(seq_col, F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_path", "_start", "_at", "_first", "_before"))


def read_incident_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Incident CSV with header -> canonical typed incidents (CSV semantics)."""
    csv = spark.read.option("header", True).schema(CSV_INCIDENT).csv(path)
    return csv_to_typed(with_file_order(csv))


def read_snapshot(spark: SparkSession, path: str, multiline: bool = True,
                  limit: int | None = None) -> DataFrame:
    """Historical snapshot (list of string records) -> typed incidents in file order.

    All rows unless the caller asks for the first ``limit`` (``SNAPSHOT_CAP`` is
    the cap of the original request); ``facts.beyond_limit`` counts what a limit drops.
    """
    snap = with_file_order(read_json_list(spark, path, SNAPSHOT_INCIDENT, multiline))
    typed = type_incidents(snapshot_to_raw(snap))
    return typed if limit is None else snapshot_limit(typed, limit)


def publish_json(df: DataFrame, path: str, fields: list[str] | None = None) -> DataFrame:
    """Records as JSON text messages ``(seq, value)``, written as JSON lines to ``path``.

    The offline stand-in for publishing to the topic (``to_json`` per record,
    done by the executors; a failure fails the job instead of returning 0).
    """
    cols = fields or [c for c in df.columns if c != "seq"]
    out = df.select(F.col("seq"), F.to_json(F.struct(*cols)).alias("value"))
    out.write.mode("append").json(path)
    return out


def publish_kafka(df: DataFrame, servers: str, topic: str, fields: list[str] | None = None) -> None:
    """Publish each record as a JSON message to a Kafka topic (batch write).

    Needs the spark-sql-kafka connector on the classpath; not exercised
    offline (the jar is not installed here).  ``publish_json`` is the file
    equivalent used by the tests.
    """
    cols = fields or [c for c in df.columns if c != "seq"]
    (df.select(F.to_json(F.struct(*cols)).alias("value"))
     .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())
