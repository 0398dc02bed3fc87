"""Event-time window counts on the incident stream, without loss of late rows.

Offences are often reported months late.  A watermark would drop such rows without a trace, so the
stream keeps no window state: each micro-batch stores the partial counts of the windows it touched
(one row per window and type, whatever its lateness), and readers add them up.  A retried
batch overwrites its own rows.

``CountSink`` counts records: a record that is read twice, or under a second checkpoint, counts twice.
``IncidentCountSink`` counts incidents.  It stores each batch's first record per id with its window, and readers
take the first record of each id over all batches and checkpoints before they count.  So a replayed id
changes nothing, and an earlier record that arrives late moves its incident to another window (it leaves
the old one).  ``compact_incidents`` folds the batches into one row per id, ``compact_window_counts`` those of ``CountSink``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.operators import clean
from gridwatch.operators.clean import type_incidents
from gridwatch.operators.facts import pick_by_seq
from gridwatch.session import remove_path
from gridwatch.streaming.sinks import BATCH_COL, run_token

KEYS = ["window_start", "window_end", "incident_type"]


def window_counts(typed: DataFrame, size: str = "1 day") -> DataFrame:
    """Incidents per (tumbling window of ``offense_date``, incident_type); rows without a date are left out."""
    return (typed.filter(F.col("offense_date").isNotNull())
            .groupBy(F.window("offense_date", size).alias("w"), "incident_type")
            .agg(F.count(F.lit(1)).alias("incidents"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "incident_type", "incidents"))


class CountSink:
    """``foreachBatch`` callback storing each batch's window counts under its own directory."""

    def __init__(self, path: str, checkpoint: str, size: str):
        self.path = path.rstrip("/")
        self.token = run_token(checkpoint)
        self.size = size

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        (window_counts(type_incidents(batch_df), self.size)
         .write.mode("overwrite").parquet(f"{self.path}/{BATCH_COL}={self.token}_{batch_id:012d}"))


class IncidentCountSink:
    """``foreachBatch`` callback storing (id, seq, window, type) of the first record per id in the batch."""

    def __init__(self, path: str, checkpoint: str, size: str):
        self.path, self.token, self.size = path.rstrip("/"), run_token(checkpoint), size

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        typed = clean.has_key(type_incidents(batch_df))
        at = F.window("offense_date", self.size)
        # A row without a date holds its id's place: a later record with a date does not count.
        rows = typed.filter(F.col("offense_date").isNotNull()).select(
            "id", "seq", at.start.cast("timestamp_ntz").alias("window_start"), at.end.cast("timestamp_ntz").alias("window_end"), "incident_type")
        none = F.lit(None).cast("timestamp_ntz")
        rows = rows.unionByName(typed.filter(F.col("offense_date").isNull()).select(
            "id", "seq", none.alias("window_start"), none.alias("window_end"), "incident_type"))
        first_records(rows).write.mode("overwrite").parquet(f"{self.path}/{BATCH_COL}={self.token}_{batch_id:012d}")


def first_records(rows: DataFrame) -> DataFrame:
    return pick_by_seq(rows, ["id"], ["id", "seq", *KEYS])


def read_incident_window_counts(spark: SparkSession, path: str) -> DataFrame:
    """Incidents per window and type: each id once, by its first record."""
    return (first_records(spark.read.parquet(path)).filter(F.col("window_start").isNotNull())
            .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("incidents")))


def compact_incidents(spark: SparkSession, path: str, name: str) -> None:
    """Fold all stored batches into the batch ``name``; readers see the same counts before, between and after."""
    stored = spark.read.parquet(path)
    old = [r[0] for r in stored.select(BATCH_COL).distinct().collect()]  # one row per batch
    if name in old:
        raise ValueError(f"batch {name} is stored already")
    first_records(stored).write.parquet(f"{path}/{BATCH_COL}={name}")
    for key in old:
        remove_path(spark, f"{path}/{BATCH_COL}={key}")


#: Stored window counts.  A row with ``covers`` holds no count: it names a batch that its own batch replaces.
COUNTS = T.StructType([T.StructField("window_start", T.TimestampNTZType()), T.StructField("window_end", T.TimestampNTZType()),
                       T.StructField("incident_type", T.StringType()), T.StructField("incidents", T.LongType()),
                       T.StructField("covers", T.StringType()), T.StructField(BATCH_COL, T.StringType())])


def _counting(stored: DataFrame) -> DataFrame:
    """The rows of batches that no folded batch covers, summed."""
    covered = stored.filter(F.col("covers").isNotNull()).select(F.col("covers").alias(BATCH_COL)).distinct()
    return (stored.filter(F.col("covers").isNull()).join(covered, BATCH_COL, "left_anti")
            .groupBy(*KEYS).agg(F.sum("incidents").alias("incidents")))


def read_window_counts(spark: SparkSession, path: str) -> DataFrame:
    return _counting(spark.read.schema(COUNTS).parquet(path))


def compact_window_counts(spark: SparkSession, path: str, name: str) -> None:
    """Fold all batches, as stored now, into the batch ``name``; then delete them.

    Sums can't be merged twice, so the folded batch names those it covers, one row each, and readers leave these out:
    they see the same counts before, between and after the two steps, and when a covered batch is written again later.
    """
    stored = spark.read.schema(COUNTS).parquet(path)
    old = [r[0] for r in stored.select(BATCH_COL).distinct().collect()]  # one row per batch
    if name in old:
        raise ValueError(f"batch {name} is stored already")
    covers = (stored.select(F.col(BATCH_COL).alias("covers")).unionByName(stored.filter(F.col("covers").isNotNull()).select("covers"))
              .distinct())
    (_counting(stored).unionByName(covers, allowMissingColumns=True)
     .write.parquet(f"{path}/{BATCH_COL}={name}"))
    for key in old:
        remove_path(spark, f"{path}/{BATCH_COL}={key}")
