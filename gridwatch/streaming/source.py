"""Streaming sources for incident payloads.

A record is ``(seq, value)``: the JSON text payload plus its arrival order.
From Kafka, ``seq`` is derived from (offset, partition); from landed files,
it is a field of each line.  ``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``
bound every micro-batch, which also bounds what a sink may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.operators.clean import parse_payload

# ---------------------------------------------------------------------------
# Fixed values
#   topic: raw_crime_data; start from the earliest offset; at most 5000 offsets per trigger
# ---------------------------------------------------------------------------
TOPIC = "raw_crime_data"
MAX_OFFSETS_PER_TRIGGER = 5000
PARTITION_BITS = 12   # seq = offset * 2^12 + partition (up to 4096 partitions)

LANDING = T.StructType([
    T.StructField("seq", T.LongType(), True),
    T.StructField("value", T.StringType(), True),
])


def kafka_stream(spark: SparkSession, servers: str, topic: str = TOPIC,
                 max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> DataFrame:
    """Records from Kafka (needs the spark-sql-kafka connector on the classpath).

    Not exercised offline: the connector jar is not installed here.
    """
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic)
           .option("startingOffsets", "earliest")
           .option("maxOffsetsPerTrigger", max_offsets)
           .load())
    seq = F.shiftleft(F.col("offset"), PARTITION_BITS) + F.col("partition")
    return raw.select(seq.alias("seq"), F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Records from JSON-lines files landed under ``path`` (one record per line)."""
    return (spark.readStream.schema(LANDING)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .json(path))


def parsed(records: DataFrame) -> DataFrame:
    """Records -> raw payload columns + ``seq`` + ``payload_ok`` (stream transform, no shuffle)."""
    return parse_payload(records, "value", "seq")


def land_records(records: DataFrame, path: str, n_files: int) -> None:
    """Land ``(seq, value)`` records as ``n_files`` JSON-lines files, in no particular order.

    One distributed job; arrival order is ``seq``, not the order of files.  This builds
    test feeds; production data lands by itself.
    """
    records.repartition(n_files, F.xxhash64("seq")).write.mode("append").json(path)
