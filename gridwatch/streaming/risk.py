"""Risk per location kept current while the stream runs, at the cost of the batch.

A path ``Location <- Incident -> TimeBlock`` comes into being when the later of its two edges is first seen.  So the scores'
changes are an incremental join: edges made distinct by keyed state, joined stream to stream on the incident.  The join's
state (in the JVM, RocksDB, partitioned by incident) holds the edges seen so far; each path leaves it exactly once, in the batch that
completes it.  No batch reads what is stored: it appends one signed row per (address, band) that it changed, and
readers add the rows up.

``incidents`` counts an incident once per (address, band).  It rides the same join: besides an edge per (incident, hour), which
stands for a path, an incident has one per band, without an hour.  So one query reads and parses the feed once for each side of one join, and holds
the edges to addresses once, for both measures.

A retried batch overwrites its own rows.  The rows lie in a folder per checkpoint, and a reader adds up one of them: a
run under another checkpoint, which reads the feed again, builds its own scores and doubles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.operators import clean, graph
from gridwatch.operators.risk import band_of_part
from gridwatch.streaming.sinks import BATCH_COL, run_token

KEYS = ["address", "band"]
MEASURES = ["risk_score", "incidents"]


def new_paths(g: DataFrame) -> DataFrame:
    """(address, band, measure): for ``risk_score`` each path, once; for ``incidents`` each incident's first path in a band."""
    band = band_of_part(F.col("part_of_day")).alias("band")
    at = g.select(F.col("id").alias("case_id"), F.col("location_key").alias("address")).dropDuplicates(["case_id", "address"])
    per = F.explode(F.array("hour", F.lit(None).cast("int"))).alias("hour")  # no hour: the edge to the band
    during = (g.select(F.col("id").alias("d_id"), "hour", band).filter(F.col("band").isNotNull())
              .select("d_id", "band", per).dropDuplicates(["d_id", "band", "hour"]))
    measure = F.when(F.col("hour").isNull(), "incidents").otherwise("risk_score").alias("measure")
    return at.join(during, F.col("case_id") == F.col("d_id")).select(*KEYS, measure)


class DeltaSink:
    """``foreachBatch`` storing how much a batch adds to the measures of each (address, band)."""

    def __init__(self, out: str, checkpoint: str):
        self.key = run_token(checkpoint)
        self.path = f"{out.rstrip('/')}/run={self.key}"

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        sums = [F.count_if(F.col("measure") == m).alias(m) for m in MEASURES]
        (batch_df.groupBy(*KEYS).agg(*sums)
         .write.mode("overwrite").parquet(f"{self.path}/{BATCH_COL}={self.key}_{batch_id:012d}"))


def read_risk(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """(address, band, risk_score, incidents) as of the last batch of the run under ``checkpoint``."""
    stored = spark.read.parquet(f"{out.rstrip('/')}/run={run_token(checkpoint)}")
    return stored.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).filter(F.col("risk_score") != 0)


def run_risk_stream(spark: SparkSession, records: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                    partitions: int | None = None) -> DataFrame:
    """Bring the scores up to date with the feed; return them."""
    from gridwatch.streaming import source
    from gridwatch.streaming.runner import start, stream_settings, wait

    g = graph.graph_input(clean.type_incidents(source.parsed(records)))
    with stream_settings(spark, partitions, rocksdb=True):
        query = start(new_paths(g), DeltaSink(out, checkpoint), checkpoint, available_now)
    wait(spark, [query], available_now)
    return read_risk(spark, out, checkpoint)
