"""Start, run to completion and read back the incident streaming pipelines."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridwatch.operators import clean, graph
from gridwatch.session import default_parallelism
from gridwatch.streaming import sinks, source, windows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession, partitions: int | None = None, rocksdb: bool = False):
    """Shuffle / state partitions (and the state store) for streams started inside the block.

    A stream copies the session when it starts and records the partition count in its checkpoint:
    a stream with state keeps it for life.  Size it for the data that the stream will
    hold, not for today's cores; without ``partitions`` it is one per core of the cluster.
    The caller's settings are restored after ``start()``.
    """
    new = {"spark.sql.shuffle.partitions": str(partitions or default_parallelism(spark))}
    if rocksdb:
        new["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def observed(stream: DataFrame, name: str = "ingest") -> DataFrame:
    """Per-batch row counts, reported in ``StreamingQuery.lastProgress['observedMetrics']``.

    Computed by the executors as the batch flows (no extra job).
    """
    return stream.observe(name, F.count(F.lit(1)).alias("records"),
                          F.count_if(~F.col("payload_ok")).alias("unparseable"))


def batch_counts(query: StreamingQuery) -> list[dict]:
    """Observed row counts of every recent micro-batch of ``query``."""
    return [p["observedMetrics"].get("ingest", {}) for p in query.recentProgress if p.get("observedMetrics")]


def start(stream: DataFrame, sink, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def wait(spark: SparkSession, queries: list[StreamingQuery], available_now: bool = True) -> list[StreamingQuery]:
    """Wait for all queries (available-now) or for any to end; raise a failure; leave none running."""
    try:
        if available_now:
            for q in queries:
                q.awaitTermination()  # raises what the query failed with
        else:
            spark.streams.resetTerminated()
            if all(q.isActive for q in queries):
                spark.streams.awaitAnyTermination()
            for q in queries:
                if not q.isActive:
                    q.awaitTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    return queries


def run_incidents(spark: SparkSession, records: DataFrame, root: str, checkpoint: str, mode: str = "single",
                  available_now: bool = True, partitions: int | None = None) -> list[StreamingQuery]:
    """Run the fact + graph pipeline over streaming ``records`` (``source.kafka_stream``, ``source.file_stream``).

    ``mode="single"``: one query, one ``foreachBatch`` that persists the batch
    and writes both stores (the topic is read and parsed once).
    ``mode="dual"``: two queries with their own checkpoints, one per store, as
    the reference runs them.
    """
    stream = observed(source.parsed(records))
    plans = ([(sinks.IncidentSink(root, checkpoint), checkpoint)] if mode == "single" else
             [(sinks.IncidentSink(root, checkpoint + "/fact", write_graph=False), checkpoint + "/fact"),
              (sinks.IncidentSink(root, checkpoint + "/graph", write_fact=False), checkpoint + "/graph")])
    with stream_settings(spark, partitions):
        queries = [start(stream, sink, at, available_now) for sink, at in plans]
    return wait(spark, queries, available_now)


def run_incidents_stateful(spark: SparkSession, records: DataFrame, root: str, checkpoint: str,
                           available_now: bool = True, partitions: int | None = None) -> list[StreamingQuery]:
    """Fact + graph with keyed streaming state in the JVM (``dropDuplicates``, RocksDB).

    Each edge, and each record of a replayed topic, passes once for the life of the checkpoint, so
    replays store nothing; state is partitioned by key.  First-wins rows are still resolved by
    ``seq`` on read.
    """
    parsed = observed(source.parsed(records))
    edges = graph.edge_triples(graph.graph_input(clean.type_incidents(parsed))).dropDuplicates(["edge_type", "src", "dst"])
    once = parsed.dropDuplicates(["seq", "id"])
    with stream_settings(spark, partitions, rocksdb=True):
        queries = [start(edges, sinks.EdgeSink(root, checkpoint + "/edges"), checkpoint + "/edges", available_now),
                   start(once, sinks.IncidentSink(root, checkpoint + "/rows", write_edges=False), checkpoint + "/rows",
                         available_now)]
    return wait(spark, queries, available_now)


def run_window_counts(spark: SparkSession, records: DataFrame, out: str, checkpoint: str,
                      size: str = "1 day", available_now: bool = True) -> DataFrame:
    """Window counts of the stream, stored per batch; returns the current counts."""
    with stream_settings(spark):
        q = start(source.parsed(records), windows.CountSink(out, checkpoint, size), checkpoint, available_now)
    wait(spark, [q], available_now)
    return windows.read_window_counts(spark, out)


def run_incident_window_counts(spark: SparkSession, records: DataFrame, out: str, checkpoint: str,
                               size: str = "1 day", available_now: bool = True) -> DataFrame:
    """Window counts of incidents (each id once, however often and under whichever checkpoint it is read)."""
    with stream_settings(spark):
        q = start(source.parsed(records), windows.IncidentCountSink(out, checkpoint, size), checkpoint, available_now)
    wait(spark, [q], available_now)
    return windows.read_incident_window_counts(spark, out)
