"""Micro-batch sinks: the fact table and the graph, written from one ``foreachBatch``.

Storage layout: every table is a Parquet directory with one sub-directory per
micro-batch (``batch=<run>_<id>``).  A batch overwrites only its own
directory, so a retried batch (after a failure or an executor loss) replaces
its earlier partial output instead of duplicating it.  ``run`` is derived from the
checkpoint location, so a restart on the same checkpoint reuses the same
names and a new checkpoint never touches another run's batches.

No batch reads what is stored: each appends its own rows with ``seq``, and
readers merge (the reference's MERGE / ON CONFLICT rules):

* fact, Location: first-wins by ``seq`` over all batches (a NULL first point stays NULL),
  so a record that arrives in a later batch with a smaller ``seq`` still wins;
* Incident, TimeBlock: last-wins attributes by ``seq``;
* Day, Season, edges, quarantine: sets.

Inside a batch the same rules pre-aggregate, so an id replayed a million times in a
batch is stored once.  ``compact`` folds the batches of a table into one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.operators import clean, facts, graph
from gridwatch.schema import FACT_COLUMNS
from gridwatch.session import remove_path

BATCH_COL = "batch"


def run_token(checkpoint: str) -> str:
    return "b" + hashlib.sha1(checkpoint.encode()).hexdigest()[:10]


def _write(df: DataFrame, path: str, batch_key: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH_COL}={batch_key}")


class IncidentSink:
    """``foreachBatch`` callback writing quarantine, fact and graph tables under ``root``."""

    def __init__(self, root: str, checkpoint: str, write_fact: bool = True, write_graph: bool = True,
                 write_edges: bool = True):
        self.root = root.rstrip("/")
        self.token = run_token(checkpoint)
        self.write_fact = write_fact
        self.write_graph = write_graph
        self.write_edges = write_edges

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        # Persist first: the batch feeds several writes, and each row then passes
        # the upstream plan (parsing, observed metrics) exactly once.
        batch = batch_df.persist()
        try:
            if batch.isEmpty():
                return
            key = f"{self.token}_{batch_id:012d}"
            typed = clean.type_incidents(batch)
            if self.write_fact:
                # Quarantine belongs to the fact side: in two-query mode the
                # graph query must not store the same defects a second time.
                _write(clean.quarantine(batch), self.path("quarantine"), key)
                _write(facts.fact_first_wins(typed), self.path("fact"), key)
            if self.write_graph:
                self._graph(graph.graph_input(typed), key)
        finally:
            batch.unpersist()

    def _graph(self, g: DataFrame, key: str) -> None:
        locations = facts.pick_by_seq(g, ["location_key"], ["location_key", "latitude", "longitude", "seq"])
        _write(locations, self.path("location"), key)
        _write(graph.day_nodes(g), self.path("day"), key)
        _write(graph.season_nodes(g), self.path("season"), key)
        incidents = facts.pick_by_seq(g, ["id"], ["id", "incident_type", "description", "seq"], last=True)
        _write(incidents.withColumnRenamed("id", "case_id"), self.path("incident"), key)
        _write(facts.pick_by_seq(g, ["hour"], ["hour", "part_of_day", "seq"], last=True), self.path("time_block"), key)
        if self.write_edges:
            _write(graph.edges_all(g), self.path("edges"), key)


class EdgeSink:
    """``foreachBatch`` for edges that the stream's own state has already made distinct."""

    def __init__(self, root: str, checkpoint: str):
        self.path = f"{root.rstrip('/')}/edges"
        self.token = run_token(checkpoint)

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        _write(batch_df, self.path, f"{self.token}_{batch_id:012d}")


# ---------------------------------------------------------------------------
# Readers (current state of each table)
# ---------------------------------------------------------------------------

def _first_facts(df: DataFrame) -> DataFrame:
    return facts.pick_by_seq(df, ["id"], [*FACT_COLUMNS, "seq"])


def _first_locations(df: DataFrame) -> DataFrame:
    return facts.pick_by_seq(df, ["location_key"], ["location_key", "latitude", "longitude", "seq"])


def _last_incidents(df: DataFrame) -> DataFrame:
    return facts.pick_by_seq(df, ["case_id"], ["case_id", "incident_type", "description", "seq"], last=True)


def _last_time_blocks(df: DataFrame) -> DataFrame:
    return facts.pick_by_seq(df, ["hour"], ["hour", "part_of_day", "seq"], last=True)


def _as_set(df: DataFrame) -> DataFrame:
    return df.drop(BATCH_COL).distinct()


#: How the batches of each table merge; merging twice gives the same rows.
MERGES = {"fact": _first_facts, "location": _first_locations, "incident": _last_incidents,
          "time_block": _last_time_blocks, "day": _as_set, "season": _as_set, "edges": _as_set, "quarantine": _as_set}


def read_merged(spark: SparkSession, root: str, table: str) -> DataFrame:
    return MERGES[table](spark.read.parquet(f"{root}/{table}"))


def read_fact(spark: SparkSession, root: str) -> DataFrame:
    return read_merged(spark, root, "fact")


def read_edges(spark: SparkSession, root: str) -> DataFrame:
    return read_merged(spark, root, "edges")


def read_locations(spark: SparkSession, root: str) -> DataFrame:
    """Location nodes: the first point per address over all batches."""
    return graph.as_location_nodes(read_merged(spark, root, "location"))


def read_incidents(spark: SparkSession, root: str) -> DataFrame:
    """Incident nodes: last row per case_id across batches."""
    return read_merged(spark, root, "incident").drop("seq")


def read_time_blocks(spark: SparkSession, root: str) -> DataFrame:
    return read_merged(spark, root, "time_block").drop("seq")


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Bad records, each once however often it was read."""
    return read_merged(spark, root, "quarantine")


def compact(spark: SparkSession, root: str, table: str, name: str) -> None:
    """Fold all batches of a table, as stored now, into the batch ``name``; then delete them.

    Readers merge, so they see the same rows before, between and after the two steps, and a batch
    that its stream writes again later does no harm.
    """
    path = f"{root}/{table}"
    stored = spark.read.parquet(path)
    old = [r[0] for r in stored.select(BATCH_COL).distinct().collect()]  # one row per batch
    if name in old:
        raise ValueError(f"batch {name} is stored already")
    _write(MERGES[table](stored), path, name)
    for key in old:
        remove_path(spark, f"{path}/{BATCH_COL}={key}")
