"""Batch writers and readers for the stored products (fact table, graph tables).

* The fact table is written with its declared schema (column order and types
  enforced by casting to ``FACT``) and partitioned by offense day, so a date
  lookup reads one directory and a bounding box uses row-group statistics.
* The graph is one Parquet table per node label and per edge type.
  ``mode="overwrite"`` is the full refresh (wipe then reload) of a batch load, table by table;
  ``refresh_graph`` writes a new generation and switches readers to it in one step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.operators import graph, patterns
from gridwatch.operators.facts import pick_by_seq
from gridwatch.schema import FACT
from gridwatch.session import remove_path

DAY_COL = "offense_day"


def conform(df: DataFrame, schema=FACT) -> DataFrame:
    """Select and cast to a declared schema (missing columns fail loudly)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_fact(fact: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the fact table, partitioned by offense day (NULL dates in their own partition).

    Rows are rebalanced by day: few files per day, and AQE splits a day that is larger than
    the advisory partition size over several tasks and files.
    """
    out = conform(fact).withColumn(DAY_COL, F.to_date("offense_date"))
    (out.hint("rebalance", F.col(DAY_COL)).sortWithinPartitions(DAY_COL, "latitude", "longitude")
     .write.mode(mode).partitionBy(DAY_COL).parquet(path))


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def facts_on(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Incidents of one calendar day with coordinates; prunes to one partition."""
    return (read_fact(spark, path).filter(F.col(DAY_COL) == F.lit(day).cast("date"))
            .select("id", "incident_type", "offense_date", "latitude", "longitude", "address"))


def facts_in_bbox(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Incidents inside a bounding box: plain range predicates, pushed to the Parquet scan.

    Files are sorted by coordinates within each day, so row-group min/max
    statistics let the reader skip most groups.
    """
    s, w, n, e = bbox
    return (read_fact(spark, path)
            .filter(F.col("latitude").between(s, n) & F.col("longitude").between(w, e))
            .select("id", "incident_type", "offense_date", "latitude", "longitude"))


def upsert_places(places: DataFrame, root: str, load: str) -> None:
    """Store one load of Place nodes; loads are merged on read, the later name winning.

    Writing a load again replaces it.
    """
    places.write.mode("overwrite").parquet(f"{root.rstrip('/')}/place/load={load}")


def read_places(spark: SparkSession, root: str) -> DataFrame:
    """Place nodes: per (type, id) the last element of the last load that has it."""
    stored = spark.read.option("recursiveFileLookup", "false").parquet(f"{root.rstrip('/')}/place")
    stored = stored.withColumn("_order", F.struct(F.col("load").cast("string"), "seq"))
    columns = [c for c in stored.columns if c not in ("load", "_order")]
    return pick_by_seq(stored, ["osm_type", "osm_id"], columns, last=True, seq="_order")


def write_near(near: DataFrame, root: str) -> None:
    """Full refresh of the stored OCCURRED_NEAR edges (case_id, osm_type, osm_id, distance_m)."""
    near.write.mode("overwrite").parquet(f"{root.rstrip('/')}/occurred_near")


def read_all_edges(spark: SparkSession, root: str) -> DataFrame:
    """The stored incident edges and OCCURRED_NEAR edges as one (edge_type, src, dst) table."""
    edges = spark.read.parquet(f"{root.rstrip('/')}/edges").select("edge_type", "src", "dst")
    return edges.unionByName(graph.near_edges(spark.read.parquet(f"{root.rstrip('/')}/occurred_near")))


def write_patterns(edges: DataFrame, root: str) -> None:
    """Full refresh of the stored pattern edges (``patterns.pattern_edges``), a partition per edge type.

    The known types are written one by one: a writer of several partitions sorts its rows first, and NEAR edges are
    far more than fit in memory.  Edges of any other type go through that writer.
    """
    path, kind = f"{root.rstrip('/')}/patterns", F.col("edge_type")
    others = edges.filter(kind.isNull() | ~kind.isin(*patterns.KINDS))
    others.write.mode("overwrite").partitionBy("edge_type").parquet(path)
    for name in patterns.KINDS:
        edges.filter(kind == name).drop("edge_type").write.mode("overwrite").parquet(f"{path}/edge_type={name}")


def read_patterns(spark: SparkSession, root: str) -> DataFrame:
    """The stored pattern edges (edge_type, src, dst, weight); a filter on the type prunes to its files."""
    return spark.read.parquet(f"{root.rstrip('/')}/patterns").select(*patterns.COLUMNS)


def read_knowledge_edges(spark: SparkSession, root: str) -> DataFrame:
    """Incident edges, OCCURRED_NEAR and pattern edges as one (edge_type, src, dst) table."""
    return read_all_edges(spark, root).unionByName(read_patterns(spark, root).drop("weight"))


def write_risk(scores: DataFrame, root: str) -> None:
    """Full refresh of the stored risk table (address, band, risk_score, incidents): old scores go."""
    scores.write.mode("overwrite").parquet(f"{root.rstrip('/')}/risk")


def graph_tables(g: DataFrame) -> dict[str, DataFrame]:
    """All node and edge tables of the incident graph."""
    return {
        "location": graph.location_nodes(g),
        "time_block": graph.time_block_nodes(g),
        "day": graph.day_nodes(g),
        "season": graph.season_nodes(g),
        "edges": graph.edges_all(g),
    }


def write_graph(g: DataFrame, typed: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Batch graph load: every node and edge table under ``root``.

    ``g`` is expensive to recompute for each table, so it is checkpointed into
    the shared checkpoint folder first (reliable: survives executor loss).
    """
    from gridwatch.session import cut_lineage

    g = cut_lineage(g)
    for name, df in graph_tables(g).items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")
    graph.incident_nodes(typed).write.mode(mode).parquet(f"{root.rstrip('/')}/incident")


# ---------------------------------------------------------------------------
# Generations: a refresh that readers see as a whole
# ---------------------------------------------------------------------------

def refresh_graph(g: DataFrame, typed: DataFrame, root: str, near: DataFrame | None = None,
                  pattern_edges: DataFrame | None = None) -> str:
    """Write every graph table to a new generation below ``root``, then point to it; returns the generation's folder.

    Readers resolve the pointer once and keep reading that generation.  A refresh that fails before the pointer is
    written leaves the old graph as it was; its folder is dropped by the next ``drop_old_generations``.
    """
    spark, root = g.sparkSession, root.rstrip("/")
    number = max((n for n, _ in _pointers(spark, root)), default=-1) + 1
    folder = f"{root}/generations/{number:012d}_{uuid.uuid4().hex[:8]}"
    write_graph(g, typed, folder)
    if near is not None:
        write_near(near, folder)
    if pattern_edges is not None:
        write_patterns(pattern_edges, folder)
    # The pointer is a committed write of one line: it counts only with its success mark.
    spark.createDataFrame([(folder,)], "value string").coalesce(1).write.text(f"{root}/pointers/{number:012d}")
    return folder


def current_graph(spark: SparkSession, root: str) -> str:
    """The folder of the newest complete generation; resolve it once for all tables of a query."""
    pointers = _pointers(spark, root.rstrip("/"))
    if not pointers:
        raise FileNotFoundError(f"no graph below {root}")
    return spark.read.text(max(pointers)[1]).head().value


def drop_old_generations(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` generations, and those that no pointer names."""
    root = root.rstrip("/")
    pointers = sorted(_pointers(spark, root))
    kept = {spark.read.text(path).head().value.rsplit("/", 1)[1] for _, path in pointers[-keep:]}
    for _, path in pointers[:-keep]:
        remove_path(spark, path)
    for path in _children(spark, f"{root}/generations"):
        if path.rsplit("/", 1)[1] not in kept:
            remove_path(spark, path)


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f"{path}/{s.getPath().getName()}" for s in files.listStatus(at)] if files.exists(at) else []


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the pointers whose write was committed."""
    return [(int(p.rsplit("/", 1)[1]), p) for p in _children(spark, f"{root}/pointers")
            if any(c.endswith("/_SUCCESS") for c in _children(spark, p))]
