"""The property graph as node and edge DataFrames.

Labels: Location(address), Incident(case_id), TimeBlock(hour), Day(name),
Season(name), Place((type, osm_id)).  Edge types: OCCURRED_AT, OCCURRED_DURING,
ON_DAY, DURING_SEASON (incident side), OCCURRED_NEAR (incident -> place).
Every pattern the pipelines match is one or two hops, so plain joins on the
key columns replace a graph engine; a graph library is not needed.

``MERGE`` semantics map to aggregates: lookup-or-create of a node is a group
by its key; ``ON CREATE SET`` is first-wins (``min_by`` over ``seq``); ``SET``
is last-wins (``max_by``); an edge ``MERGE`` is a distinct over (src, dst).
All of these aggregate partially before the shuffle, so hot keys collapse
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.operators.clean import LOCATION_KIND, has_key, with_graph_columns
from gridwatch.operators.facts import incident_last_wins, pick_by_seq
from gridwatch.session import materialised

#: Rows that may be broadcast: counted, not estimated from the size of compressed files.
FEW_ROWS = 500_000


def graph_input(typed: DataFrame) -> DataFrame:
    """Keyed incidents with the derived graph columns (the graph sink's input)."""
    return with_graph_columns(has_key(typed))


def location_nodes(g: DataFrame) -> DataFrame:
    """Location per address with the first-seen point (a NULL first point stays NULL)."""
    return as_location_nodes(pick_by_seq(g, ["location_key"], ["location_key", "latitude", "longitude"]))


def as_location_nodes(first: DataFrame) -> DataFrame:
    """Location nodes from one (location_key, latitude, longitude) row per address."""
    return first.select(F.col("location_key").alias("address"),
                        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
                        F.lit(LOCATION_KIND).alias("type"))


def incident_nodes(typed: DataFrame) -> DataFrame:
    return incident_last_wins(typed)


def time_block_nodes(g: DataFrame) -> DataFrame:
    """TimeBlock per hour with its (last-set) part of day."""
    return g.groupBy("hour").agg(F.max_by("part_of_day", "seq").alias("part_of_day"))


def day_nodes(g: DataFrame) -> DataFrame:
    return g.select(F.col("day_name").alias("name")).distinct()


def season_nodes(g: DataFrame) -> DataFrame:
    return g.select(F.col("season").alias("name")).distinct()


def occurred_at(g: DataFrame) -> DataFrame:
    return g.select(F.col("id").alias("case_id"), F.col("location_key").alias("address")).distinct()


def case_spans(g: DataFrame) -> DataFrame:
    """(case_id, a, z, alike): first and last address of each incident (z NULL if it is the same); alike: all its rows have the same edges.

    Most incidents have one row.  Those that are alike have one edge of each type, so only the others' edges need be told apart.
    """
    row = F.struct("location_key", "hour", "day_name", "season")
    return (g.groupBy(F.col("id").alias("case_id")).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
            .select("case_id", F.col("lo.location_key").alias("a"), F.nullif(F.col("hi.location_key"), F.col("lo.location_key")).alias("z"),
                    (F.col("lo") == F.col("hi")).alias("alike")))


def occurred_during(g: DataFrame) -> DataFrame:
    return g.select(F.col("id").alias("case_id"), "hour").distinct()


def edge_triples(g: DataFrame) -> DataFrame:
    """(edge_type, src, dst) for all four incident edge types, one row each per incident row."""
    triples = F.array(
        F.struct(F.lit("OCCURRED_AT").alias("edge_type"), F.col("location_key").alias("dst")),
        F.struct(F.lit("OCCURRED_DURING").alias("edge_type"), F.col("hour").cast("string").alias("dst")),
        F.struct(F.lit("ON_DAY").alias("edge_type"), F.col("day_name").alias("dst")),
        F.struct(F.lit("DURING_SEASON").alias("edge_type"), F.col("season").alias("dst")),
    )
    return g.select(F.col("id").alias("src"), F.explode(triples).alias("e")) \
        .select("e.edge_type", "src", "e.dst")


def edges_all(g: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """The union of the typed edge sets as one (edge_type, src, dst) table, as a set.

    One scan and one shuffle for the four incident types instead of four distincts;
    ``near`` adds OCCURRED_NEAR edges, one row each already, with the Place key ``type/id``.
    """
    edges = edge_triples(g).distinct()
    return edges if near is None else edges.unionByName(near_edges(near))


def near_edges(near: DataFrame) -> DataFrame:
    """OCCURRED_NEAR rows (case_id, osm_type, osm_id) as (edge_type, src, dst)."""
    return near.select(F.lit("OCCURRED_NEAR").alias("edge_type"), F.col("case_id").alias("src"),
                       F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("dst"))


def graph_stats(g: DataFrame, places: DataFrame | None = None,
                near: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Node counts per label and edge counts per type: (kind, item, n).

    ``near``: one row (n) with the number of OCCURRED_NEAR edges (``proximity.near_edge_count``).
    ``spans``: ``case_spans(g)``, stored, if the caller has it.
    An incident whose rows are alike counts once for each of its edge types; only the rows of the others are
    listed edge by edge and de-duplicated, as are the few node keys.
    """
    spans = materialised(case_spans(g), "spans") if spans is None else spans
    none = F.lit(None).cast("string")
    hour = F.col("hour").cast("string")

    def item(kind: str, name: str, k1, k2):
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("item"),
                        k1.alias("k1"), k2.alias("k2"))

    def distinct_count(rows: DataFrame, items: list) -> DataFrame:
        return (rows.select(F.explode(F.array(*items)).alias("t")).select("t.*").distinct()
                .groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n")))

    edges = {"OCCURRED_AT": F.col("location_key"), "OCCURRED_DURING": hour, "ON_DAY": F.col("day_name"), "DURING_SEASON": F.col("season")}
    nodes = distinct_count(g, [
        item("node", "Location", F.col("location_key"), none),
        item("node", "TimeBlock", hour, none),
        item("node", "Day", F.col("day_name"), none),
        item("node", "Season", F.col("season"), none)])
    varied = rows_of(g, spans.filter("not alike").select("case_id"))
    counted = spans.agg(F.count(F.lit(1)).alias("cases"), F.count_if("alike").alias("alike"))
    of_cases = F.array(F.struct(F.lit("node").alias("kind"), F.lit("Incident").alias("item"), F.col("cases").alias("n")),
                       *(F.struct(F.lit("edge").alias("kind"), F.lit(t).alias("item"), F.col("alike").alias("n")) for t in edges))
    stats = (nodes.unionByName(counted.select(F.explode(of_cases).alias("t")).select("t.*"))
             .unionByName(distinct_count(varied, [item("edge", t, F.col("id"), k) for t, k in edges.items()]))
             .groupBy("kind", "item").agg(F.sum("n").alias("n")).filter("n > 0"))
    if places is not None:
        stats = stats.unionByName(places.agg(F.count(F.lit(1)).alias("n"))
                                  .select(F.lit("node").alias("kind"), F.lit("Place").alias("item"), "n"))
    if near is not None:
        stats = stats.unionByName(near.select(F.lit("edge").alias("kind"), F.lit("OCCURRED_NEAR").alias("item"), "n"))
    return stats


def rows_of(g: DataFrame, cases: DataFrame) -> DataFrame:
    """The rows of ``g`` of some incidents (case_id, one row each); ``cases`` is broadcast only if it is counted as small."""
    chosen = F.broadcast(cases) if cases.count() <= FEW_ROWS else cases.hint("merge")
    return g.join(chosen, F.col("id") == F.col("case_id"))
