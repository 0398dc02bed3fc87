"""Day / night risk per location, per-part counts and the lookup by hour.

The reference scores a Location by counting graph paths
``Location <- Incident -> TimeBlock`` whose TimeBlock falls in a band.  Paths
run over distinct edges, so an incident counts once per (address, hour) pair
it is linked to: an id replayed with another address or hour is counted at
each (reference behaviour, kept; ``incidents`` gives the distinct count).

TimeBlock's part of day is a pure function of its key (the hour), so the
TimeBlock hop resolves to that expression and needs no join.  The plan is:
distinct (case, hour) edges -> band hours per case (partial count distinct,
pre-aggregated before the shuffle) -> join the distinct (case, address) edges
on case -> sum per address.  Hot addresses and hot ids are absorbed by the
partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.functions import calendar as cal
from gridwatch.operators.graph import location_nodes, occurred_at

BANDS = {"night": cal.NIGHT_PARTS, "day": cal.DAY_PARTS}


def band_of_part(part) -> F.Column:
    return (F.when(part.isin(*cal.NIGHT_PARTS), "night")
            .when(part.isin(*cal.DAY_PARTS), "day"))


def risk_scores(g: DataFrame) -> DataFrame:
    """(address, band, risk_score, incidents) for bands night and day."""
    per_case = (g.select(F.col("id").alias("case_id"), "hour",
                         band_of_part(F.col("part_of_day")).alias("band"))
                .filter(F.col("band").isNotNull())
                .groupBy("case_id", "band")
                .agg(F.count_distinct("hour").alias("paths")))
    at = occurred_at(g)
    return (at.join(per_case, "case_id")
            .groupBy("address", "band")
            .agg(F.sum("paths").alias("risk_score"), F.count(F.lit(1)).alias("incidents")))


def risk_band(g: DataFrame, band: str) -> DataFrame:
    """(address, risk_score, incidents) for one band; unmatched addresses get no row."""
    return risk_scores(g).filter(F.col("band") == band).select("address", "risk_score", "incidents")


def risk_by_part(g: DataFrame) -> DataFrame:
    """Path count per (address, part_of_day), all parts, only positive counts."""
    per_case = (g.select(F.col("id").alias("case_id"), "hour", "part_of_day")
                .groupBy("case_id", "part_of_day")
                .agg(F.count_distinct("hour").alias("paths")))
    return (occurred_at(g).join(per_case, "case_id")
            .groupBy("address", "part_of_day")
            .agg(F.sum("paths").alias("incident_count"))
            .filter(F.col("incident_count") > 0))


def risk_at_hour(g: DataFrame, hour: int) -> DataFrame:
    """Risk locations for a requested hour: (address, lat, lon, risk).

    The hour picks its band; an evening hour has no band, so no rows.
    """
    # The requested hour goes through the same part-of-day rule (constant-folded
    # by Catalyst); an evening hour yields a NULL band, which matches nothing.
    band = band_of_part(cal.part_of_day(F.lit(hour)))
    scores = risk_scores(g).filter(F.col("band") == band)
    return (scores.join(location_nodes(g), "address")
            .select("address", "lat", "lon", F.col("risk_score").alias("risk")))


def risk_labels(g: DataFrame, hour: int) -> DataFrame:
    """Lookup rows with the UI's colour and 12-hour label."""
    return risk_at_hour(g, hour).select(
        "address", "risk",
        cal.risk_colour(F.col("risk")).alias("colour"),
        cal.hour_label(F.lit(hour)).alias("time_label"),
    )


def risk_from_graph(edges: DataFrame, time_blocks: DataFrame) -> DataFrame:
    """(address, band, risk_score, incidents) recomputed from a stored graph.

    Reads the stored edge set and TimeBlock nodes (as the streaming sink keeps
    them), so the scores can be refreshed as an overwrite job after new batches.
    The TimeBlock side holds one row per hour value; AQE broadcasts it.
    """
    at = edges.filter(F.col("edge_type") == "OCCURRED_AT") \
        .select(F.col("src").alias("case_id"), F.col("dst").alias("address"))
    during = edges.filter(F.col("edge_type") == "OCCURRED_DURING") \
        .select(F.col("src").alias("case_id"), F.col("dst").cast("int").alias("hour"))
    per_case = (during.join(time_blocks, "hour")
                .withColumn("band", band_of_part(F.col("part_of_day")))
                .filter(F.col("band").isNotNull())
                .groupBy("case_id", "band").agg(F.count(F.lit(1)).alias("paths")))
    return (at.join(per_case, "case_id").groupBy("address", "band")
            .agg(F.sum("paths").alias("risk_score"), F.count(F.lit(1)).alias("incidents")))
