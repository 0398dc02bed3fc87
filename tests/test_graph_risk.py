"""Graph MERGE semantics and risk scores on hand-made vectors."""

from pyspark.sql import functions as F

from gridwatch.operators import clean, facts, graph, risk
from gridwatch.schema import RAW_INCIDENT

FIELDS = [f.name for f in RAW_INCIDENT.fields]


def raw_rows(spark, rows):
    df = spark.createDataFrame(rows, "seq long, id string, narrative string, offense_date string, "
                                     "offense_hour_of_day string, address string, latitude string, longitude string")
    for name in FIELDS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def test_replayed_id(spark):
    raw = raw_rows(spark, [
        (1, "A", "Theft", "2024-01-01 23:00:00", "23", "Main St", "29.6", "-82.3"),
        (2, "A", "Assault", "2024-01-01 10:00:00", "10", "Oak St", "29.7", "-82.4"),
    ])
    typed = clean.type_incidents(raw)
    fact = facts.fact_first_wins(typed).collect()
    assert [(r.id, r.incident_type, r.address) for r in fact] == [("A", "Theft", "Main St")]
    node = facts.incident_last_wins(typed).collect()
    assert [(r.case_id, r.incident_type) for r in node] == [("A", "Assault")]
    g = graph.graph_input(typed)
    at = sorted((r.case_id, r.address) for r in graph.occurred_at(g).collect())
    assert at == [("A", "Main St"), ("A", "Oak St")]
    # Paths: both addresses reach both hours of A -> each address gets one night path.
    night = {r.address: (r.risk_score, r.incidents) for r in risk.risk_band(g, "night").collect()}
    assert night == {"Main St": (1, 1), "Oak St": (1, 1)}
    day = {r.address: r.risk_score for r in risk.risk_band(g, "day").collect()}
    assert day == {"Main St": 1, "Oak St": 1}


def test_first_null_point_stays_null(spark):
    raw = raw_rows(spark, [
        (1, "A", "Theft", "2024-01-01 23:00:00", "23", "Main St", None, "-82.3"),
        (2, "B", "Theft", "2024-01-02 23:00:00", "23", "Main St", "29.6", "-82.3"),
    ])
    loc = graph.location_nodes(graph.graph_input(clean.type_incidents(raw))).collect()
    assert [(r.address, r.lat, r.lon, r.type) for r in loc] == [("Main St", None, -82.3, "street")]


def test_evening_only_in_no_band(spark):
    raw = raw_rows(spark, [(i, f"E{i}", "Theft", "2024-01-01 18:00:00", str(h), "Pub Row", "29.6", "-82.3")
                           for i, h in enumerate([17, 18, 19, 20])])
    g = graph.graph_input(clean.type_incidents(raw))
    assert risk.risk_scores(g).count() == 0
    assert risk.risk_at_hour(g, 18).count() == 0
    parts = {r.part_of_day: r.incident_count for r in risk.risk_by_part(g).collect()}
    assert parts == {"evening": 4}


def test_missing_hour_reads_as_night_and_is_flagged(spark):
    raw = raw_rows(spark, [(1, "A", "Theft", "2024-01-01 15:00:00", None, "Main St", "29.6", "-82.3")])
    g = graph.graph_input(clean.type_incidents(raw)).collect()[0]
    assert (g.hour, g.hour_imputed, g.part_of_day) == (0, True, "night")


def test_keyless_rows_dropped_from_graph(spark):
    raw = raw_rows(spark, [(1, None, "Theft", None, "1", None, None, None),
                           (2, "", "Theft", None, "1", None, None, None),
                           (3, "C", "Theft", None, "1", None, None, None)])
    g = graph.graph_input(clean.type_incidents(raw)).collect()
    assert [(r.id, r.location_key, r.day_name, r.season) for r in g] == [("C", "Unknown Location", "Unknown", "Winter")]


def test_graph_stats_counts(spark):
    raw = raw_rows(spark, [
        (1, "A", "Theft", "2024-01-01 23:00:00", "23", "Main St", "29.6", "-82.3"),
        (2, "A", "Theft", "2024-01-01 23:00:00", "23", "Main St", "29.6", "-82.3"),
        (3, "B", "Theft", "2024-07-01 10:00:00", "10", "Oak St", "29.6", "-82.3"),
    ])
    raw = raw.withColumn("offense_day_of_week", F.lit("Monday"))
    stats = {(r.kind, r.item): r.n for r in graph.graph_stats(graph.graph_input(clean.type_incidents(raw))).collect()}
    assert stats[("node", "Incident")] == 2
    assert stats[("node", "Location")] == 2
    assert stats[("node", "TimeBlock")] == 2
    assert stats[("node", "Season")] == 2
    assert stats[("edge", "OCCURRED_AT")] == 2
    assert stats[("edge", "ON_DAY")] == 2
