"""Pattern edges: one window per incident, stored per type, questions asked of them against plain counting."""

from collections import Counter
from datetime import datetime

import pytest

from gridwatch.operators import clean, patterns, predict
from gridwatch.operators.graph import graph_input
from gridwatch.sources import standin, tables

SCHEMA = ("id string, incident_type string, offense_date timestamp_ntz, offense_hour int, offense_day_of_week string, "
          "latitude double, longitude double")


def facts(spark, rows):
    return spark.createDataFrame([(i, t, datetime(2024, 1, 5), h, d, la, lo) for i, t, h, d, la, lo in rows], SCHEMA)


ROWS = ([(f"a{i}", "theft", 23, "Friday", 29.65, -82.33) for i in range(6)]
        + [(f"b{i}", "theft", 13, "Monday", 29.65, -82.33) for i in range(6)]
        + [(f"c{i}", "arson", 9, "Monday", 29.70, -82.40) for i in range(3)]
        + [("d0", "theft", 9, "Sunday", 29.70, -82.40), ("e0", None, None, None, None, None), ("e1", None, 2, "Friday", 29.70, -82.40)])
PAIRS = [("a0", "a1", 0.0), ("a0", "b0", 12.5)]


@pytest.fixture
def graph(spark):
    f = facts(spark, ROWS)
    cells = predict.with_cells(f, 0.0025)
    near = spark.createDataFrame(PAIRS, "id_a string, id_b string, distance_m double")
    return f, cells, patterns.pattern_edges(f, near, predict.grid_type_risk(cells, 0.5))


def window(row):
    hour = row[2] or 0
    part = "morning" if 5 <= hour < 12 else "afternoon" if 12 <= hour < 17 else "evening" if 17 <= hour < 21 else "night"
    return f"{row[3] or 'Unknown'}/{part}"


def test_edges(graph):
    _, _, edges = graph
    got = [tuple(r) for r in edges.collect()]
    assert sorted(r[1:3] for r in got if r[0] == "DURING") == sorted((r[0], window(r)) for r in ROWS)
    assert sorted(r[1:] for r in got if r[0] == "NEAR") == sorted(PAIRS)
    high = {(r[2]): r[3] for r in got if r[0] == "HIGH_RISK_FOR"}
    assert high == {"theft": 1.0, "arson": 1.0}
    labels = Counter(r.label for r in patterns.pattern_nodes(edges).collect())
    assert labels == {"TimeWindow": len({window(r) for r in ROWS}), "Grid": 2, "IncidentType": 2}


def test_window_lift(graph):
    f, _, edges = graph
    got = {(r.incident_type, r.time_window): (r.incidents, r.expected, r.lift)
           for r in patterns.window_lift(edges, f.select("id", "incident_type")).collect()}
    both, types, windows = Counter((r[1], window(r)) for r in ROWS), Counter(r[1] for r in ROWS), Counter(map(window, ROWS))
    assert set(got) == set(both)
    for (t, w), n in both.items():
        expected = types[t] * windows[w] / len(ROWS)
        assert got[t, w] == (n, pytest.approx(expected), pytest.approx(n / expected))


def test_high_risk_windows_break_ties_by_name(graph):
    _, cells, edges = graph
    got = {r.incident_type: (r.time_window, r.in_window, r.incidents, r.share) for r in patterns.high_risk_windows(edges, cells).collect()}
    assert got == {"theft": ("Friday/night", 6, 12, 0.5), "arson": ("Monday/morning", 3, 3, 1.0)}


def test_empty(spark):
    f = facts(spark, [])
    cells = predict.with_cells(f, 0.0025)
    edges = patterns.pattern_edges(f, spark.createDataFrame([], "id_a string, id_b string, distance_m double"), predict.grid_type_risk(cells, 0.5))
    assert not edges.collect() and not patterns.pattern_nodes(edges).collect()
    assert not patterns.window_lift(edges, f.select("id", "incident_type")).collect()
    assert not patterns.high_risk_windows(edges, cells).collect()


def test_one_type_reads_its_partition_and_belongs_to_the_generation(spark, graph, scratch):
    _, _, edges = graph
    t = clean.type_incidents(standin.incident_payloads(spark, "/root/testdata/sf0.001"))
    tables.refresh_graph(graph_input(t), t, scratch, pattern_edges=edges)
    stored = tables.read_patterns(spark, tables.current_graph(spark, scratch))
    assert sorted(map(str, stored.collect())) == sorted(map(str, edges.collect()))
    near = stored.filter("edge_type = 'NEAR'")
    assert "PartitionFilters: [isnotnull(edge_type" in near._jdf.queryExecution().executedPlan().toString() and near.count() == 2


def test_stored_edges_are_not_sorted_by_type(spark, scratch, monkeypatch):
    """Only edges of unknown types go through the writer of several partitions, which sorts its rows; all are stored, old ones go."""
    from pyspark.sql.readwriter import DataFrameWriter

    from gridwatch.sources import tables

    sorted_rows, plain = [], DataFrameWriter.partitionBy

    def partition_by(writer, *columns):
        sorted_rows.append(writer._df._jdf.queryExecution().optimizedPlan().toString())
        return plain(writer, *columns)

    monkeypatch.setattr(DataFrameWriter, "partitionBy", partition_by)
    day = [datetime(2024, 1, 5, h) for h in (10, 11)]
    fact = spark.createDataFrame([(f"i{n}", d, 10, "Friday") for n, d in enumerate(day)],
                                 "id string, offense_date timestamp_ntz, offense_hour int, offense_day_of_week string")
    near = spark.createDataFrame([("i0", "i1", 12.5)], "id_a string, id_b string, distance_m double")
    high = spark.createDataFrame([("1:2", "theft", 0.75)], "grid_id string, incident_type string, risk_score double")
    read = lambda: sorted(tuple(str(v) for v in r) for r in tables.read_patterns(spark, scratch).collect())
    edges = patterns.pattern_edges(fact, near, high)
    odd = spark.createDataFrame([("ODD", "a", "b", 1.0), (None, "c", "d", None)], "edge_type string, src string, dst string, weight double")
    tables.write_patterns(edges.unionByName(odd), scratch)
    assert len(read()) == 6 and ("ODD", "a", "b", "1.0") in read() and ("None", "c", "d", "None") in read()
    tables.write_patterns(edges, scratch)
    assert read() == sorted(tuple(str(v) for v in r) for r in edges.collect()) and len(read()) == 4
    assert sorted_rows[-1].startswith("LocalRelation <empty>")
