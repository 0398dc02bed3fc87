"""Incident-place edges and their counts from the two halves of the paths, against plain loops; large joins are not broadcast."""

import math
import random

from gridwatch.functions.geo import haversine_m
from gridwatch.operators import clean, graph, proximity
from pyspark.sql import functions as F

RAW = "seq long, id string, narrative string, report_date string, offense_date string, offense_hour_of_day string, offense_day_of_week string, address string, latitude string, longitude string, city string, state string"


def _inputs(spark):
    rnd = random.Random(7)
    spots = {f"A{i}": (round(29.6 + rnd.random() * 0.02, 5), round(-82.3 + rnd.random() * 0.02, 5)) for i in range(30)}
    spots["A0"] = (None, None)
    at = {}
    for i in range(120):  # one address, two or five; some far apart, some not
        at[f"i{i}"] = rnd.sample(sorted(spots), 1 if i % 3 else rnd.choice((2, 2, 5)))
    # two addresses whose circles overlap
    spots["N1"], spots["N2"] = (29.605, -82.295), (29.606, -82.295)
    at["pair"] = ["N1", "N2"]
    rows, seq = [], 0
    for i, addresses in at.items():
        for a in addresses:
            lat, lon = spots[a]
            rows.append((seq, i, "t", None, "2024-01-05 10:00:00", "10", "Friday", a, lat and str(lat), lon and str(lon), None, None))
            seq += 1
    g = graph.graph_input(clean.type_incidents(spark.createDataFrame(rows, RAW)))
    kinds = ["bar", "bank", "cafe", "bicycle_parking"]
    places = [("node" if n % 2 else "way", n, kinds[n % 4], 29.6 + rnd.random() * 0.02, -82.3 + rnd.random() * 0.02) for n in range(150)]
    places.append(("node", 999, "bar", 29.6055, -82.295))
    return g, spots, at, spark.createDataFrame(places, "osm_type string, osm_id long, amenity_type string, lat double, lon double")


def test_edges_and_counts_from_halves(spark):
    g, spots, at, places = _inputs(spark)
    points = spark.createDataFrame([(a, *p) for a, p in spots.items()], "address string, la double, lo double")
    near = {}
    for r in points.crossJoin(places).withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))).filter("d < 200").collect():
        near.setdefault(r.address, {})[(r.osm_type, r.osm_id)] = (r.amenity_type, r.d)
    want, kinds, cells = {}, {}, {}
    for i, addresses in at.items():
        for a in addresses:
            for place, (kind, d) in near.get(a, {}).items():
                want[(i, *place)] = min(d, want.get((i, *place), d))
                kinds.setdefault(kind, set()).add((i, place))
                cell = f"{math.floor(spots[a][0] / 0.0025)}:{math.floor(spots[a][1] / 0.0025)}"
                cells.setdefault((cell, kind if kind in proximity.AMENITY_KINDS else "other"), set()).add(i)
    assert any(k[0] == "pair" and k[2] == 999 for k in want)

    got = [tuple(r) for r in proximity.occurred_near(g, places, 200.0).collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == {k: round(d, 3) for k, d in want.items()}
    paths = proximity.occurred_near_paths(g, places, 200.0)
    assert {r.case_id for r in proximity.near_case_ids(paths).collect()} == {k[0] for k in want}
    assert proximity.near_edge_count(paths).head().n == len(want)
    assert {r.amenity_type: (r.incidents, r.edges) for r in proximity.amenity_exposure(paths).collect()} == {
        k: (len({i for i, _ in e}), len(e)) for k, e in kinds.items()}
    pivot = {(r.grid_id, k): r[k] for r in proximity.cell_amenity_pivot(paths, 0.0025).collect() for k in (*proximity.AMENITY_KINDS, "other") if r[k]}
    assert pivot == {k: len(v) for k, v in cells.items()}


def test_no_places_no_edges(spark):
    g, _, _, places = _inputs(spark)
    paths = proximity.occurred_near_paths(g, places.limit(0), 200.0)
    assert proximity.near_edge_count(paths).head().n == 0
    assert proximity.amenity_exposure(paths).count() == proximity.cell_amenity_pivot(paths, 0.0025).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_of_one_address_are_not_shuffled_again(spark):
    """The expanded paths reach no aggregate but for links that may meet a place twice."""
    g, _, _, places = _inputs(spark)
    paths = proximity.occurred_near_paths(g, places, 200.0)
    assert "Aggregate" not in _plan(paths.joined(paths.links.filter("apart"))).split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" not in _plan(proximity.occurred_near(g, places, 200.0))


def test_near_pairs_are_not_broadcast(spark):
    """The planner's estimate of a side comes from compressed files: a broadcast of all incidents is too large for the driver."""
    fact = spark.createDataFrame([("a", 29.6, -82.3, "2024-01-05 10:00:00")], "id string, latitude double, longitude double, offense_date string")
    plan = _plan(proximity.near_incident_pairs(fact.withColumn("offense_date", F.col("offense_date").cast("timestamp_ntz")), 500.0, 7))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_paths_leave_the_distance_join_unshuffled(spark):
    """Above the join on cells nothing is shuffled or joined again, chunks of one address lose no incident."""
    g, _, _, places = _inputs(spark)
    paths = proximity.occurred_near_paths(g, places, 200.0)
    top = _plan(paths.joined(paths.links)).split("SortMergeJoin")
    assert "Exchange" not in top[0] and "xxhash64" in top[1].split("\n")[0]
    links = spark.range(2500).selectExpr("concat('i', id) AS case_id", "'N1' AS address", "1 AS n_addresses", "true AS apart")
    here = paths.pairs.filter("address = 'N1'").count()
    got = [paths.joined(links, few).groupBy("case_id").count() for few in (False, True)]
    assert here and all((r.count() == 2500 and r.filter(f"count <> {here}").isEmpty()) for r in got)


def test_pairs_are_the_same_from_either_side(spark):
    g, _, _, places = _inputs(spark)
    locations = graph.location_nodes(g).select("address", "lat", "lon")
    a, b = (sorted(tuple(r) for r in proximity.point_place_pairs(locations, places, 200.0, side).collect()) for side in (True, False))
    assert a and a == b


def test_edges_of_varied_incidents_are_counted_once(spark):
    """Incidents whose rows are alike are counted by span; the others edge by edge, also when too many for a broadcast."""
    row = lambda s, i, a, h, d: (s, i, "t", None, "2024-01-05 10:00:00", h, d, a, "29.6", "-82.3", None, None)
    rows = [row(0, "x", "A", "1", "Friday"), row(1, "x", "A", "1", "Friday"), row(2, "y", "A", "1", "Friday"), row(3, "y", "B", "1", "Friday"),
            row(4, "y", "A", "2", "Friday"), row(5, "z", None, None, None)]
    g = graph.graph_input(clean.type_incidents(spark.createDataFrame(rows, RAW)))
    assert {r.case_id: (r.a, r.z, r.alike) for r in graph.case_spans(g).collect()} == {
        "x": ("A", None, True), "y": ("A", "B", False), "z": ("Unknown Location", None, True)}
    want = {"Location": 3, "Incident": 3, "TimeBlock": 3, "Day": 2, "Season": 1,
            "OCCURRED_AT": 4, "OCCURRED_DURING": 4, "ON_DAY": 3, "DURING_SEASON": 3}
    assert {r.item: r.n for r in graph.graph_stats(g).collect()} == want
    few, graph.FEW_ROWS = graph.FEW_ROWS, 0
    try:
        assert {r.item: r.n for r in graph.graph_stats(g).collect()} == want
    finally:
        graph.FEW_ROWS = few


def test_distances_are_rounded_before_incidents_are_listed(spark):
    """One rounding per address and place, not one per incident and place."""
    g, _, _, places = _inputs(spark)
    paths = proximity.occurred_near_paths(g, places, 200.0)
    above = _plan(paths.joined(paths.links)).split("Generate explode")[0]
    assert "round(" not in above.lower() and "floor(" not in above.lower()
