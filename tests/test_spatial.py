"""Cell joins against brute force (pure Python) on small fixtures."""

import math
import random

from gridwatch.functions.geo import EARTH_RADIUS_M
from gridwatch.operators import proximity, spatial
from pyspark.sql import functions as F


def hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, a)))


def _cell(lat, lon, radius):
    """The home cube cell the join assigns to a point (same rule as the library)."""
    size = 2 * (radius / EARTH_RADIUS_M * spatial.MARGIN)
    p, l_ = math.radians(lat), math.radians(lon)
    xyz = (math.cos(p) * math.cos(l_), math.cos(p) * math.sin(l_), math.sin(p))
    return tuple(math.floor(v / size) for v in xyz)


def north_of(lat, lon, metres):
    return lat + math.degrees(metres / EARTH_RADIUS_M), lon


def test_distance_edges_strict(spark):
    lat0, lon0 = 29.65, -82.32
    probes = [(1, lat0, lon0)]
    builds = []
    for i, d in enumerate([199.9, 200.0, 200.1], start=10):
        la, lo = north_of(lat0, lon0, d)
        builds.append((i, la, lo))
    p = spark.createDataFrame(probes, "pid int, lat double, lon double")
    b = spark.createDataFrame(builds, "bid int, lat double, lon double")
    got = {r.b_bid for r in spatial.proximity_join(p, b, 200.0, ["pid"], ["bid"]).collect()}
    want = {bid for bid, la, lo in builds if hav(lat0, lon0, la, lo) < 200.0}
    assert 10 in got and 12 not in got
    assert got == want


def _points(n, seed, lat_c, lon_c, spread):
    rnd = random.Random(seed)
    return [(i, lat_c + rnd.uniform(-spread, spread), lon_c + rnd.uniform(-spread, spread)) for i in range(n)]


def test_cell_join_matches_brute_force_everywhere(spark):
    # Dense clusters at mid latitude, across the antimeridian and near a pole.
    for seed, (lat_c, lon_c) in enumerate([(29.65, -82.32), (0.0, 179.999), (89.99, 10.0), (-45.0, -179.999)]):
        pts = _points(300, seed, lat_c, lon_c, 0.01)
        pl = _points(120, seed + 100, lat_c, lon_c, 0.01)
        p = spark.createDataFrame(pl, "pid int, lat double, lon double")
        b = spark.createDataFrame(pts, "bid int, lat double, lon double")
        rows = spatial.proximity_join(p, b, 250.0, ["pid"], ["bid"]).collect()
        got = [(r.p_pid, r.b_bid) for r in rows]
        assert len(got) == len(set(got)), "a pair was met twice"
        want = {(i, j) for i, la, lo in pl for j, lb, lob in pts if hav(la, lo, lb, lob) < 250.0}
        assert set(got) == want, (lat_c, lon_c)
        # The fixture must exercise cell borders: some true pairs sit in different cells.
        cell = {("p", i): _cell(la, lo, 250.0) for i, la, lo in pl}
        cell.update({("b", j): _cell(la, lo, 250.0) for j, la, lo in pts})
        assert any(cell[("p", i)] != cell[("b", j)] for i, j in want)


def test_self_join_with_time_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(f"id{i:04d}", 29.65 + rnd.uniform(-0.01, 0.01), -82.32 + rnd.uniform(-0.01, 0.01),
             rnd.randrange(0, 30 * 86400) * 1_000_000) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double, t long")
    week = 7 * 86400 * 1_000_000
    out = spatial.self_proximity_join(df, "id", 500.0, extra=[("t", float(week))]).collect()
    got = [(r.a_id, r.b_id) for r in out]
    assert len(got) == len(set(got))
    want = {(a[0], b[0]) for a in rows for b in rows
            if a[0] < b[0] and abs(a[3] - b[3]) <= week and hav(a[1], a[2], b[1], b[2]) < 500.0}
    assert set(got) == want


def test_hot_cell_all_pairs_kept(spark):
    # One spot holds every row: the result is all pairs, none dropped.
    rows = [(f"h{i:03d}", 29.65, -82.32, 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double, t long")
    out = spatial.self_proximity_join(df, "id", 500.0, extra=[("t", 1.0)])
    assert out.count() == 120 * 119 // 2


def test_within_radius_leaves_the_join_to_the_measured_size(spark):
    pts = spark.createDataFrame([(1, 29.65, -82.32)], "point_id int, lat double, lon double")
    fact = spark.createDataFrame([("a", 29.651, -82.32), ("b", 29.70, -82.32)],
                                 "id string, latitude double, longitude double")
    df = proximity.within_radius(pts, fact, 1000.0)
    assert [r.id for r in df.collect()] == ["a"]
    assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_copies_out_of_reach_are_left_out(spark):
    """Of the eight cells around a point only those that may hold a partner on the sphere get a copy."""
    pts = spark.range(4000).selectExpr("29.6 + rand(3) * 0.1 AS lat", "-82.3 + rand(4) * 0.1 AS lon", "id")
    dims = spatial._axes(F.col("lat"), F.col("lon"), 200.0, [])
    copies = spatial._cell_keys(pts, dims, probe=True, self_join=False).count() / 4000
    assert 1 < copies < 6, copies


def _generated(df):
    """Sizes of the largest generated method of each stage of a plan."""
    import re

    spark = df.sparkSession
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_no_generated_method_is_too_large_to_be_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes: the copying of probes was one of 38,050."""
    df = spark.createDataFrame([("a", 29.65, -82.32, 0, 1), ("b", 29.65, -82.32, 0, 2)], "id string, lat double, lon double, t long, n int")
    for out in (spatial.self_proximity_join(df, "id", 500.0, extra=[("t", 1.0)], carry=["n"]),
                spatial.proximity_join(df, df, 500.0, ["id"], ["id"], extra=[("t", 1.0)], large=True)):
        sizes = _generated(out)
        assert sizes and max(sizes) < 8000, sizes
    assert [tuple(r) for r in spatial.self_proximity_join(df, "id", 500.0, extra=[("t", 1.0)], carry=["n"]).select("a_id", "a_n", "b_id", "b_n").collect()] \
        == [("a", 1, "b", 2)]


def test_round_mm_equals_round(spark):
    from gridwatch.functions.geo import round_mm

    rnd = random.Random(3)
    values = [rnd.uniform(0, 500) for _ in range(3000)] + [n / 8000 for n in range(4000)] + [k / 1000 + 0.0005 for k in range(4000)]
    values += [math.nextafter(k / 1000 + 0.0005, d) for k in range(0, 500_000, 331) for d in (0, 1e9)] + [rnd.uniform(0, 2e7) for _ in range(3000)] + [None, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert df.filter(~round_mm(F.col("d")).eqNullSafe(F.round("d", 3))).count() == 0


def test_chord_decides_like_the_distance(spark):
    """Pairs at the radius, a hair inside and outside, at all radii and places."""
    for lat, radius in ((0.0, 0.001), (29.65, 0.5), (-60.0, 500.0), (89.9, 200.0), (10.0, 2e6)):
        steps = [0.0, 0.5, 1 - 1e-5, 1 - 1e-7, 1 - 1e-9, 1 - 1e-13, 1.0, 1 + 1e-13, 1 + 1e-9, 1 + 1e-7, 1 + 1e-5, 1.5]
        rows = [(n, *north_of(lat, 179.9999, -math.copysign(1, lat) * radius * s)) for n, s in enumerate(steps)]
        p = spark.createDataFrame([(1, lat, 179.9999)], "pid int, lat double, lon double")
        b = spark.createDataFrame(rows, "bid int, lat double, lon double")
        got = {r.b_bid for r in spatial.proximity_join(p, b, radius, ["pid"], ["bid"]).collect()}
        assert got == {n for n, la, lo in rows if hav(lat, 179.9999, la, lo) < radius}, (lat, radius)
