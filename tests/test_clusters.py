"""Incident clusters against a plain density clustering; components against a union-find."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridwatch.functions.geo import EARTH_RADIUS_M
from gridwatch.operators import clusters
from gridwatch.operators.components import components

T0 = datetime(2024, 1, 10)
SCHEMA = "id string, latitude double, longitude double, offense_date timestamp_ntz"


def metres(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(rows, radius, days, least):
    rows = [r for r in rows if None not in r]
    near = {r[0]: [s[0] for s in rows if s[0] != r[0] and abs(r[3] - s[3]) <= timedelta(days=days) and metres(r, s) < radius] for r in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    root = roots(core, [(i, j) for i in core for j in near[i] if j in core])
    out = {(i, root[i], True) for i in core}
    return out | {(i, min(root[j] for j in near[i] if j in core), False) for i in near if i not in core and core & set(near[i])}


def found(spark, rows, radius, days, least):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in clusters.incident_clusters(df, radius, days, least).collect()]
    assert len(got) == len(set(got)) == len({g[0] for g in got})
    return set(got)


@pytest.mark.parametrize("lat,lon", [(29.65, -82.3), (0.0, 179.9995), (89.992, 10.0)])
def test_random_places(spark, lat, lon):
    rng = random.Random(5)
    spread = 0.004
    rows = []
    for i in range(350):
        y = min(90.0, lat + rng.uniform(-spread, spread))
        x = lon + rng.uniform(-spread, spread) * (9000 if lat > 80 else 1)
        x = (x + 180) % 360 - 180
        rows.append((f"c{i:04d}", y, x, T0 + timedelta(hours=rng.randint(0, 200))))
    rows += [("n1", None, lon, T0), ("n2", lat, None, T0), ("n3", lat, lon, None)]
    rows += [(f"h{i}", lat, lon, T0 + timedelta(hours=i % 3)) for i in range(40)]  # one address
    for radius, days, least in ((120.0, 2, 3), (90.0, 1, 2)):
        want = plain(rows, radius, days, least)
        assert {c for *_, c in want} == {True, False}
        assert found(spark, rows, radius, days, least) == want


def test_chain(spark):
    """1,000 incidents in a row, each NEAR only its neighbours: one cluster."""
    rows = [(f"c{(i * 389) % 1000:04d}", 29.0, -82.0 + i * 0.0008, T0) for i in range(1000)]
    got = found(spark, rows, 100.0, 1, 2)
    assert len(got) == 1000 and {g[1] for g in got} == {min(g[0] for g in got if g[2])}
    assert sum(not g[2] for g in got) == 2


def test_hot_cell_lists_no_pairs(spark):
    """20,000 incidents at one crossing and two cells beside it: links stay few."""
    rows = spark.range(20_000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), (F.lit(29.0) + F.col("id") % 7 * 1e-5).alias("latitude"),
        (F.lit(-82.0) + F.col("id") % 11 * 1e-5 + F.col("id") % 2 * 0.0016).alias("longitude"), F.lit(T0).cast("timestamp_ntz").alias("offense_date"))
    extra = spark.createDataFrame([("s1", 29.0, -82.0012, T0), ("s2", 29.0, -82.0, T0 + timedelta(days=9))], SCHEMA)
    got = {r.case_id: r for r in clusters.incident_clusters(rows.unionByName(extra), 200.0, 2, 5).collect()}
    assert len(got) == 20_001 and {r.cluster_id for r in got.values()} == {"c0"} and "s2" not in got


def test_empty(spark):
    assert found(spark, [], 100.0, 1, 2) == set()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, j) for j in range(5001, 5100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("lat,lon", [(29.65, -82.3), (0.0, 179.9995)])
def test_near_counts_without_pairs(spark, lat, lon):
    from gridwatch.operators import boxes

    rng = random.Random(9)
    rows = [(f"c{i:04d}", lat + rng.uniform(-0.01, 0.01), (lon + rng.uniform(-0.01, 0.01) + 180) % 360 - 180, T0 + timedelta(hours=rng.randint(0, 300)))
            for i in range(400)] + [(f"h{i}", lat, lon, T0 + timedelta(minutes=i)) for i in range(60)] + [("n", None, lon, T0), ("far", -lat - 9, 0.0, T0)]
    df = spark.createDataFrame(rows, SCHEMA)
    full = [r for r in rows if None not in r]
    want = {r[0]: sum(s[0] != r[0] and abs(r[3] - s[3]) <= timedelta(days=3) and metres(r, s) < 400.0 for s in full) for r in full}
    assert {r.id: r.near_incidents for r in boxes.near_counts(df, 400.0, 3).collect()} == {i: n for i, n in want.items() if n}
    seen = boxes.candidate_rows(df, 400.0, 3)
    assert seen["inside"] > 0 and seen["compared"] < sum(want.values())


def test_near_counts_of_crowded_places(spark):
    """Many incidents at few places, half of them at each other's rim: counted by place and time, not pair by pair (3.6 billion)."""
    import bisect

    from gridwatch.operators import boxes

    steps, n = [0.0, 0.0004, 0.0039, 0.0041, 0.0043], 60_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit(29.0).alias("latitude"),
        F.element_at(F.array(*(F.lit(-82.0 + s) for s in steps)), (F.col("id") % 5 + 1).cast("int")).alias("longitude"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)") * 30)).alias("offense_date"))
    near = [[j for j in range(5) if metres((0, 29.0, -82.0 + steps[i]), (0, 29.0, -82.0 + steps[j])) < 400.0] for i in range(5)]
    at = [list(range(i, n, 5)) for i in range(5)]
    reach = 3 * 86_400 // 30
    want = {str(i): sum(bisect.bisect_right(at[j], i + reach) - bisect.bisect_left(at[j], i - reach) for j in near[i % 5]) - 1 for i in range(n)}
    assert any(len(x) < 5 for x in near)
    plan = boxes.near_counts(rows, 400.0, 3)
    assert {r.id: r.near_incidents for r in plan.collect()} == want
    assert "Join" not in plan._jdf.queryExecution().toString()
