"""Kernel scores, nearest places and the risk terrain model against plain computations; stored scopes, replay, generations."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwatch.functions.geo import EARTH_RADIUS_M
from gridwatch.operators import nearest, predict, terrain
from gridwatch.operators.proximity import AMENITY_KINDS
from gridwatch.sources import tables
from gridwatch.streaming import source, windows

T = datetime(2024, 1, 20, 12)
DEG = 0.0025


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def cells_of(spark, rows):
    schema = "id string, incident_type string, offense_date timestamp_ntz, latitude double, longitude double, offense_hour int, offense_day_of_week string"
    return predict.with_cells(spark.createDataFrame([(*r, 1, "Monday") for r in rows], schema), DEG)


@pytest.mark.parametrize("lat,lon", [(29.65, -82.3), (0.0, 179.999), (-67.0, 20.0)])
def test_kernel_equals_a_double_loop(spark, lat, lon):
    rng = random.Random(1)
    rows = [(str(i), rng.choice(["A", "B"]), T - timedelta(hours=rng.randint(-50, 400)), lat + rng.uniform(-0.01, 0.01),
             (lon + rng.uniform(-0.01, 0.01) + 180) % 360 - 180) for i in range(150)]
    rows += [("n", "A", None, lat, lon), ("m", "A", T, lat, lon)]
    reach, band, half = 700.0, 250.0, 7.0
    columns = round(360 / DEG)
    want: dict = {}
    for _, kind, at, y, x in rows:
        if at is None or at >= T:
            continue
        cy, cx = math.floor(y / DEG), math.floor(x / DEG)
        mass = 0.5 ** ((T - at) / timedelta(days=half))
        for dy in range(-5, 6):
            for dx in range(-12, 13):
                d = metres(((cy + 0.5) * DEG, (cx + 0.5) * DEG), ((cy + dy + 0.5) * DEG, (cx + dx + 0.5) * DEG))
                if d <= reach:
                    key = (f"{cy + dy}:{(cx + dx + columns // 2) % columns - columns // 2}", kind)
                    want[key] = want.get(key, 0.0) + mass * math.exp(-d * d / (2 * band * band))
    top = {k: max(v for (_, kind), v in want.items() if kind == k) for k in "AB"}
    got = {(r.grid_id, r.incident_type): r.risk_score for r in predict.grid_scores_kernel(
        cells_of(spark, rows), str(T), "kernel-v1", DEG, half, band, reach).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v / top[k[1]], abs=2e-6) for k, v in want.items())


def test_scores_ignore_the_future(spark):
    rows = [("1", "A", T - timedelta(days=7), 29.0, -82.0), ("2", "A", T + timedelta(days=7), 29.1, -82.0), ("3", "A", T, 29.2, -82.0)]
    cells = cells_of(spark, rows).withColumn("day_name", F.lit("Saturday")).withColumn("part_of_day", F.lit("afternoon"))
    assert predict.grid_scores(cells, str(T), "count-v1").count() == 1
    assert {r.risk_score for r in predict.grid_scores(cells, str(T), "count-v1", by_type=False).collect()} == {1.0}


def test_scopes_do_not_replace_each_other(spark, scratch):
    rows = [(str(i), "AB"[i % 2], T - timedelta(days=7), 29.0 + i * 0.003, -82.0) for i in range(10)]
    cells = cells_of(spark, rows).withColumn("day_name", F.lit("Saturday")).withColumn("part_of_day", F.lit("afternoon"))
    for order in ((True, False), (False, True)):
        path = f"{scratch}/{order[0]}"
        for by_type in order:
            predict.store_predictions(predict.grid_scores(cells, str(T), "count-v1", by_type=by_type), path)
        got = {r.scope: r["count"] for r in predict.predictions_at(spark, path, str(T)).groupBy("scope").count().collect()}
        assert got == {"by_type": 10, "all": 10}


def test_nearest_places(spark):
    rng = random.Random(4)
    kinds = ["bar", "cafe", "bank"]
    places = [("node", i, rng.choice(kinds[:2]), 29.6 + rng.uniform(-0.05, 0.05), -82.3 + rng.uniform(-0.05, 0.05)) for i in range(60)]
    places += [("way", 900, "bank", -40.0, 100.0), ("node", 901, "bar", 10.0, 179.999), ("node", 902, "bar", 10.0, -179.0), ("node", 903, "cafe", 89.9, 0.0)]
    places += [("node", 910, "cafe", 29.6, -82.3), ("node", 909, "cafe", 29.6, -82.3), ("node", 911, "bar", None, 1.0)]  # a tie; no point
    spots = [(f"a{i}", 29.6 + rng.uniform(-0.1, 0.1), -82.3 + rng.uniform(-0.1, 0.1)) for i in range(40)]
    spots += [("tie", 29.6, -82.3), ("line", 10.0, -179.9995), ("pole", 89.95, 179.0), ("sea", -30.0, -10.0), ("antipode", 40.0, -80.0), ("none", None, 3.0)]
    got = {(r.address, r.amenity_type): (r.osm_type, r.osm_id, r.distance_m) for r in nearest.nearest_places(
        spark.createDataFrame(spots, "address string, lat double, lon double"),
        spark.createDataFrame(places, "osm_type string, osm_id long, amenity_type string, lat double, lon double")).collect()}
    assert len(got) == (len(spots) - 1) * 3
    for name, y, x in spots[:-1]:
        for kind in kinds:
            d, typ, number = min((round(metres((y, x), (p[3], p[4])), 3), p[0], p[1]) for p in places if p[2] == kind and p[3] is not None)
            assert got[name, kind][:2] == (typ, number) and got[name, kind][2] == pytest.approx(d, abs=2e-3)


def test_nearest_without_places(spark):
    spots = spark.createDataFrame([("a", 1.0, 1.0)], "address string, lat double, lon double")
    places = spark.createDataFrame([], "osm_type string, osm_id long, amenity_type string, lat double, lon double")
    assert nearest.nearest_places(spots, places).count() == 0


def dense_fit(x, y):
    """Poisson regression of all cells at once, by damped Newton steps on the full matrix."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.append(0.0, np.full(x.shape[1] - 1, terrain.RIDGE))
    w = np.zeros(x.shape[1])
    w[0] = np.log(y.mean())
    for _ in range(200):
        mean = np.exp(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x * mean[:, None]).T @ x + np.diag(ridge) + 1e-12 * np.eye(len(w)), x.T @ (y - mean) - ridge * w)
        w += step * min(1.0, 1.0 / np.abs(step).max())
    return w


def test_terrain_equals_a_dense_fit(spark):
    rng = np.random.default_rng(3)
    masks = rng.choice([0, 1, 2, 3, 5, 64, 65, 130, 512 + 8], 900)
    bits = (masks[:, None] >> np.arange(len(AMENITY_KINDS))) & 1
    truth = np.array([0.9, -0.5, 0.4, 0.0, 0, 0, 1.2, 0.3, 0, 0.1])
    y = rng.poisson(np.exp(0.2 + bits @ truth))
    df = spark.createDataFrame([(i, i, int(n), int(m)) for i, (n, m) in enumerate(zip(y, masks, strict=True))], "cell_y long, cell_x long, incidents long, factors int")
    out = terrain.rtm_weights(df)
    got = {r.factor: r for r in out.collect()}
    want = dense_fit(bits.astype(float), y.astype(float))
    assert [got[f].weight for f in ("constant", *AMENITY_KINDS)] == pytest.approx(want.tolist(), abs=2e-6)
    assert got["constant"].cells == 900 and got["bar"].cells == bits[:, 0].sum() and got["bar"].incidents == y[bits[:, 0] == 1].sum()
    scores = [r.risk_score for r in terrain.rtm_scores(df, out).collect()]
    assert max(scores) == 1.0 and min(scores) > 0
    assert [r.weight for r in terrain.rtm_weights(df.limit(0)).collect()] == [0.0] * 11


def feed(spark, rows):
    df = spark.createDataFrame(rows, "seq long, id string, offense_date string")
    return source.parsed(df.select("seq", F.to_json(F.struct("id", "offense_date", F.lit("Theft").alias("narrative"))).alias("value")))


def counts(spark, path):
    return {str(r.window_start)[:10]: r.incidents for r in windows.read_incident_window_counts(spark, path).collect()}


def test_window_counts_take_an_incident_once(spark, scratch):
    first = [(10, "a", "2024-03-10 12:00:00"), (11, "b", "2024-03-10 13:00:00"), (12, "b", "2024-03-11 13:00:00"), (13, "c", "bad")]
    one, two = (windows.IncidentCountSink(scratch, f"/ckpt/{n}", "1 day") for n in (1, 2))
    one(feed(spark, first), 0)
    assert counts(spark, scratch) == {"2024-03-10": 2}
    one(feed(spark, first), 0)  # retried
    two(feed(spark, first), 0)  # read again under another checkpoint
    assert counts(spark, scratch) == {"2024-03-10": 2}
    # An earlier record of b moves it; c's later record with a date does not count, its first one had none.
    two(feed(spark, [(5, "b", "2024-02-01 01:00:00"), (20, "c", "2024-03-10 12:00:00"), (21, "d", "2024-03-10 12:00:00")]), 1)
    assert counts(spark, scratch) == {"2024-03-10": 2, "2024-02-01": 1}
    windows.compact_incidents(spark, scratch, "folded")
    assert counts(spark, scratch) == {"2024-03-10": 2, "2024-02-01": 1}
    one(feed(spark, first), 1)
    assert counts(spark, scratch) == {"2024-03-10": 2, "2024-02-01": 1}


def test_failed_refresh_leaves_the_old_graph(spark, scratch, monkeypatch):
    from gridwatch.operators import clean, graph
    from gridwatch.sources import standin

    t = clean.type_incidents(standin.incident_payloads(spark, "/root/testdata/sf0.001"))
    half, whole = graph.graph_input(t.filter("seq < 300")), graph.graph_input(t)
    with pytest.raises(FileNotFoundError):
        tables.current_graph(spark, scratch)
    tables.refresh_graph(half, t, scratch)
    old = tables.current_graph(spark, scratch)
    before = spark.read.parquet(f"{old}/edges").count()

    def broken(g):
        return {"location": graph.location_nodes(g), "edges": g.select(F.raise_error(F.lit("lost")).alias("x"))}

    with monkeypatch.context() as m:
        m.setattr(tables, "graph_tables", broken)
        with pytest.raises(Exception, match="lost"):
            tables.refresh_graph(whole, t, scratch)
    assert tables.current_graph(spark, scratch) == old and spark.read.parquet(f"{old}/edges").count() == before
    new = tables.refresh_graph(whole, t, scratch)
    # A reader that resolved the pointer earlier keeps its generation until it is dropped.
    assert spark.read.parquet(f"{old}/edges").count() == before
    assert tables.current_graph(spark, scratch) == new and spark.read.parquet(f"{new}/edges").count() > before
    tables.drop_old_generations(spark, scratch, keep=1)
    assert tables.current_graph(spark, scratch) == new and len(tables._children(spark, f"{scratch}/generations")) == 1
