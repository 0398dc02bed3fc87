"""The Morton store: keys, covering ranges, results equal to plain filters, and the share of row groups that a view reads."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridwatch.sources import curve


def plain_key(lat, lon):
    y = min(max(int((lat + 90) / 180 * (1 << curve.BITS)), 0), (1 << curve.BITS) - 1)
    x = min(max(int((lon + 180) / 360 * (1 << curve.BITS)), 0), (1 << curve.BITS) - 1)
    return sum(((y >> b) & 1) << (2 * b + 1) | ((x >> b) & 1) << (2 * b) for b in range(curve.BITS))


def test_keys(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "lat double, lon double")
    got = [r.k for r in df.select(curve.morton_key(F.col("lat"), F.col("lon")).alias("k")).collect()]
    assert got[:-2] == [plain_key(*r) for r in rows] and got[-2:] == [None, None]


def test_ranges_cover_the_box():
    rng = random.Random(2)
    for _ in range(200):
        south, west = rng.uniform(-90, 80), rng.uniform(-180, 170)
        box = (south, west, min(90.0, south + rng.choice([0.001, 0.1, 20])), min(180.0, west + rng.choice([0.001, 0.1, 30])))
        ranges = curve.key_ranges(box)
        assert 0 < len(ranges) <= curve.RANGES + 4 and all(a <= b for a, b in ranges)
        assert all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
        for _ in range(20):
            key = plain_key(rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3]))
            assert any(a <= key <= b for a, b in ranges)
        # Not much more than the box is read, unless it is a thin strip: the area of the ranges is a small multiple of its own.
        height, width = box[2] - box[0], box[3] - box[1]
        if max(height, width) < 4 * min(height, width):
            area = sum(b - a + 1 for a, b in ranges) / 4 ** curve.BITS * 180 * 360
            assert area < 4 * max(height * width, 1e-6)
    assert curve.key_ranges((5.0, 1.0, 4.0, 2.0)) == []


@pytest.fixture(scope="module")
def stored(spark):
    from gridwatch.session import shared_path

    path = shared_path(spark, "tests", fresh=True)
    rng = random.Random(3)
    spots = [(rng.uniform(29.0, 30.0), rng.uniform(-83.0, -82.0)) for _ in range(40_000)]
    spots += [(rng.uniform(-1, 1), (180 + rng.uniform(-1, 1) + 180) % 360 - 180) for _ in range(400)] + [(29.5, -82.5)] * 400
    rows = spark.createDataFrame([(str(i), *s, i) for i, s in enumerate([*spots, (None, 1.0)])], "id string, latitude double, longitude double, seq long")
    text = [F.lit("x").alias(c) for c in ("incident_type", "description", "address", "city", "state", "offense_day_of_week", "geometry")]
    dates = [F.lit("2024-01-01").cast("timestamp_ntz").alias(c) for c in ("offense_date", "report_date")]
    curve.write_fact_curve(rows.select("*", *text, *dates, F.lit(1).alias("offense_hour")), path,
                           options={"parquet.block.size": "20000", "parquet.page.size": "4000", "parquet.block.size.row.check.min": "100",
                                    "parquet.page.size.row.check.min": "100"})
    return path, spots


@pytest.mark.parametrize("box", [(29.40, -82.60, 29.45, -82.50), (29.5, -82.5, 29.5, -82.5), (-0.5, 179.5, 0.5, -179.6), (28.0, -84.0, 31.0, -81.0), (10.0, 10.0, 11.0, 11.0)])
def test_box_equals_a_plain_filter(spark, stored, box):
    path, spots = stored
    south, west, north, east = box
    inside = lambda y, x: south <= y <= north and (west <= x <= east if west <= east else x >= west or x <= east)
    got = sorted(r.id for r in curve.facts_in_bbox_curve(spark, path, box).collect())
    assert got == sorted(str(i) for i, s in enumerate(spots) if inside(*s))


def test_a_view_reads_a_small_share(spark, stored):
    """Row groups whose key range meets the view's ranges; a narrow view on either axis prunes alike."""
    path, _ = stored
    groups = []
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.names.index(curve.KEY)
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        groups += [(s.min, s.max) for s in stats if s is not None and s.has_min_max]
    assert len(groups) > 40
    for box in ((29.40, -82.60, 29.45, -82.55), (29.0, -82.52, 30.0, -82.50), (29.50, -83.0, 29.52, -82.0)):
        ranges = curve.key_ranges(box)
        read = sum(any(a <= high and low <= b for a, b in ranges) for low, high in groups)
        assert 0 < read < 0.35 * len(groups), (box, read, len(groups))
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = curve.facts_in_bbox_curve(spark, path, box)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(morton," in pushed and "LessThanOrEqual(morton," in pushed


def test_circles(spark, stored):
    path, spots = stored
    for lat, lon, radius in ((29.5, -82.5, 3000.0), (0.0, 179.999, 60_000.0), (89.0, 0.0, 200_000.0)):
        df = spark.createDataFrame([(str(i), *s) for i, s in enumerate(spots)], "id string, lat double, lon double")
        want = df.filter(curve.haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) < radius)
        got = [r.id for r in curve.facts_in_radius_curve(spark, path, lat, lon, radius).collect()]
        assert sorted(got) == sorted(r.id for r in want.collect())
    assert curve.box_around(89.9, 10.0, 50_000.0)[1::2] == (-180.0, 180.0)
    assert curve.box_around(0.0, 180.0, 1000.0)[1] > 179 and curve.box_around(0.0, 180.0, 1000.0)[3] < -179
