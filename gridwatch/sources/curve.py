"""A fact store along a Morton curve: boxes and circles read a few key ranges.

The key interleaves the bits of quantised latitude and longitude, so that incidents close on the map are mostly close in
the table.  The store is sorted by it over all files: each file, and each row group in a file, covers a short range of keys.
A box is cut into quadrants of the map; a quadrant is one range of keys.  Quadrants at the border are cut further until there
are ``RANGES`` ranges, neighbours are joined, and the ranges are pushed to the Parquet scan as comparisons of the key with
plain numbers, which prunes files and row groups on both axes.  The exact test of the coordinates follows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.functions.geo import EARTH_RADIUS_M, haversine_m, in_bbox
from gridwatch.schema import FACT
from gridwatch.sources.tables import conform

KEY = "morton"
#: Bits of each axis: a cell of the finest level is about 19 m high.
BITS = 20
RANGES = 32

Box = tuple[float, float, float, float]


def _spread(c: Column) -> Column:
    """The low bits of a number moved to every other place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _quantised(value: Column, low: float, width: float) -> Column:
    level = F.floor((value - F.lit(low)) / F.lit(width) * F.lit(float(1 << BITS)))
    # greatest() and least() skip NULLs, so a missing coordinate is kept apart.
    return F.when(value.isNotNull(), F.least(F.greatest(level, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long"))


def morton_key(lat: Column, lon: Column) -> Column:
    """Position on the curve (latitude in the higher bit of each pair); NULL when either is NULL."""
    return F.shiftleft(_spread(_quantised(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_quantised(lon, -180.0, 360.0)))


def write_fact_curve(fact: DataFrame, path: str, mode: str = "overwrite", options: dict[str, str] | None = None) -> None:
    """Store the fact table sorted by its key over all files; rows of one key (a hot address) are spread by time and id."""
    order = [KEY, "offense_date", "id"]
    (conform(fact, FACT).withColumn(KEY, morton_key(F.col("latitude"), F.col("longitude")))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).options(**(options or {})).parquet(path))


def key_ranges(box: Box, limit: int = RANGES) -> list[tuple[int, int]]:
    """Ranges [first, last] of keys that cover a box (south, west, north, east); west > east crosses the antimeridian."""
    south, west, north, east = box
    if south > north:
        return []
    if west > east:
        half = limit // 2
        return _joined(key_ranges((south, west, north, 180.0), half) + key_ranges((south, -180.0, north, east), half))
    cell = lambda v, low, width: min(max(math.floor((v - low) / width * (1 << BITS)), 0), (1 << BITS) - 1)
    # One cell more on each side, so that the rounding of engines does not matter.
    y0, y1 = max(cell(south, -90.0, 180.0) - 1, 0), min(cell(north, -90.0, 180.0) + 1, (1 << BITS) - 1)
    x0, x1 = max(cell(west, -180.0, 360.0) - 1, 0), min(cell(east, -180.0, 360.0) + 1, (1 << BITS) - 1)
    whole: list[tuple[int, int]] = []
    # Largest quadrants first: (-level, first key, row, column), all at the border of the box.
    border = [(-BITS, 0, 0, 0)]
    while border and len(whole) + len(border) < limit + 3 and border[0][0] < 0:
        level, key, y, x = heapq.heappop(border)
        size = 1 << (-level - 1)
        for q in range(4):
            qy, qx = y + (q >> 1) * size, x + (q & 1) * size
            if qy > y1 or qx > x1 or qy + size <= y0 or qx + size <= x0:
                continue
            first = key + q * size * size
            if y0 <= qy and qy + size - 1 <= y1 and x0 <= qx and qx + size - 1 <= x1:
                whole.append((first, first + size * size - 1))
            else:
                heapq.heappush(border, (level + 1, first, qy, qx))
    return _joined(whole + [(key, key + (1 << -2 * level) - 1) for level, key, _, _ in border])


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    test = F.lit(False)
    for first, last in ranges:
        test = test | F.col(KEY).between(first, last)
    return test


def facts_in_bbox_curve(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """Incidents inside a box (edges included); west > east crosses the antimeridian."""
    south, west, north, east = box
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = in_bbox(lat, lon, *box) if west <= east else lat.between(south, north) & ((lon >= west) | (lon <= east))
    return (spark.read.parquet(path).filter(in_ranges(key_ranges(box)) & inside)
            .select("id", "incident_type", "offense_date", "latitude", "longitude"))


def box_around(lat: float, lon: float, radius_m: float) -> Box:
    """The smallest box that holds a circle; all longitudes where it holds a pole."""
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    south, north = lat - reach, lat + reach
    if south <= -90.0 or north >= 90.0:
        return max(south, -90.0), -180.0, min(north, 90.0), 180.0
    side = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * (1 + 1e-9)
    if side >= 180.0:
        return south, -180.0, north, 180.0
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    return south, wrap(lon - side), north, wrap(lon + side)


def facts_in_radius_curve(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Incidents closer than ``radius_m`` to a point: (id, distance_m)."""
    away = haversine_m(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return (spark.read.parquet(path).filter(in_ranges(key_ranges(box_around(lat, lon, radius_m))))
            .select("id", away.alias("away")).filter(F.col("away") < radius_m).select("id", F.round("away", 3).alias("distance_m")))
