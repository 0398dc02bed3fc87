"""Geographic column expressions: points, great-circle distance, cells.

All are built-in Spark expressions, so distance tests run inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
#   earth radius used for point distances: 6378140 metres (WGS-84 based)
#   SRID of stored points: 4326
#   WKT point text: 'POINT(' || lon || ' ' || lat || ')'  (longitude first)
#   default proximity threshold: 200 metres, strict '<'
# ---------------------------------------------------------------------------
EARTH_RADIUS_M = 6378140.0
SRID = 4326
NEAR_PLACE_M = 200.0

# Our definition (the reference names a grid but fixes none): square cells of
# 0.0025 degrees, grid_id = cell_y || ':' || cell_x.
GRID_DEG = 0.0025


def wkt_point(lon: Column, lat: Column) -> Column:
    """WKT text of a point (coordinates in SRID 4326); NULL when either is NULL."""
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def point(lon: Column, lat: Column) -> Column:
    """Point value ``struct(lon, lat, srid)``; NULL when either coordinate is NULL."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat"), F.lit(SRID).alias("srid")))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                radius_m: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2.0 * radius_m) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def round_mm(distance_m: Column) -> Column:
    """``F.round(distance_m, 3)`` of a distance on Earth, without its detour over decimal text but where a half is near."""
    mm = distance_m * F.lit(1000.0)
    away = F.abs(mm - F.floor(mm) - F.lit(0.5))
    return F.when(away > F.lit(1e-3), F.floor(mm + F.lit(0.5)) / F.lit(1000.0)).otherwise(F.round(distance_m, 3))


def grid_cell(lat: Column, lon: Column, deg: float = GRID_DEG) -> tuple[Column, Column]:
    """Square lat/lon grid indices (cell_y, cell_x) used for display and prediction."""
    return (F.floor(lat / F.lit(float(deg))).cast("long"),
            F.floor(lon / F.lit(float(deg))).cast("long"))


def grid_id(cell_y: Column, cell_x: Column) -> Column:
    return F.concat(cell_y.cast("string"), F.lit(":"), cell_x.cast("string"))


def in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Plain range predicates, so Parquet can skip row groups on stored tables."""
    return lat.between(south, north) & lon.between(west, east)

