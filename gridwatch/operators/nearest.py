"""Nearest place of every amenity kind, for each location.

A k-nearest join by growing rings: in each round, the (location, kind) pairs still without an answer are joined with the
places of that kind closer than the round's radius, through the cell join.  A pair that meets any place is settled:
every place closer than the radius was met, so the nearest of them is the nearest of all.  The radius grows by
``GROWTH`` until all pairs are settled or it spans the globe, where every place is in reach.  So dense areas are settled
with few candidates, and only the pairs of empty areas look far.  The first radius follows the density of the places, so
a ring holds a few places however many there are.  Each round's rest is a table in the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.geo import EARTH_RADIUS_M
from gridwatch.operators.components import Steps
from gridwatch.operators.spatial import proximity_join

GROWTH = 4.0
#: Places of one kind that the first ring shall hold, where places are.
FIRST_PLACES = 8.0
LEAST_M = 1.0
#: No two points are farther apart.
GLOBE_M = math.pi * EARTH_RADIUS_M + 1.0


def first_radius(found: DataFrame, widest_m: float) -> float:
    """Radius within which a place has about ``FIRST_PLACES`` of its kind, at most ``widest_m``: from counts per kind and cell."""
    side = widest_m / EARTH_RADIUS_M
    phi, lam = F.radians("lat"), F.radians("lon")
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    n = found.groupBy("kind", *(F.floor(a / side).alias(f"c{i}") for i, a in enumerate(axes))).agg(F.count(F.lit(1)).cast("double").alias("n"))
    around = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).head()[0] or 1.0
    return max(LEAST_M, widest_m * min(1.0, math.sqrt(FIRST_PLACES / (math.pi * around))))


def nearest_places(locations: DataFrame, places: DataFrame, key: str = "address", first_m: float = 250.0) -> DataFrame:
    """(key, amenity_type, osm_type, osm_id, distance_m) of the nearest place of every kind that has places.

    ``locations``: key, lat, lon; ``places``: osm_type, osm_id, amenity_type, lat, lon.  Of places at one distance (to the
    millimetre) the least (osm_type, osm_id) is taken.  Locations without a point have no rows.
    """
    spark = locations.sparkSession
    steps = Steps(spark, "nearest")
    found = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    # Kinds are numbered, so that the kind is one more axis of the cell join; there are few kinds (one row each).
    kinds = [r.amenity_type for r in found.select("amenity_type").distinct().orderBy("amenity_type").collect()]
    if not kinds:
        return steps.write(locations.select(F.col(key), F.lit("").alias("amenity_type"), F.lit("").alias("osm_type"), F.lit(0).cast("long").alias("osm_id"),
                                            F.lit(0.0).alias("distance_m")).limit(0))
    numbers = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, float(i))))
    # Of places of a kind at one point only the least can be the answer.
    least = F.min(F.struct("osm_type", "osm_id")).alias("least")
    found = steps.write(found.groupBy("amenity_type", "lat", "lon").agg(least)
                        .select("least.osm_type", "least.osm_id", "amenity_type", "lat", "lon", numbers[F.col("amenity_type")].alias("kind")))
    open_ = steps.write(locations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
                        .select(key, "lat", "lon", F.explode(F.array(*(F.lit(float(i)) for i in range(len(kinds))))).alias("kind")))
    settled, radius = None, first_radius(found, first_m)
    while True:
        radius = GLOBE_M if radius * GROWTH > GLOBE_M else radius
        pairs = proximity_join(found, open_, radius, ["osm_type", "osm_id", "amenity_type"], [key], large=True, extra=[("kind", 0.25)])
        best = F.min(F.struct(F.round("distance_m", 3).alias("distance_m"), F.col("p_osm_type").alias("osm_type"), F.col("p_osm_id").alias("osm_id")))
        met = steps.write(pairs.groupBy(F.col(f"b_{key}").alias(key), F.col("b_kind").alias("kind"), F.col("p_amenity_type").alias("amenity_type"))
                          .agg(best.alias("n")).select(key, "kind", "amenity_type", "n.osm_type", "n.osm_id", "n.distance_m"))
        settled = met if settled is None else settled.unionByName(met)
        if radius == GLOBE_M:
            break
        done = met.select(F.col(key).alias("_key"), F.col("kind").alias("_kind"))
        rest = steps.write(open_.join(done, F.col(key).eqNullSafe(F.col("_key")) & (F.col("kind") == F.col("_kind")), "left_anti"))
        steps.drop(open_)
        open_ = rest
        if open_.isEmpty():
            break
        radius *= GROWTH
    return settled.drop("kind").select(key, "amenity_type", "osm_type", "osm_id", "distance_m")
