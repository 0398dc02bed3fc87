"""Incident <-> place and incident <-> incident relations built on the cell join.

OCCURRED_NEAR follows the reference's pattern: the distance is measured from
the incident's *Location* (first-seen point of its address), not from the
incident's own coordinates.  So the distance test runs once per distinct
(location, place) pair, which both shrinks the work and takes hot addresses
out of the distance join; the pairs are then expanded to incidents by address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.geo import grid_cell, grid_id, haversine_m, round_mm
from gridwatch.operators.graph import FEW_ROWS, case_spans, location_nodes, rows_of
from gridwatch.operators.poi import AMENITY_PATTERN
from gridwatch.operators.spatial import MARGIN, proximity_join, self_proximity_join, shuffled
from gridwatch.session import materialised

DAY_US = 86_400 * 1_000_000
# Pivot columns: the allow-list words, in the order of the pattern, plus 'other'
# for amenity values that matched the unanchored pattern but are not one of them.
AMENITY_KINDS = AMENITY_PATTERN.split("|")


def epoch_us(ts: F.Column) -> F.Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def location_place_pairs(g: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """(address, osm_type, osm_id, amenity_type, distance_m, lat, lon) for Locations near Places."""
    return point_place_pairs(location_nodes(g).select("address", "lat", "lon"), places, radius_m)


def point_place_pairs(locations: DataFrame, places: DataFrame, radius_m: float, places_probe: bool = True) -> DataFrame:
    """``location_place_pairs`` of (address, lat, lon); the fewer rows should be the probe side (copied to neighbour cells)."""
    sides = [(places, ["osm_type", "osm_id", "amenity_type"]), (locations, ["address"])]
    (probe, probe_cols), (build, build_cols) = sides if places_probe else sides[::-1]
    pairs = proximity_join(probe, build, radius_m, probe_cols=probe_cols, build_cols=build_cols, large=True)
    at, of = ("b_", "p_") if places_probe else ("p_", "b_")
    return pairs.select(F.col(f"{at}address").alias("address"), *(F.col(of + c).alias(c) for c in ("osm_type", "osm_id", "amenity_type")),
                        "distance_m", F.col(f"{at}lat").alias("lat"), F.col(f"{at}lon").alias("lon"))


#: Incidents of one address that go through the distance join in one row.
CHUNK = 1000


@dataclass(frozen=True)
class NearPaths:
    """Incident -> Location -> Place paths, as their two halves.

    ``links``: (case_id, address, n_addresses, apart), one row per OCCURRED_AT edge, n_addresses 3 for three or more;
    ``pairs``: ``location_place_pairs``, planned anew by each use.  The paths are their join on the address.  There are as many as incidents times places near each, so
    whatever needs only counts or one end works on the halves, and folds the pairs where the distance join makes them.  ``apart``: no other
    address of the incident reaches a place that this one reaches, so the paths of the link are edges as they are.
    ``locations``, ``places``: the ends of the pairs, stored.
    """
    links: DataFrame
    pairs: DataFrame
    locations: DataFrame
    places: DataFrame
    radius_m: float

    def joined(self, links: DataFrame, few: bool = False) -> DataFrame:
        """(case_id, osm_type, osm_id, amenity_type, distance_m): the paths of some links, distances rounded to mm.

        An address goes into the distance join with up to CHUNK incidents a row, and its places
        leave it for each of them: neither the pairs nor the paths are shuffled.  ``few``: the links are few enough to be broadcast.
        """
        counted = links.groupBy("address").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
        at = self.locations.filter("lat is not null and lon is not null").join(shuffled(counted), "address")
        chunked = (links.select("case_id", "address").join(shuffled(at), "address")
                   .groupBy("address", "lat", "lon", F.pmod(F.xxhash64("case_id"), F.col("chunks")).alias("chunk"))
                   .agg(F.collect_list("case_id").alias("cases")))
        pairs = proximity_join(self.places, F.broadcast(chunked) if few else chunked, self.radius_m, large=not few,
                               probe_cols=["osm_type", "osm_id", "amenity_type"], build_cols=["cases"])
        place = ["osm_type", "osm_id", "amenity_type"]
        # Rounded once per address and place, not once per incident.
        pairs = pairs.select("b_cases", *(F.col(f"p_{c}").alias(c) for c in place), round_mm(F.col("distance_m")).alias("distance_m"))
        return pairs.select(F.explode("b_cases").alias("case_id"), *place, "distance_m")


def occurred_near_paths(g: DataFrame, places: DataFrame, radius_m: float, spans: DataFrame | None = None) -> NearPaths:
    """Incident -> Location -> Place paths within the radius.  ``places``: one row per (osm_type, osm_id).

    Most incidents have one address.  Two of one incident are apart if they lie farther from each other than twice the
    radius, or if one has no point; an incident with more addresses is not tested.  ``spans``: ``graph.case_spans(g)``, stored.
    """
    spans = materialised(case_spans(g), "spans") if spans is None else spans
    locations = materialised(location_nodes(g).select("address", "lat", "lon"), "locations")
    places = materialised(places.select("osm_type", "osm_id", "amenity_type", "lat", "lon"), "places")
    one = spans.filter("z is null").select("case_id", F.col("a").alias("address"), F.lit(1).alias("n_addresses"), F.lit(True).alias("apart"))
    several = spans.filter("z is not null").select("case_id", "a", "z")
    third = materialised(rows_of(g, several).select("case_id", "location_key", "a", "z")
                         .filter("location_key <> a and location_key <> z").select("case_id", F.col("location_key").alias("address")).distinct(), "third")
    many = third.select("case_id").distinct()
    ends = [locations.select(F.col("address").alias(e), F.col("lat").alias(f"{e}_lat"), F.col("lon").alias(f"{e}_lon")) for e in "az"]
    distance = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("z_lat"), F.col("z_lon"))
    two = (several.join(shuffled(many), "case_id", "left_anti").join(shuffled(ends[0]), "a").join(shuffled(ends[1]), "z")
           .select("case_id", F.explode(F.array("a", "z")).alias("address"), F.lit(2).alias("n_addresses"),
                   F.coalesce(distance > 2.0 * MARGIN * radius_m, F.lit(True)).alias("apart")))
    more = (several.join(shuffled(many), "case_id", "left_semi").select("case_id", F.explode(F.array("a", "z")).alias("address")).unionByName(third)
            .select("case_id", "address", F.lit(3).alias("n_addresses"), F.lit(False).alias("apart")))
    links = one.unionByName(materialised(two.unionByName(more), "links"))
    pairs = point_place_pairs(locations, places, radius_m, places_probe=places.count() <= locations.count())
    return NearPaths(links, pairs, locations, places, radius_m)


def occurred_near(g: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """OCCURRED_NEAR edges (case_id, osm_type, osm_id, distance_m), one per incident and place.

    An incident linked to two addresses can reach one place by two paths; the
    edge is merged once and keeps the shorter distance (the reference leaves
    which SET wins unspecified).  Only links that are not apart need that; all other paths
    leave the distance join as edges, without a shuffle of their own.
    """
    paths = occurred_near_paths(g, places, radius_m)
    whole = paths.joined(paths.links.filter("apart")).select("case_id", "osm_type", "osm_id", "distance_m")
    merged = (paths.joined(paths.links.filter("not apart")).groupBy("case_id", "osm_type", "osm_id")
              .agg(F.min("distance_m").alias("distance_m")))
    return whole.unionByName(merged)


def near_case_ids(paths: NearPaths) -> DataFrame:
    """(case_id) of the incidents with an OCCURRED_NEAR edge, without listing the edges."""
    reached = paths.pairs.select("address").distinct()
    return paths.links.join(shuffled(reached), "address", "left_semi").select("case_id").distinct()


def near_edge_count(paths: NearPaths) -> DataFrame:
    """(n): number of OCCURRED_NEAR edges; links that are apart count by address."""
    return amenity_exposure(paths).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("n"))


def near_incident_pairs(fact: DataFrame, radius_m: float, days: int, with_day: bool = False) -> DataFrame:
    """NEAR edges between incidents: closer than ``radius_m`` and at most ``days`` apart.

    Undirected, stored once with ``id_a < id_b``.  Space and time are both
    cell dimensions of one equi join, so only incidents in neighbouring
    space-time cells are ever compared.  ``with_day`` adds the day of the earlier end.
    """
    base = (fact.filter(F.col("offense_date").isNotNull())
            .select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
                    epoch_us(F.col("offense_date")).alias("t_us")))
    pairs = self_proximity_join(base, "id", radius_m, extra=[("t_us", float(days) * DAY_US)])
    earlier = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.least("a_t_us", "b_t_us") / DAY_US).cast("int"))
    return pairs.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"),
                        round_mm(F.col("distance_m")).alias("distance_m"),
                        F.abs(F.col("a_t_us") - F.col("b_t_us")).alias("micros_apart"),
                        *([earlier.alias("day")] if with_day else []))


def near_counts(pairs: DataFrame) -> DataFrame:
    """Neighbour count per incident from NEAR edges (both endpoints)."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("near_incidents"))


def within_radius(points: DataFrame, fact: DataFrame, radius_m: float) -> DataFrame:
    """Incidents within ``radius_m`` of each query point: (point_id, id, distance_m).

    The query points are the probe side; whether they are broadcast is decided
    from their measured size.
    """
    inc = fact.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    pairs = proximity_join(points, inc, radius_m, probe_cols=["point_id"], build_cols=["id"])
    return pairs.select(F.col("p_point_id").alias("point_id"), F.col("b_id").alias("id"),
                        F.round("distance_m", 3).alias("distance_m"))


def amenity_exposure(paths: NearPaths) -> DataFrame:
    """Per amenity kind: distinct incidents near one, and incident-place edges.

    Places are counted per address and kind.  Incidents of one address add up by address; of the others, those whose links are
    apart by (incident, kind), and only the rest is listed path by path.
    """
    kinds = materialised(paths.pairs.groupBy("address", "amenity_type").agg(F.count(F.lit(1)).alias("places")), "kinds")
    rest = paths.links.filter("not apart")
    counted = paths.links.filter("n_addresses = 1").groupBy("address").agg(F.count(F.lit(1)).alias("cases"))
    single = counted.join(shuffled(kinds), "address").groupBy("amenity_type").agg(
        F.sum("cases").alias("incidents"), F.sum(F.col("cases") * F.col("places")).alias("edges"))
    apart = (paths.links.filter("apart and n_addresses > 1").join(shuffled(kinds), "address")
             .groupBy("amenity_type", "case_id").agg(F.sum("places").alias("n")))
    merged = (paths.joined(rest, few=rest.count() <= FEW_ROWS).select("amenity_type", "case_id", "osm_type", "osm_id").distinct()
              .groupBy("amenity_type", "case_id").agg(F.count(F.lit(1)).alias("n")))
    several = apart.unionByName(merged).groupBy("amenity_type").agg(F.count(F.lit(1)).alias("incidents"), F.sum("n").alias("edges"))
    return (single.unionByName(several).groupBy("amenity_type")
            .agg(F.sum("incidents").alias("incidents"), F.sum("edges").alias("edges")))


def cell_amenity_pivot(paths: NearPaths, deg: float) -> DataFrame:
    """Risk-terrain table: per grid cell of the Location, distinct incidents near each amenity kind.

    An address has one cell and one set of kinds near it.  Its incidents that have no other address are counted
    before they meet the kinds; those with several are made distinct per cell.
    """
    cy, cx = grid_cell(F.col("lat"), F.col("lon"), deg)
    kind = F.when(F.col("amenity_type").isin(*AMENITY_KINDS), F.col("amenity_type")).otherwise("other")
    cols = AMENITY_KINDS + ["other"]
    near = materialised(paths.pairs.select("address", grid_id(cy, cx).alias("grid_id"), kind.alias("kind")).groupBy("address", "grid_id")
                        .agg(*(F.max(F.col("kind") == c).alias(c) for c in cols)), "kinds")
    counted = paths.links.filter("n_addresses = 1").groupBy("address").agg(F.count(F.lit(1)).alias("cases"))
    single = counted.join(shuffled(near), "address").groupBy("grid_id").agg(*(F.sum(F.when(F.col(c), F.col("cases")).otherwise(0)).alias(c) for c in cols))
    several = (paths.links.filter("n_addresses > 1").join(shuffled(near), "address").groupBy("grid_id", "case_id")
               .agg(*(F.max(c).alias(c) for c in cols)).groupBy("grid_id").agg(*(F.count_if(F.col(c)).alias(c) for c in cols)))
    return single.unionByName(several).groupBy("grid_id").agg(*(F.sum(c).cast("long").alias(c) for c in cols))
