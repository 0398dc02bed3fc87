"""Points of interest: flatten a POI dump, select amenities, build Place nodes.

A dump is a list of elements (nodes with their own lat/lon, ways with a
centre).  When it arrives as one JSON document with a top-level ``elements``
array, ``read_overpass_document`` explodes it; a JSON-lines landing of one
element per line is splittable and is the layout to prefer at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.functions import geo
from gridwatch.operators.facts import pick_by_seq
from gridwatch.schema import POI_DOCUMENT, POI_ELEMENT

# ---------------------------------------------------------------------------
# Fixed values
#   amenity allow-list, matched as an UNANCHORED regular expression
#   (so e.g. 'bicycle_parking' matches through 'parking'):
#     bar|pub|nightclub|restaurant|cafe|atm|bank|school|university|parking
#   default bounding box (south, west, north, east): 29.59, -82.42, 29.72, -82.27
#   element types: node, way
#   default POI name: 'Unknown'; default amenity: 'unknown'
# ---------------------------------------------------------------------------
AMENITY_PATTERN = "bar|pub|nightclub|restaurant|cafe|atm|bank|school|university|parking"
DEFAULT_BBOX = (29.5900, -82.4200, 29.7200, -82.2700)
ELEMENT_TYPES = ("node", "way")
UNKNOWN_NAME = "Unknown"
UNKNOWN_AMENITY = "unknown"


def read_overpass_document(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """One JSON document ``{"elements": [...]}`` per file -> one row per element, ``seq`` in file order.

    A document is read by one task; land elements as JSON lines
    (``read_elements_jsonl``) where dumps are large.
    """
    from gridwatch.sources.files import with_file_order

    doc = spark.read.schema(POI_DOCUMENT).option("multiLine", True).json(path)
    el = with_file_order(doc, "document").select("document", F.posexplode("elements").alias("place", "e")).select(
        "e.*", (F.shiftleft("document", 32) + F.col("place")).alias("seq"))
    # A single document is read by one task; spread the elements before the work.
    return el.repartition(min_partitions) if min_partitions else el


def read_elements_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Element-per-line landing (splittable), ``seq`` in file order."""
    from gridwatch.sources.files import with_file_order

    return with_file_order(spark.read.schema(POI_ELEMENT).json(path))


def flatten_elements(el: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Elements -> flat POIs ``(id, type, amenity, name, lat, lon)``.

    Keeps node/way elements whose amenity tag matches the allow-list, takes the
    element's own coordinate or else the way's centre (a 0 counts as missing,
    as in the reference's truthiness test), drops elements without a usable
    coordinate, optionally keeps the bounding box (on the point), and keeps one
    row per (type, id), the last by ``seq``: the union of the node and way
    selections is a set, and a later element overwrites an earlier one.
    """
    amenity = F.col("tags").getItem("amenity")
    lat = F.coalesce(F.nullif(F.col("lat"), F.lit(0.0)), F.col("center.lat"))
    lon = F.coalesce(F.nullif(F.col("lon"), F.lit(0.0)), F.col("center.lon"))
    flat = (el.filter(F.col("type").isin(*ELEMENT_TYPES) & amenity.rlike(AMENITY_PATTERN))
            .select(F.col("id").cast("long").alias("id"), F.col("type"),
                    amenity.alias("amenity"),
                    F.coalesce(F.col("tags").getItem("name"), F.lit(UNKNOWN_NAME)).alias("name"),
                    lat.alias("lat"), lon.alias("lon"), F.col("seq"))
            .filter(F.col("lat").isNotNull() & (F.col("lat") != 0)
                    & F.col("lon").isNotNull() & (F.col("lon") != 0)))
    if bbox is not None:
        s, w, n, e = bbox
        flat = flat.filter(F.col("lat").between(s, n) & F.col("lon").between(w, e))
    return pick_by_seq(flat, ["type", "id"], ["id", "type", "amenity", "name", "lat", "lon", "seq"], last=True)


def place_nodes(pois: DataFrame) -> DataFrame:
    """Place nodes keyed by (osm_type, osm_id); rows without coordinates are skipped.

    Keyed by type and id together: node and way ids are separate number
    spaces, so ``osm_id`` alone could merge two different places.
    """
    return (pois.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"),
                    F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name"),
                    F.coalesce("amenity", F.lit(UNKNOWN_AMENITY)).alias("amenity_type"),
                    F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                    geo.point(F.col("lon"), F.col("lat")).alias("point"), F.col("seq")))
