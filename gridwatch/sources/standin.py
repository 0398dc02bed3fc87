"""Stand-in inputs built from the driver's test tables.

The test tables carry no incidents or places, so these two functions only
reshape rows of ``events`` and ``part`` into the raw layouts the pipelines
read (stream payload strings; POI dump elements).  They do none of the jobs'
work: every job downstream treats their output as arbitrary data of that
schema.  The arithmetic is plain so that a SQL oracle can rebuild the same
rows; it injects the kinds of dirt real feeds carry (replayed ids, bad
dates, missing hours, missing coordinates, POIs without names or
coordinates, amenities outside the allow-list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.schema import RAW_INCIDENT


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed values of the stand-in layout (the oracle SQL repeats them).
AMENITY_PICK = [
    "bar", "pub", "nightclub", "restaurant", "cafe", "atm", "bank", "school",
    "university", "parking", "fast_food", "fuel", "bicycle_parking",
]


def incident_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> stream payload columns (all strings) plus ``seq``.

    seq = event_id (arrival order); every 50th id repeats the previous id with
    other content; 1 in 43 dates is junk text; 1 in 47 hours is missing;
    1 in 41 latitudes is missing; coordinates jitter per event around a point
    per user (the address).
    """
    ev = read_table(spark, sf_dir, "events")
    cols = {
        "seq": "event_id",
        "id": "cast(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS string)",
        "narrative": "event_type",
        "report_date": "cast(ts + INTERVAL 1 DAY AS string)",
        "offense_date": "CASE WHEN event_id % 43 = 0 THEN 'bad' ELSE cast(ts AS string) END",
        "offense_hour_of_day": "CASE WHEN event_id % 47 = 0 THEN NULL ELSE cast(hour(ts) AS string) END",
        "offense_day_of_week": "date_format(ts, 'EEEE')",
        "address": "concat('ADDR-', cast(user_id AS string))",
        "latitude": ("CASE WHEN event_id % 41 = 0 THEN NULL ELSE cast(round(29.59 + "
                     "(user_id * 37 % 131) * 0.001 + (event_id % 3) * 0.0001, 4) AS string) END"),
        "longitude": ("cast(round(-82.42 + (user_id * 53 % 151) * 0.001 + "
                      "(event_id % 5) * 0.0001, 4) AS string)"),
        "city": "'Springfield'",
        "state": "'ST'",
    }
    order = ["seq"] + [f.name for f in RAW_INCIDENT.fields]
    return ev.select(*[F.expr(cols[c]).alias(c) for c in order])


def incident_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads as JSON text messages (``seq``, ``value``), like the topic."""
    raw = incident_payloads(spark, sf_dir)
    fields = [f.name for f in RAW_INCIDENT.fields]
    return raw.select("seq", F.to_json(F.struct(*fields)).alias("value"))


def late_incident_json(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """``incident_json`` with every fifth offence ``days`` earlier: reports that come late."""
    raw = incident_payloads(spark, sf_dir)
    earlier = F.date_format(F.col("offense_date").try_cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = raw.withColumn("offense_date", F.when((F.col("seq") % 5 == 0) & earlier.isNotNull(), earlier).otherwise(F.col("offense_date")))
    return raw.select("seq", F.to_json(F.struct(*[f.name for f in RAW_INCIDENT.fields])).alias("value"))


def poi_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` -> POI dump elements (type, id, lat, lon, center, tags).

    Even keys are nodes (own lat/lon), odd keys are ways (centre only).  Every
    7th has no name tag; every 89th node sits at latitude 0 and every 97th
    element has no coordinates at all.  ``seq`` is the order in the dump; every 10th
    element comes a second time, later, under another name and amenity.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.col("p_partkey").cast("long").alias("seq"))
    again = p.filter("p_partkey % 10 = 0").select(
        "p_partkey", (F.col("p_size") + 1).alias("p_size"), F.upper("p_name").alias("p_name"),
        (F.col("seq") + F.lit(1 << 32)).alias("seq"))
    p = p.unionByName(again)
    lat = F.expr("29.59D + (p_partkey * 41 % 131) * 0.001D")
    lon = F.expr("-82.42D + (p_partkey * 29 % 151) * 0.001D")
    picks = F.array(*[F.lit(w) for w in AMENITY_PICK])
    amenity = F.element_at(picks, (F.col("p_size") % len(AMENITY_PICK) + 1).cast("int"))
    is_node = (F.col("p_partkey") % 2) == 0
    no_coords = (F.col("p_partkey") % 97) == 0
    zero_lat = (F.col("p_partkey") % 89) == 0
    node_lat = F.when(no_coords, None).when(zero_lat, F.lit(0.0)).otherwise(lat)
    tags = F.when((F.col("p_partkey") % 7) == 0, F.create_map(F.lit("amenity"), amenity)) \
        .otherwise(F.create_map(F.lit("amenity"), amenity, F.lit("name"), F.col("p_name")))
    center = F.struct(lat.alias("lat"), lon.alias("lon"))
    return p.select(
        F.when(is_node, "node").otherwise("way").alias("type"),
        F.col("p_partkey").cast("long").alias("id"),
        F.when(is_node, node_lat).cast("double").alias("lat"),
        F.when(is_node & ~no_coords, lon).cast("double").alias("lon"),
        F.when(~is_node & ~no_coords, center).alias("center"),
        tags.alias("tags"),
        "seq",
    )
