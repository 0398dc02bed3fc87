"""Incident clusters: density-connected groups of NEAR incidents.

An incident is a *core* if at least ``min_near`` others are NEAR it (closer than ``radius_m`` and at most
``days`` apart).  Cores that are NEAR each other share a cluster, whose id is its smallest core id; an
incident that isn't a core but is NEAR one belongs to the smallest such cluster; others to none.

The links of a crowded place are never listed.  Incidents fall into small space-time cells whose points
are all NEAR each other (the diagonal is shorter than the radius).  A cell of more than ``min_near``
incidents is *dense*: its incidents are cores of one cluster, and the cell is one node.  What remains:

* incidents of sparse cells are compared with all incidents in reach.  There are at most ``min_near`` of them to a cell
  and a bounded number of cells in reach of a point, so this is linear in the input, however crowded a cell is;
* two dense cells are linked by the boxes around their incidents: farthest corners in reach, linked; nearest sides out of reach,
  not.  Only in between are points compared, and only those (once per place and time) in reach of the other's box.

Components are found by ``components``: rounds of grouped minima and pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.operators import boxes
from gridwatch.operators.components import components
from gridwatch.operators.proximity import DAY_US
from gridwatch.operators.spatial import proximity_join
from gridwatch.session import materialised


def dense_links(dense: DataFrame, points: DataFrame, radius_m: float, days: float) -> DataFrame:
    """(u, v): pairs of dense cells in which some incidents are NEAR each other.

    ``points``: the incidents of dense cells with their node.
    """
    near = materialised(boxes.cell_pairs(dense, radius_m, days), "cell_pairs")
    places = points.dropDuplicates(["node", "lat", "lon", "t_us"])
    sides = [boxes.rim_points(near, places, side, radius_m, days) for side in "ab"]
    met = sides[0].join(sides[1], ["a_node", "b_node"]).filter(boxes.rim_test(radius_m, days)).select("a_node", "b_node")
    return near.filter("inside").select("a_node", "b_node").unionByName(met).distinct().toDF("u", "v")


def incident_clusters(fact: DataFrame, radius_m: float, days: float, min_near: int) -> DataFrame:
    """(case_id, cluster_id, is_core) of every incident in a cluster."""
    base = materialised(boxes.points(fact, radius_m, days), "points")
    dense = materialised(boxes.cells(base).filter(F.col("n") > min_near), "dense")
    marked = materialised(base.join(dense.select(*boxes.KEYS, "node"), boxes.KEYS, "left").drop(*boxes.KEYS), "marked")

    sparse = marked.filter(F.col("node").isNull())
    links = proximity_join(sparse, marked, radius_m, ["id"], ["id", "node"], extra=[("t_us", days * DAY_US)])
    links = materialised(links.filter(F.col("p_id") != F.col("b_id")).select("p_id", "b_id", "b_node"), "links")
    cores = materialised(links.groupBy("p_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_near).select("p_id"), "cores")

    # Links of sparse incidents to cores: (incident, node of the core).
    to_core = links.join(cores.withColumnRenamed("p_id", "c_id"), F.col("b_id") == F.col("c_id"), "left").select(
        "p_id", F.coalesce("b_node", "c_id").alias("node")).filter(F.col("node").isNotNull()).distinct()
    to_core = materialised(to_core.join(cores.select(F.col("p_id").alias("c_id"), F.lit(True).alias("core")), F.col("p_id") == F.col("c_id"), "left")
                           .select("p_id", "node", F.coalesce("core", F.lit(False)).alias("core")), "to_core")
    edges = to_core.filter("core").select(F.col("p_id").alias("u"), F.col("node").alias("v")).unionByName(
        dense_links(dense, marked.filter(F.col("node").isNotNull()), radius_m, days))
    labels = components(edges)

    members = (marked.filter(F.col("node").isNotNull()).select(F.col("id").alias("case_id"), "node", F.lit(True).alias("is_core"))
               .unionByName(cores.select(F.col("p_id").alias("case_id"), F.col("p_id").alias("node"), F.lit(True).alias("is_core")))
               .unionByName(to_core.filter(~F.col("core")).select(F.col("p_id").alias("case_id"), "node", F.lit(False).alias("is_core"))))
    return (members.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
            .groupBy("case_id", "is_core").agg(F.min(F.coalesce("label", "node")).alias("cluster_id"))
            .select("case_id", "cluster_id", "is_core"))


def cluster_summary(clusters: DataFrame, fact: DataFrame) -> DataFrame:
    """Per cluster: incidents, cores, first and last offence, mean point."""
    at = fact.select(F.col("id").alias("case_id"), "latitude", "longitude", "offense_date")
    return (clusters.join(at, "case_id").groupBy("cluster_id")
            .agg(F.count(F.lit(1)).alias("incidents"), F.count_if("is_core").alias("cores"), F.min("offense_date").alias("first_offense"),
                 F.max("offense_date").alias("last_offense"), F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon")))
