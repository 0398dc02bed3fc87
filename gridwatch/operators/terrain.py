"""Risk terrain model: how much more incidents a grid cell sees for each kind of place in reach.

Incident counts of cells follow a Poisson regression on one 0/1 factor for each amenity kind (a place of that kind
lies closer than ``reach_m`` to the cell's centre) and a constant.  Cells with the same factors are alike to
the model, so Spark first reduces them to one row per combination of factors: cells and incidents (at most 2^10
rows, whatever the number of cells).  Each Newton step is then one Spark aggregate: the 11 x 11 matrix and the gradient; the
driver solves that system.  ``RIDGE`` keeps factors without cells (or in all cells) determined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.geo import grid_cell, grid_id
from gridwatch.operators.proximity import AMENITY_KINDS
from gridwatch.operators.spatial import proximity_join
from gridwatch.session import materialised

RIDGE = 1e-3
STEPS = 60
TOLERANCE = 1e-10


def cell_factors(fact: DataFrame, places: DataFrame, reach_m: float, deg: float) -> DataFrame:
    """(cell_y, cell_x, incidents, factors) of every cell that holds an incident or a place; ``factors`` has bit k for AMENITY_KINDS[k]."""
    cy, cx = grid_cell(F.col("lat"), F.col("lon"), deg)
    point = fact.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    counted = (point.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(cy.alias("cell_y"), cx.alias("cell_x"))
               .groupBy("cell_y", "cell_x").agg(F.count(F.lit(1)).alias("incidents")))
    kinds = places.filter(F.col("amenity_type").isin(*AMENITY_KINDS))
    cells = (counted.unionByName(places.select(cy.alias("cell_y"), cx.alias("cell_x"), F.lit(0).cast("long").alias("incidents")))
             .groupBy("cell_y", "cell_x").agg(F.sum("incidents").alias("incidents")))
    cells = materialised(cells, "terrain_cells")
    centres = cells.select("cell_y", "cell_x", ((F.col("cell_y") + 0.5) * deg).alias("lat"), ((F.col("cell_x") + 0.5) * deg).alias("lon"))
    bit = F.create_map(*(F.lit(x) for k, kind in enumerate(AMENITY_KINDS) for x in (kind, 1 << k)))
    near = (proximity_join(kinds.select("amenity_type", "lat", "lon"), centres, reach_m, ["amenity_type"], ["cell_y", "cell_x"])
            .groupBy(F.col("b_cell_y").alias("cell_y"), F.col("b_cell_x").alias("cell_x"))
            .agg(F.bit_or(bit[F.col("p_amenity_type")]).alias("factors")))
    return cells.join(near, ["cell_y", "cell_x"], "left").select("cell_y", "cell_x", "incidents", F.coalesce("factors", F.lit(0)).alias("factors"))


def factor_patterns(cells: DataFrame) -> DataFrame:
    """(factors, cells, incidents): one row per combination of factors."""
    return cells.groupBy("factors").agg(F.count(F.lit(1)).alias("cells"), F.sum("incidents").alias("incidents"))


def fit(patterns: DataFrame, factors: int = len(AMENITY_KINDS)) -> np.ndarray:
    """Constant and weights by Newton steps; each reads the patterns in one aggregate."""
    size = factors + 1
    x = [F.lit(1.0), *((F.shiftright("factors", k) % 2).cast("double") for k in range(factors))]
    total = patterns.agg(F.sum("cells"), F.sum("incidents")).head()
    weights = np.zeros(size)
    if not total[0] or not total[1]:
        return weights
    weights[0] = np.log(total[1] / total[0])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(STEPS):
        score = sum((F.lit(float(w)) * c for w, c in zip(weights, x, strict=True)), F.lit(0.0))
        mean = F.col("cells") * F.exp(F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0)))
        row = (patterns.withColumn("mean", mean)
               .agg(*(F.sum(F.col("mean") * x[i] * x[j]) for i, j in pairs), *(F.sum((F.col("incidents") - F.col("mean")) * c) for c in x)).head())
        system = np.zeros((size, size))
        for (i, j), v in zip(pairs, row, strict=False):
            system[i, j] = system[j, i] = v
        ridge = np.append(0.0, np.full(factors, RIDGE))
        step = np.linalg.solve(system + np.diag(ridge) + 1e-12 * np.eye(size), np.array(row[len(pairs):]) - ridge * weights)
        # A Poisson likelihood is flat far out: long steps are shortened.
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        weights = weights + step
        if np.abs(step).max() < TOLERANCE:
            break
    return weights


def rtm_weights(cells: DataFrame) -> DataFrame:
    """(factor, weight, relative_risk, cells, incidents) for the constant and each amenity kind."""
    spark = cells.sparkSession
    patterns = materialised(factor_patterns(cells), "terrain_patterns")
    weights = fit(patterns)
    has = lambda k: F.shiftright("factors", k) % 2 == 1
    row = patterns.agg(F.sum("cells"), F.sum("incidents"), *(
        F.sum(F.when(has(k), F.col(c)).otherwise(0)) for k in range(len(AMENITY_KINDS)) for c in ("cells", "incidents"))).head()
    rows = [(name, round(float(w), 6), round(float(np.exp(w)), 6), int(row[2 * i] or 0), int(row[2 * i + 1] or 0))
            for i, (name, w) in enumerate(zip(["constant", *AMENITY_KINDS], weights, strict=True))]
    return spark.createDataFrame(rows, "factor string, weight double, relative_risk double, cells long, incidents long")


def rtm_scores(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(grid_id, risk_score): each cell's modelled rate relative to the riskiest combination of factors that occurs."""
    known = {r.factor: r.weight for r in weights.collect()}  # eleven rows
    rate = F.exp(sum((F.lit(known[kind]) * (F.shiftright("factors", k) % 2) for k, kind in enumerate(AMENITY_KINDS)), F.lit(0.0)))
    rated = cells.withColumn("rate", rate)
    return rated.select(grid_id(F.col("cell_y"), F.col("cell_x")).alias("grid_id"), (F.col("rate") / rated.agg(F.max("rate")).scalar()).alias("risk_score"))
