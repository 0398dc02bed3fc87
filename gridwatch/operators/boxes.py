"""Small space-time cells of incidents, and pairs of cells told apart by the boxes around their incidents.

A cell's diagonal is shorter than the radius and its duration not longer than the time reach, so incidents of one cell are
all NEAR each other.  For two cells, the boxes around their incidents decide: farthest corners in reach, every pair of
incidents is NEAR (``inside``); nearest sides out of reach, none is; in between, points must be compared, and only those in
reach of the other box (``rim_points``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.geo import EARTH_RADIUS_M, haversine_m
from gridwatch.operators.proximity import DAY_US, epoch_us
from gridwatch.operators.spatial import proximity_join, tiles
from gridwatch.session import materialised

AXES = ("x", "y", "z")
KEYS = ["c_x", "c_y", "c_z", "c_t"]
#: Squares of a tile in ``near_counts`` along the radius.
SQUARES = 8
BOX = [f"{m}_{a}" for a in (*AXES, "t") for m in ("min", "max")]


def chord(radius_m: float) -> float:
    """Straight-line distance, on the unit sphere, of points ``radius_m`` apart."""
    return 2.0 * math.sin(radius_m / (2.0 * EARTH_RADIUS_M))


def points(fact: DataFrame, radius_m: float, days: float, parts: int = 1) -> DataFrame:
    """Incidents with place, time, unit vector and cell; rows without a point or a date dropped.

    ``parts`` cuts each side of a cell: more cells, of which fewer are undecided.
    """
    side = chord(radius_m) / math.sqrt(3.0) * (1.0 - 1e-6) / parts
    phi, lam = F.radians("lat"), F.radians("lon")
    return (fact.filter(F.col("offense_date").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), epoch_us(F.col("offense_date")).alias("t_us"))
            .withColumns({"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)})
            .select("*", *(F.floor(F.col(a) / side).cast("long").alias(f"c_{a}") for a in AXES),
                    F.floor(F.col("t_us") / (days * DAY_US / parts)).cast("long").alias("c_t")))


def cells(base: DataFrame) -> DataFrame:
    """One row per cell: its keys, n, node (its smallest id) and box."""
    box = [f(c).alias(f"{n}_{a}") for a, c in (*((a, a) for a in AXES), ("t", "t_us")) for n, f in (("min", F.min), ("max", F.max))]
    return base.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("node"), *box)


def _farthest(axis: str) -> Column:
    return F.greatest(F.abs(F.col(f"a_max_{axis}") - F.col(f"b_min_{axis}")), F.abs(F.col(f"b_max_{axis}") - F.col(f"a_min_{axis}")))


def _nearest(axis: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"a_min_{axis}") - F.col(f"b_max_{axis}"), F.col(f"b_min_{axis}") - F.col(f"a_max_{axis}"))


def _square(of) -> Column:
    x, y, z = (of(a) * of(a) for a in AXES)
    return x + y + z


def cell_pairs(found: DataFrame, radius_m: float, days: float) -> DataFrame:
    """(a_node, b_node, a_n, b_n, inside, both boxes) of cells that may hold NEAR incidents; a_node < b_node."""
    limit, reach = chord(radius_m) ** 2, days * DAY_US
    mid = {a: (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in (*AXES, "t")}
    centres = found.withColumns({
        "lat": F.degrees(F.atan2(mid["z"], F.sqrt(mid["x"] * mid["x"] + mid["y"] * mid["y"]))),
        "lon": F.degrees(F.atan2(mid["y"], mid["x"])), "t_mid": mid["t"]})
    columns = ["node", "n", *BOX]
    # A box is not longer than the radius, so centres of cells with NEAR incidents are within twice the reach.
    near = proximity_join(centres, centres, 2.02 * radius_m, columns, columns, extra=[("t_mid", 2.0 * reach)], strict=False)
    return (near.filter(F.col("p_node") < F.col("b_node"))
            .withColumnsRenamed({f"p_{c}": f"a_{c}" for c in columns})
            .filter((_square(_nearest) <= limit * (1 + 1e-9)) & (_nearest("t") <= reach))
            .withColumn("inside", (_square(_farthest) < limit * (1 - 1e-9)) & (_farthest("t") <= reach))
            .select("a_node", "b_node", "a_n", "b_n", "inside", *(f"{s}_{b}" for s in "ab" for b in BOX)))


def rim_points(pairs: DataFrame, at: DataFrame, side: str, radius_m: float, days: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a_node, b_node, <side>_lat, _lon, _t, carried): one side's points of the undecided pairs, if in reach of the other box.

    ``at``: node, x, y, z, t_us, lat, lon of the points and the columns to carry.
    """
    limit, reach, other = chord(radius_m) ** 2, days * DAY_US, "b" if side == "a" else "a"
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"{other}_min_{a}") - F.col(a), F.col(a) - F.col(f"{other}_max_{a}"))
    rim = pairs.filter(~F.col("inside")).select("a_node", "b_node", *(f"{other}_{b}" for b in BOX))
    mine = at.select(F.col("node").alias("_n"), *AXES, F.col("t_us").alias("t"), "lat", "lon", *carry)
    return (rim.join(mine, F.col(f"{side}_node") == F.col("_n"))
            .filter((_square(gap) <= limit * (1 + 1e-9)) & (gap("t") <= reach))
            .select("a_node", "b_node", *(F.col(c).alias(f"{side}_{c}") for c in ("lat", "lon", "t", *carry))))


def rim_test(radius_m: float, days: float) -> Column:
    """Whether an a-point and a b-point are NEAR."""
    return (F.abs(F.col("a_t") - F.col("b_t")) <= days * DAY_US) & (
        haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) < radius_m)


def tile_counts(radius_m: float, days: float):
    """For ``applyInArrow``: (id, near_incidents) of a tile's own incidents, from all incidents in reach of the tile.

    The tile's places are taken by small squares.  Other places lie wholly in reach of a square, out of reach, or at
    its rim; only rim places are measured, once for each place of the square.  What is in reach is then counted by its sorted
    times.  So the work follows incidents and places, not the pairs of incidents.
    """
    limit, reach, side = chord(radius_m) ** 2, math.floor(days * DAY_US), chord(radius_m) / SQUARES

    def between(times: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(times, at + reach, "right") - np.searchsorted(times, at - reach, "left")

    def run(tile: pa.Table) -> pa.Table:
        own = tile.column("own").to_numpy()
        if not own.any():
            return pa.table({"id": tile.column("id").slice(0, 0), "near_incidents": pa.array([], pa.int64())})
        t = tile.column("t_us").to_numpy()
        spots, of = np.unique(tile.column("lat").to_numpy() + 1j * tile.column("lon").to_numpy(), return_inverse=True)
        phi, lam = np.radians(spots.real), np.radians(spots.imag)
        cphi = np.cos(phi)
        xyz = np.stack([cphi * np.cos(lam), cphi * np.sin(lam), np.sin(phi)])
        by_time = np.argsort(t, kind="stable")
        times, place = t[by_time], of[by_time]

        # Own incidents by square and place.
        square = np.floor(xyz / side).astype(np.int64)
        rows = np.flatnonzero(own)
        rows = rows[np.lexsort((of[rows], *square[:, of[rows]]))]
        at, when = of[rows], t[rows]
        counts = np.empty(len(rows), np.int64)
        new_place = np.flatnonzero(np.diff(at, prepend=-1))
        new_square = new_place[np.concatenate([[True], (np.diff(square[:, at[new_place]]) != 0).any(axis=0)])]
        ends = dict(zip(new_place, [*new_place[1:], len(rows)], strict=True))
        for first, last in zip(new_square, [*new_square[1:], len(rows)], strict=True):
            firsts = new_place[np.searchsorted(new_place, first):np.searchsorted(new_place, last)]
            mine = xyz[:, at[firsts]]
            low, high = mine.min(axis=1)[:, None], mine.max(axis=1)[:, None]
            whole = (np.maximum(np.abs(xyz - low), np.abs(high - xyz)) ** 2).sum(axis=0) < limit * (1 - 1e-9)
            rim = ~whole & ((np.maximum(0.0, np.maximum(low - xyz, xyz - high)) ** 2).sum(axis=0) <= limit * (1 + 1e-9))
            # The incident itself lies in its square, which is wholly in reach.
            counts[first:last] = between(times[whole[place]], when[first:last]) - 1
            if not rim.any():
                continue
            rim_rows, rim_places, met = np.flatnonzero(rim[place]), np.flatnonzero(rim), np.zeros(len(spots), bool)
            rim_times, rim_place = times[rim_rows], place[rim_rows]
            for f in firsts:
                p = at[f]
                a = (np.sin(np.radians(spots.real[rim_places] - spots.real[p]) / 2) ** 2
                     + cphi[p] * cphi[rim_places] * np.sin(np.radians(spots.imag[rim_places] - spots.imag[p]) / 2) ** 2)
                met[rim_places] = 2.0 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, a))) < radius_m
                counts[f:ends[f]] += between(rim_times[met[rim_place]], when[f:ends[f]])
        found = counts > 0
        return pa.table({"id": tile.column("id").take(pa.array(rows[found])), "near_incidents": pa.array(counts[found])})

    return run


def near_counts(fact: DataFrame, radius_m: float, days: float) -> DataFrame:
    """(id, near_incidents): how many incidents are NEAR each, without listing or comparing the pairs.

    Incidents are dealt to space-time tiles, twice the radius and the time reach wide, and copied to the tiles in their reach;
    ``tile_counts`` counts each tile.  Incidents without a neighbour have no row.
    """
    base = (fact.filter(F.col("offense_date").isNotNull())
            .select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), epoch_us(F.col("offense_date")).alias("t_us")))
    dealt = tiles(base, radius_m, [("t_us", float(days) * DAY_US)])
    return (dealt.select(*(f"k_{i}" for i in range(4)), F.when(F.col("own"), F.col("id")).alias("id"), "lat", "lon", "t_us", "own")
            .groupBy(*(f"k_{i}" for i in range(4)))
            .applyInArrow(tile_counts(radius_m, days), f"id {fact.schema['id'].dataType.simpleString()}, near_incidents long"))


def candidate_rows(fact: DataFrame, radius_m: float, days: float, parts: int = 2) -> dict[str, int]:
    """What a count by pairs of cells looks at: cells, cell pairs by kind and point comparisons (for reports)."""
    base = materialised(points(fact, radius_m, days, parts), "points")
    found = materialised(cells(base), "cells")
    pairs = materialised(cell_pairs(found, radius_m, days), "cell_pairs")
    marked = base.join(found.select(*KEYS, "node"), KEYS).drop(*KEYS)
    sides = [rim_points(pairs, marked, side, radius_m, days) for side in "ab"]
    return {"cells": found.count(), "cell_pairs": pairs.count(), "inside": pairs.filter("inside").count(),
            "compared": sides[0].join(sides[1], ["a_node", "b_node"]).count()}
