"""Distance joins (incident-place, incident-incident, radius) and grid counts.

Catalyst has no spatial index, and a distance predicate alone plans as a
nested-loop (Cartesian) join.  ``proximity_join`` rewrites it to an equi join
on cell keys plus the exact distance as a residual:

* Points map to their unit vector (x, y, z) on the sphere and to cube cells
  of edge ``s = 2 r'`` where ``r' = radius / R`` (plus 1% margin).  Two points
  closer than ``radius`` differ by less than ``r'`` in every coordinate.
* The *build* side stays in its own cell.  Each *probe* point is copied to
  its own cell and, per dimension, to the one neighbour on the side it is
  nearer to (the ball of radius r' around it reaches at most that neighbour,
  because the cell is twice as wide).  So a probe row is copied at most 8
  times (27 for the usual 3x3x3 scheme), and every true pair meets exactly once.  Copies whose cell is
  out of reach of the point, or nowhere on the sphere, are left out (about a third).
* No lat/lon band width is involved, so the scheme is exact at any latitude,
  across the antimeridian and at the poles, and needs no pass over the data.
* Extra 1-D dimensions (a time axis) use the same half-cell rule.
* For a self join, copies that go to a cell ordered before the probe's own
  cell are dropped: that pair is met from the other side.  This halves the
  copies; pairs are then normalised to ``a < b``.

The equi join shuffles both sides on the cell keys (a hash and one long per dimension), and AQE splits a hot cell's partition when
one cell holds much of the data.  A candidate pair costs three differences of unit vectors; the exact distance is
computed for pairs that are returned, and decides those within a millionth of the radius.  Where both sides grow with the input (``large``, and every self join) neither
is ever broadcast: the planner's estimate comes from compressed files, before rows are copied to neighbour
cells, and may be a hundredth of what the driver would have to hold.  Elsewhere the size decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.geo import EARTH_RADIUS_M, grid_cell, grid_id, haversine_m

MARGIN = 1.01


@dataclass(frozen=True)
class Axis:
    """An extra join dimension: ``value`` within ``reach`` (same units) of each other."""
    name: str
    value: Column
    reach: float


def _unit_vector(lat: Column, lon: Column) -> list[Column]:
    phi, lmb = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lmb), F.cos(phi) * F.sin(lmb), F.sin(phi)]


def _axes(lat: Column, lon: Column, radius_m: float, extra: list[Axis]) -> list[tuple[Column, float]]:
    """(coordinate, reach) per dimension, reach already including the margin."""
    r = radius_m / EARTH_RADIUS_M * MARGIN
    dims = [(c, r) for c in _unit_vector(lat, lon)]
    dims += [(a.value.cast("double"), a.reach * MARGIN) for a in extra]
    return dims


def _cell_keys(df: DataFrame, dims: list[tuple[Column, float]], probe: bool, self_join: bool) -> DataFrame:
    """Add the cell ``k_<i>`` of each row; probe rows are copied to the neighbour cells in reach (``moved`` for a self join).

    Every step has columns of its own, so that a coordinate is computed once per row and no generated method
    is too large to be compiled.
    """
    columns, n = df.columns, len(dims)
    df = df.withColumns({f"_u{i}": c / F.lit(2.0 * reach) for i, (c, reach) in enumerate(dims)})
    df = df.withColumns({f"_h{i}": F.floor(f"_u{i}").cast("long") for i in range(n)})
    if not probe:
        return df.select(*columns, *(F.col(f"_h{i}").alias(f"k_{i}") for i in range(n)))
    df = df.withColumns({f"_f{i}": F.col(f"_u{i}") - F.col(f"_h{i}") for i in range(n)})
    # The ball [u - 1/2, u + 1/2] (in cell units) reaches the lower neighbour when the fraction is < 1/2, otherwise
    # the upper one; never both.  A copy is of use only if the point is in reach of its cell (squared gaps, reach 1/2).
    df = df.select(*columns, *(f"_h{i}" for i in range(n)), *(F.when(F.col(f"_f{i}") < 0.5, -1).otherwise(1).alias(f"_o{i}") for i in range(n)),
                   *(F.pow(F.least(F.col(f"_f{i}"), 1.0 - F.col(f"_f{i}")), F.lit(2.0)).alias(f"_g{i}") for i in range(3)))
    # The 2^n choices of (stay, move to the near neighbour) per dimension.
    moves = F.array(*(F.struct(*(F.lit(m >> i & 1).alias(f"_m{i}") for i in range(n))) for m in range(1 << n)))
    df = df.withColumn("_m", F.explode(moves)).select("*", "_m.*").filter("_g0 * _m0 + _g1 * _m1 + _g2 * _m2 <= 0.25")
    if self_join:
        # Keep only copies to cells ordered at or after the home cell (the first move goes up); the
        # home cell is kept for the same-cell tie-break in the caller.
        upward = F.lit(True)
        for i in reversed(range(n)):
            upward = F.when(F.col(f"_m{i}") == 1, F.col(f"_o{i}") > 0).otherwise(upward)
        df = df.filter(upward)
    keys = {f"k_{i}": F.col(f"_h{i}") + F.col(f"_o{i}") * F.col(f"_m{i}") for i in range(n)}
    moved = F.expr(" + ".join(f"_m{i}" for i in range(n)) + " > 0")
    df = df.select(*columns, *(k.alias(name) for name, k in keys.items()), moved.alias("moved"))
    # Points lie on the unit sphere, so cells apart from it have no points of their own.
    middle = [(F.abs((F.col(f"k_{i}") + 0.5) * F.lit(2.0 * reach)), reach) for i, (_, reach) in enumerate(dims[:3])]
    inner = sum((F.pow(F.greatest(F.lit(0.0), c - F.lit(reach)), F.lit(2.0)) for c, reach in middle), F.lit(0.0))
    outer = sum((F.pow(c + F.lit(reach), F.lit(2.0)) for c, reach in middle), F.lit(0.0))
    return df.filter((inner <= 1.0 + 1e-9) & (outer >= 1.0 - 1e-9))


def _with_vector(df: DataFrame, prefix: str) -> DataFrame:
    """Per-point unit vector, computed once per row instead of per candidate."""
    vector = _unit_vector(F.col(prefix + "lat"), F.col(prefix + "lon"))
    return df.withColumns({f"{prefix}{axis}": c for axis, c in zip("xyz", vector, strict=True)})


def _same_cell(n: int) -> list[Column]:
    """Join keys: a hash of the cell, by which rows are sorted quickly, and the cell itself."""
    keys = [[F.col(f"{side}_k{i}") for i in range(n)] for side in "pb"]
    return [F.xxhash64(*keys[0]) == F.xxhash64(*keys[1]), *(p == b for p, b in zip(*keys, strict=True))]


def _near_enough(radius_m: float, exact: Column) -> Column:
    """Whether a pair is in reach; ``exact`` (a test of the exact distance) is asked only near the radius.

    The squared chord between the unit vectors decides all other pairs.  Its rounding is below 1e-14, and the
    margins are 1e-6 of the chord and 1e-14, so no pair is decided unlike the exact distance would.
    """
    import math

    chord = 2.0 * math.sin(radius_m / (2.0 * EARTH_RADIUS_M))
    least, most = max(0.0, chord * (1.0 - 1e-6) - 1e-14), chord * (1.0 + 1e-6) + 1e-14
    gaps = [F.col(f"b_{axis}") - F.col(f"p_{axis}") for axis in "xyz"]
    squared = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    return (squared < most * most) & ((squared < least * least) | exact)


def proximity_join(probe: DataFrame, build: DataFrame, radius_m: float,
                   probe_cols: list[str], build_cols: list[str],
                   lat: str = "lat", lon: str = "lon",
                   extra: list[tuple[str, float]] | None = None,
                   strict: bool = True, large: bool = False) -> DataFrame:
    """All (probe, build) pairs closer than ``radius_m`` metres (and within each extra reach).

    ``probe`` / ``build`` need columns ``lat``, ``lon`` (non-NULL rows only are
    matched) and any extra axis columns.  Output: ``p_<probe col>``,
    ``b_<build col>``, their ``lat``/``lon`` and ``distance_m``.
    Put the smaller input on the probe side: it is the one copied.  ``large``: both sides grow with the
    input, so they are shuffled and merged, never broadcast.
    """
    extra = extra or []

    def prep(df: DataFrame, cols: list[str], prefix: str, is_probe: bool) -> DataFrame:
        keep = [F.col(c).alias(prefix + c) for c in cols]
        base = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
            *keep, F.col(lat).alias(prefix + "lat"), F.col(lon).alias(prefix + "lon"),
            *[F.col(n).alias(prefix + n) for n, _ in extra])
        dims = _axes(F.col(prefix + "lat"), F.col(prefix + "lon"), radius_m,
                     [Axis(n, F.col(prefix + n), reach) for n, reach in extra])
        keyed = _cell_keys(base, dims, probe=is_probe, self_join=False).drop("moved")
        return _with_vector(keyed.withColumnsRenamed({f"k_{i}": f"{prefix}k{i}" for i in range(len(dims))}), prefix)

    p = prep(probe, probe_cols, "p_", True)
    b = prep(build, build_cols, "b_", False)
    n = 3 + len(extra)
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("b_lat"), F.col("b_lon"))
    # Cheap tests first (conjuncts are evaluated in order): extra axes, then the chord.
    cond = F.lit(True)
    for name, reach in extra:
        cond = cond & (F.abs(F.col("p_" + name) - F.col("b_" + name)) <= reach)
    cond = cond & _near_enough(radius_m, (dist < radius_m) if strict else (dist <= radius_m))
    helpers = [f"{side}_{c}" for side in "pb" for c in ("x", "y", "z", *(f"k{i}" for i in range(n)))]
    return (p.join(shuffled(b) if large else b, _same_cell(n)).filter(cond).withColumn("distance_m", dist)
            .drop(*helpers))


def tiles(df: DataFrame, radius_m: float, extra: list[tuple[str, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point in the tile it lies in (``own``) and copied to the neighbour tiles it may reach; ``k_<i>``: the tile's keys.

    All points closer than ``radius_m`` (and within each extra reach) to a tile's own points are in the tile.  Tiles and
    copies are those of ``proximity_join``; coordinates are columns of their own, so each is computed once per point.
    """
    dims = _axes(F.col(lat), F.col(lon), radius_m, [Axis(n, F.col(n), reach) for n, reach in extra])
    copies = _cell_keys(df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), dims, probe=True, self_join=False)
    return copies.select(*df.columns, (~F.col("moved")).alias("own"), *(f"k_{i}" for i in range(len(dims))))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join in which no side is broadcast."""
    return df.hint("merge")


def self_join_sides(df: DataFrame, key: str, radius_m: float,
                    extra: list[tuple[str, float]] | None = None,
                    lat: str = "lat", lon: str = "lon", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[Column], Column]:
    """Probe side, build side, join keys and residual condition of a self proximity join."""
    extra = extra or []
    base = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(key).alias("_id"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"),
        *[F.col(n).alias("_x_" + n) for n, _ in extra], *[F.col(c).alias("_c_" + c) for c in carry or []])
    dims = _axes(F.col("_lat"), F.col("_lon"), radius_m,
                 [Axis(n, F.col("_x_" + n), reach) for n, reach in extra])
    names = {f"k_{i}": f"_k{i}" for i in range(len(dims))} | {"moved": "_moved"}
    p, b = (_cell_keys(base, dims, probe, self_join=True).withColumnsRenamed(names) for probe in (True, False))
    p = _with_vector(p.select(*[F.col(c).alias("p" + c) for c in p.columns]), "p_")
    b = _with_vector(b.select(*[F.col(c).alias("b" + c) for c in b.columns]), "b_")
    # Pairs in different home cells are met once (from the lower cell); pairs
    # sharing a home cell are met from both sides, so keep p_id < b_id there.
    # Cheap tests run before the exact distance.
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("b_lat"), F.col("b_lon"))
    cond = F.lit(True)
    for n, reach in extra:
        cond = cond & (F.abs(F.col("p_x_" + n) - F.col("b_x_" + n)) <= reach)
    cond = cond & _near_enough(radius_m, dist < radius_m)
    cond = cond & (F.col("p_moved") | (F.col("p_id") < F.col("b_id")))
    return p, b, _same_cell(len(dims)), cond


def self_pairs_output(j: DataFrame, key: str, extra: list[tuple[str, float]] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Normalise joined (probe, build) rows to (a_key < b_key, distance_m, a_/b_ extras and carried columns)."""
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("b_lat"), F.col("b_lon"))
    a_first = F.col("p_id") < F.col("b_id")
    cols = [F.when(a_first, F.col("p_id")).otherwise(F.col("b_id")).alias("a_" + key),
            F.when(a_first, F.col("b_id")).otherwise(F.col("p_id")).alias("b_" + key),
            dist.alias("distance_m")]
    for at, n in [("x", n) for n, _ in extra or []] + [("c", n) for n in carry or []]:
        cols += [F.when(a_first, F.col(f"p_{at}_{n}")).otherwise(F.col(f"b_{at}_{n}")).alias("a_" + n),
                 F.when(a_first, F.col(f"b_{at}_{n}")).otherwise(F.col(f"p_{at}_{n}")).alias("b_" + n)]
    return j.select(*cols)


def self_proximity_join(df: DataFrame, key: str, radius_m: float,
                        extra: list[tuple[str, float]] | None = None,
                        lat: str = "lat", lon: str = "lon", carry: list[str] | None = None) -> DataFrame:
    """Unordered pairs (a_key < b_key) of rows of ``df`` within the radius (and extra reaches).

    Output: ``a_<key>``, ``b_<key>``, ``distance_m`` (+ ``a_/b_`` extra axis values and ``carry`` columns).
    """
    p, b, keys, cond = self_join_sides(df, key, radius_m, extra, lat, lon, carry)
    return self_pairs_output(p.join(shuffled(b), keys).filter(cond), key, extra, carry)


def grid_counts(points: DataFrame, deg: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Incidents per square grid cell: (grid_id, cell_y, cell_x, incidents)."""
    cy, cx = grid_cell(F.col(lat), F.col(lon), deg)
    return (points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .select(cy.alias("cell_y"), cx.alias("cell_x"))
            .groupBy("cell_y", "cell_x").agg(F.count(F.lit(1)).alias("incidents"))
            .withColumn("grid_id", grid_id(F.col("cell_y"), F.col("cell_x"))))
