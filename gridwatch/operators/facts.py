"""Fact-table semantics: first-wins per id, last-wins attributes, insert-if-absent.

First/last by arrival need an explicit order: ``seq`` (topic offset, file row
order).  They are computed with ``min_by`` / ``max_by`` over a struct rather
than ``row_number()`` over a window: the aggregate is partial (map-side), so an
id replayed a billion times collapses to one row per map task before the
shuffle, while a window would sort the whole hot group in one task.  The struct
keeps NULL fields of the winning row as they are (a per-column min_by would
skip them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.operators.clean import has_key
from gridwatch.schema import FACT_COLUMNS


def pick_by_seq(df: DataFrame, keys: list[str], cols: list[str], last: bool = False,
                seq: str = "seq") -> DataFrame:
    """One row per key: the columns of the first (or last) row by ``seq``."""
    pick = F.max_by if last else F.min_by
    others = [c for c in cols if c not in keys]
    w = pick(F.struct(*[F.col(c) for c in others]), F.col(seq)).alias("_w")
    return df.groupBy(*keys).agg(w).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in others])


def fact_first_wins(typed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Insert-once fact table: the first row per id (``ON CONFLICT DO NOTHING``).

    ``columns`` limits the carried columns: the struct inside ``min_by`` is
    not pruned by the optimizer, so a consumer that needs three columns
    should not drag all of them through the shuffle.
    """
    cols = columns if columns is not None else FACT_COLUMNS + ["seq"]
    cols = ["id"] + [c for c in cols if c != "id"]
    return pick_by_seq(has_key(typed), ["id"], cols)


def incident_last_wins(typed: DataFrame) -> DataFrame:
    """Incident node: type/description of the last row per id (``MERGE ... SET``)."""
    return (pick_by_seq(has_key(typed), ["id"], ["id", "incident_type", "description"], last=True)
            .withColumnRenamed("id", "case_id"))


def nth_seq(typed: DataFrame, n: int, seq: str = "seq", buckets: int = 4096):
    """The ``n``-th smallest ``seq`` (None when there are fewer rows), by counting ever narrower ranges.

    Each pass counts rows per range of ``seq`` (at most ``buckets`` rows reach the driver) and
    descends into the range that holds the n-th row, so nothing is sorted and no task
    sees more than its share.  Ties of ``seq`` are taken together.
    """
    ends = typed.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count(seq).alias("n")).first()
    if ends["n"] <= n or n <= 0:
        return None
    lo, hi, left = ends["lo"], ends["hi"], n
    while lo < hi:
        width = (hi - lo) // buckets + 1
        part = F.expr(f"(`{seq}` - {lo}L) div {width}")
        counts = (typed.filter(F.col(seq).between(lo, hi)).groupBy(part.alias("part")).count()
                  .orderBy("part").collect())
        for row in counts:
            if left <= row["count"]:
                lo, hi = lo + row["part"] * width, min(hi, lo + (row["part"] + 1) * width - 1)
                break
            left -= row["count"]
    return lo


def snapshot_limit(typed: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` rows by ``seq`` (rows that tie with the n-th stay), as a filter; no sort."""
    cut = nth_seq(typed, n, seq)
    return typed if cut is None else typed.filter(F.col(seq) <= cut)


def beyond_limit(typed: DataFrame, n: int, seq: str = "seq") -> int:
    """How many rows ``snapshot_limit`` drops."""
    cut = nth_seq(typed, n, seq)
    return 0 if cut is None else typed.filter(F.col(seq) > cut).count()


def history_by_date(fact: DataFrame, day: str) -> DataFrame:
    """Incidents on one calendar date, with coordinates (half-open day range).

    A range on the stored ``offense_date`` (not a function of it), so a table
    partitioned or sorted by date prunes partitions / row groups.
    """
    start = F.lit(day).cast("timestamp_ntz")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    return (fact.filter((F.col("offense_date") >= start) & (F.col("offense_date") < end))
            .select("id", "incident_type", "offense_date", "latitude", "longitude", "address"))
