"""Sharding by balanced label propagation.

Documents of one link key (by default: equal texts) are linked.  Every document starts in a
random shard.  In each round, written to the shared folder, the members' shards are
counted per group (a histogram, pre-aggregated, so a group of a third of all rows is
at most ``shards`` rows); the group's largest part draws the others.  Moves are counted per pair of
shards, and a shard takes as many as leave it and as its quota has room for, chosen by a
hash: whole groups, or single rows where a group is larger than a share of a shard.  So full shards
exchange rows.  Where that moves little, shards may exceed their quota, more from round to
round.  A group larger than a shard is drawn together outside the quotas.  Rounds end when
nobody wants to move: then every group is in one shard.

At last all documents are put in one order (shard; unlinked documents at both ends; group)
by a range sort, numbered without gaps, and cut into equal counts: law ``rows``.  Unlinked
documents are dealt to the shards that have room, so the cuts fall among them; if there are too few,
a cut may fall into a group, so at most ``shards`` - 1 groups that fit a shard are split.

Defined results: null text counts as empty; a null id is placed like any other; repeated
rows are placed one by one and are linked; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import staged

SHARDS = 8
#: A shard's rows over its quota at first, as a part of the quota.
EXCESS = 0.001
#: Groups larger than this part of a shard move row by row.
LARGE = 1 / 64
#: Tasks over which the rows of a large group are spread in a join.
SALTS = 64


def chance(*columns):
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def case(column, values: dict, default):
    """A column's value looked up in a small dict."""
    out = None
    for k, v in sorted(values.items()):
        out = (F if out is None else out).when(column == k, v)
    return F.lit(default) if out is None else out.otherwise(default)


def accepted(wanted: dict, room: list[float]) -> dict:
    """Of the rows that want from one shard to another, how many may move: {(from, to): rows}.

    A shard takes what leaves it and what room it has; its flows in are cut in proportion until that holds everywhere.
    """
    flow = {k: float(n) for k, n in wanted.items()}
    for _ in range(1000):
        settled = True
        for s, free in enumerate(room):
            into = sum(n for (_, to), n in flow.items() if to == s)
            limit = free + sum(n for (at, _), n in flow.items() if at == s)
            if into > limit * (1 + 1e-6):
                settled = False
                flow = {k: n * limit / into if k[1] == s else n for k, n in flow.items()}
        if settled:
            break
    return flow


def propagate(linked: DataFrame, quota: int, shards: int) -> DataFrame:
    """Rows (uid, g1, g2, members, label) with every group in one shard.

    Only the best part of a group grows, so a row moves at most once.  A round moves a quarter of
    the rows that want to, or the excess allowed is raised: the rounds end at any size.
    """
    large, pieces = F.col("members") > quota * LARGE, F.lit(SALTS)
    huge = F.col("members") > quota
    excess = max(1.0, quota * EXCESS)
    for turn in count():
        # A group's parts: at most one entry per shard.
        parts = (linked.groupBy("g1", "g2", "label").agg(F.count("*").alias("part"))
                 .groupBy("g1", "g2").agg(F.collect_list(F.struct("part", F.xxhash64("g1", "label").alias("tie"), "label")).alias("parts"))
                 .filter(F.size("parts") > 1)
                 .withColumn("members", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["part"]))
                 .withColumn("best", F.array_max("parts")["label"]))
        # The rows of a large group are joined over several tasks.
        parts = (parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(large, pieces - 1).otherwise(0))))
                 .select("g1", "g2", "salt", "best"))
        salt = F.when(large, F.pmod(F.xxhash64("uid"), pieces).cast("int")).otherwise(0)
        wished = (linked.withColumn("salt", salt).join(parts, ["g1", "g2", "salt"], "left").drop("salt")
                  .withColumn("wants", F.coalesce(F.col("best") != F.col("label"), F.lit(False))))
        sizes, demand, free = [0] * shards, {}, 0
        for r in wished.groupBy("label", "best", "wants", huge.alias("huge")).count().collect():
            if r.huge:
                free += r["count"] * r.wants
            else:
                sizes[r.label] += r["count"]
                if r.wants:
                    demand[r.label, r.best] = r["count"]
        if not demand and not free:
            return linked
        flow = accepted(demand, [max(0, quota - n) + excess for n in sizes])
        taken = {at * shards + to: min(1.0, flow[at, to] / n) for (at, to), n in demand.items()}
        if sum(flow.values()) < sum(demand.values()) / 4:
            excess *= 4
        drawn = F.when(large, chance("uid", F.lit(turn))).otherwise(chance("g1", "g2", F.lit(turn)))
        moves = F.col("wants") & (huge | (drawn < case(F.col("label") * shards + F.col("best"), taken, 0.0)))
        linked = staged(wished.withColumn("label", F.when(moves, F.col("best")).otherwise(F.col("label"))).drop("best", "wants"), "labels")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position``: 0, 1, 2, ... in the given total order, by a range sort.

    The offsets are one row per partition of the sort, so they may be broadcast.
    """
    spark = rows.sparkSession
    at = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("__at", 33)
    total, offsets = 0, []
    for r in at.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, total))
        total += r["count"]
    before = spark.createDataFrame(offsets, "__part long, __before long")
    return (at.withColumn("__part", part).join(F.broadcast(before), "__part")
            .withColumn("position", F.col("__before") + (F.col("__at") - F.shiftleft("__part", 33))).drop("__at", "__part", "__before"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", link_key=None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in the shard); counts differ by one at most.

    ``link_key``: a column of ``docs``; documents of equal keys are linked (default: the text).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = text if link_key is None else link_key
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(key).alias("g1"), F.xxhash64(F.lit(1), key).alias("g2"), F.monotonically_increasing_id().alias("uid")), "rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("members")).filter("members > 1")
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    linked = staged(rows.select("uid", "g1", "g2").join(groups, ["g1", "g2"]).withColumn("label", start), "labels")
    linked = propagate(linked, total // shards, shards)

    # Unlinked documents go where room is left, in proportion to it.
    sizes = {r.label: r["count"] for r in linked.groupBy("label").count().collect()}
    room = [max(0, total // shards + 1 - sizes.get(s, 0)) for s in range(shards)]
    bounds = {s: sum(room[:s + 1]) / max(1, sum(room)) for s in range(shards)}
    draw, free = chance("uid", F.lit(-1)), F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        free = F.when(draw < bounds[s], s).otherwise(free)
    placed = (rows.join(linked.select("uid", "label"), "uid", "left")
              .withColumn("place", F.when(F.col("label").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("uid", F.lit(-2)), F.lit(2)) * 2).cast("int"))
              .withColumn("label", F.coalesce("label", free)))
    shard = F.expr(f"int(position * {shards} div {total})")
    return (numbered(placed, ["label", "place", "g1", "g2", "uid"]).withColumn("shard", shard)
            .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}) div {shards}"))
            .select("doc_id", "size", "text_crc32", "shard", "slot"))


def sharding_query(docs: DataFrame) -> DataFrame:
    return balanced_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
