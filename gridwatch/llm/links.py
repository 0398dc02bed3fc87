"""Sharding of a general link graph: rows with several link keys each, by balanced label propagation.

``sharding.balanced_shards`` takes one key per row, so its graph is made of disjoint groups.  Here a table of links
(id, key) gives a row any number of keys; rows that share a key are neighbours (a plain edge is a key
of two rows, ``edge_links``).  The links of a key weigh 1 / (members - 1) each, so that a key held by a third of all
rows does not outvote the others; for plain edges that is the number of edges.

A round, as Spark joins: the members of every key are counted per shard (one row per key, ``shards`` numbers); every row adds up
the counts of its keys, without itself, and wants to go where most weight is; wishes are counted per pair of shards and granted as far as the
quotas have room, so full shards exchange rows; half of the granted moves are made, drawn by a hash, so that
two neighbours do not swap places for ever.  Rows of a large key meet its counts over several tasks.  Rounds end when nobody may move, or the weight
of cut links has not fallen by a hundredth in ``PATIENCE`` rounds; the best round's shards are taken.  Then
the shards are evened: those with too many rows give away unlinked ones first, then those with the least weight in the shard.  Both
steps run twice, the second time from the evened shards and with hardly any room over the quota.

Defined results: null ids and null keys link nothing; links of unknown ids are ignored, repeated links count once; all
rows of a repeated id have its links; without links the rows are dealt evenly; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import staged
from gridwatch.llm.sharding import SALTS, SHARDS, accepted, case, chance, numbered

#: Rounds without a cut better by a hundredth after which the rounds end.
PATIENCE = 4
#: A shard's rows over its quota in the rounds, as a part of the quota: first with room to move, then from evened
#: shards with hardly any, which mends what evening has cut.
SLACKS = (0.02, 0.001)
#: A key of more rows is met by its rows over several tasks.
LARGE_KEY = 100_000
#: Weight of a key: whole numbers, so that sums do not depend on the order of addition.
UNIT = 1 << 30


def edge_links(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links (id, key) of an edge table: every edge is a key of its two ends; direction, repeats and loops do not count."""
    ends = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    key = F.concat_ws("-", F.col("x").cast("string"), F.col("y").cast("string"))
    return ends.select(F.explode(F.array("x", "y")).alias("id"), key.alias("key"))


def key_counts(linked: DataFrame, shards: int) -> DataFrame:
    """(g1, g2, members, unit, c0 ... ): members of every key per shard; keys of one row are left out."""
    parts = linked.groupBy("g1", "g2").agg(
        F.count("*").alias("members"), *(F.sum((F.col("label") == s).cast("long")).alias(f"c{s}") for s in range(shards)))
    return parts.filter("members > 1").withColumn("unit", F.expr(f"{UNIT}L div (members - 1)"))


def cut_weight(parts: DataFrame, shards: int) -> tuple[int, int]:
    """Weight of all links and of the cut ones, in ``UNIT``."""
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    whole = pairs("members")
    inside = sum((pairs(f"c{s}") for s in range(1, shards)), pairs("c0"))
    # Decimal sums: exact at any size.
    weight = lambda n: F.sum((n.cast("decimal(20,0)") * F.col("unit").cast("decimal(12,0)")))
    r = parts.agg(weight(whole).alias("all"), weight(whole - inside).alias("cut")).first()
    return int(r["all"] or 0), int(r["cut"] or 0)


def wishes(linked: DataFrame, parts: DataFrame, shards: int) -> DataFrame:
    """(uid, label, own, best): the weight of a row's links in its shard, and where most weight is (``label`` if no shard has more)."""
    large, pieces = F.col("members") > LARGE_KEY, F.lit(SALTS)
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(large, pieces - 1).otherwise(0))))
    # A row's salt is looked up by trying both: 0 for small keys, its own piece for large ones.
    piece = F.pmod(F.xxhash64("uid"), pieces).cast("int")
    keys = linked.withColumn("salt", F.explode(F.array_distinct(F.array(F.lit(0), piece))))
    met = keys.join(parts, ["g1", "g2", "salt"]).filter(F.col("salt") == F.when(large, piece).otherwise(0))
    votes = met.groupBy("uid", "label").agg(*(
        F.sum((F.col(f"c{s}") - (F.col("label") == s).cast("long")) * F.col("unit")).alias(f"v{s}") for s in range(shards)))
    ranked = F.array_max(F.array(*(F.struct(
        F.col(f"v{s}").alias("votes"), (F.col("label") == s).alias("own"), F.xxhash64("uid", F.lit(s)).alias("tie"), F.lit(s).alias("at"))
        for s in range(shards))))
    return votes.select("uid", "label", case(F.col("label"), {s: F.col(f"v{s}") for s in range(shards)}, 0).alias("own"), ranked["at"].alias("best"))


def propagate_links(linked: DataFrame, sizes: list[int], quota: int, shards: int, slack: float) -> DataFrame:
    """(uid, label) after the rounds, from linked rows (uid, g1, g2, label); ``sizes``: linked rows per shard at first."""
    mark, best, stale, keys = None, None, 0, linked.drop("label")
    labels, excess = staged(linked.select("uid", "label").distinct(), "labels"), max(1.0, quota * slack)
    for turn in count():
        parts = staged(key_counts(linked, shards), "keys")
        _, cut = cut_weight(parts, shards)
        if best is None or cut < best[0]:
            best = cut, labels
        if mark is None or cut < mark * 0.99:
            mark, stale = cut, 0
        else:
            stale += 1
        wished = staged(wishes(linked, parts, shards), "wishes")
        demand = {(r.label, r.best): r["count"] for r in wished.filter("label != best").groupBy("label", "best").count().collect()}
        if not demand or not cut or stale >= PATIENCE:
            return best[1]
        flow = accepted(demand, [max(0, quota - n) + excess for n in sizes])
        taken = {at * shards + to: min(1.0, flow[at, to] / n) / 2 for (at, to), n in demand.items()}
        drawn = chance("uid", F.lit(turn)) < case(F.col("label") * shards + F.col("best"), taken, 0.0)
        moved = wished.select("uid", F.when(drawn & (F.col("label") != F.col("best")), F.col("best")).otherwise(F.col("label")).alias("now"))
        # A row whose keys are all its own has no wish and stays.
        labels = staged(labels.join(moved, "uid", "left").select("uid", F.coalesce("now", "label").alias("label")), "labels")
        linked = keys.join(labels, "uid")
        counted = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
        sizes = [counted.get(s, 0) for s in range(shards)]


def linked_shards(docs: DataFrame, links: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, shard, slot (gapless in the shard); counts differ by one at most.

    ``links``: (id, key), any number of rows per document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                              F.monotonically_increasing_id().alias("uid")), "rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    quota = total // shards
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    named = links.filter(F.col("id").isNotNull() & F.col("key").isNotNull()).select(
        F.col("id").alias("doc_id"), F.xxhash64("key").alias("g1"), F.xxhash64(F.lit(1), "key").alias("g2")).distinct()
    linked = staged(rows.select("doc_id", "uid").join(named, "doc_id").drop("doc_id").withColumn("label", start), "links")
    for slack in SLACKS:
        first = {r.label: r["count"] for r in linked.select("uid", "label").distinct().groupBy("label").count().collect()}
        labels = propagate_links(linked, [first.get(s, 0) for s in range(shards)], quota, shards, slack)
        held = staged(linked.drop("label").join(labels, "uid"), "links")
        own = wishes(held, key_counts(held, shards), shards).select("uid", "own")
        counted = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
        # Unlinked documents go where room is left.
        room = [max(0, quota + 1 - counted.get(s, 0)) for s in range(shards)]
        bounds = [sum(room[:s + 1]) / max(1, sum(room)) for s in range(shards)]
        free, draw = F.lit(shards - 1), chance("uid", F.lit(-1))
        for s in reversed(range(shards - 1)):
            free = F.when(draw < bounds[s], s).otherwise(free)
        placed = (rows.join(labels, "uid", "left").join(own, "uid", "left")
                  .withColumn("weak", F.when(F.col("label").isNull(), 1).otherwise(-F.coalesce("own", F.lit(0))))
                  .withColumn("label", F.coalesce("label", free)).drop("own"))
        out = staged(evened(placed, total, shards).select("uid", "doc_id", "size", "shard", "slot"), "shards")
        linked = held.drop("label").join(out.select("uid", F.col("shard").alias("label")), "uid")
    return out.drop("uid")


def evened(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """``shard`` and ``slot`` of rows (uid, label, weak): a shard keeps its rows up to an even share, the least
    ``weak`` first; the others fill the holes of the rest.  One range sort numbers all rows.
    """
    at = staged(numbered(placed, ["label", "weak", "uid"]), "numbered")
    counted = {r.label: r["count"] for r in at.groupBy("label").count().collect()}
    sizes = [counted.get(s, 0) for s in range(shards)]
    larger = sorted(range(shards), key=lambda s: (-sizes[s], s))[:total % shards]
    even = [total // shards + (s in larger) for s in range(shards)]
    over = [max(0, n - e) for n, e in zip(sizes, even)]
    holes = [max(0, e - n) for n, e in zip(sizes, even)]
    before = lambda xs: {s: sum(xs[:s]) for s in range(shards)}
    look = lambda values: case(F.col("label"), dict(values), 0)
    rank = F.col("position") - look(before(sizes))
    stays = rank < look(enumerate(even))
    spare = look(before(over)) + rank - look(enumerate(even))
    to, slot = F.lit(0), F.lit(0)
    for s, first in before(holes).items():
        to = F.when(F.col("spare") >= first, s).otherwise(to) if holes[s] else to
        slot = F.when(F.col("spare") >= first, F.col("spare") - first + sizes[s]).otherwise(slot) if holes[s] else slot
    return (at.withColumn("spare", F.when(~stays, spare))
            .withColumn("shard", F.when(stays, F.col("label")).otherwise(to).cast("int"))
            .withColumn("slot", F.when(stays, rank).otherwise(slot).cast("long")))


def cut_report(sharded: DataFrame, links: DataFrame, shards: int = SHARDS) -> tuple[float, float]:
    """Weight of all links of a sharding and of those that it cuts (for plain edges: numbers of edges)."""
    named = links.filter(F.col("id").isNotNull() & F.col("key").isNotNull()).select(F.col("id").alias("doc_id"), "key").distinct()
    linked = sharded.join(named, "doc_id").select(F.xxhash64("key").alias("g1"), F.xxhash64(F.lit(1), "key").alias("g2"), F.col("shard").alias("label"))
    whole, cut = cut_weight(key_counts(linked, shards), shards)
    return whole / UNIT, cut / UNIT
