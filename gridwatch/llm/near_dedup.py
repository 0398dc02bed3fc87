"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

1. A document's set: its distinct shingles of ``SHINGLE`` words (fewer words: the whole
   sequence as one).  Documents of equal sets form a class; from here on
   only one document of each class takes part.
2. Signatures: a first permutation (``sigma``) scatters the shingles over 2**32 places,
   a second one (``pi``) is used for all ``BANDS * ROWS`` coordinates, shifted circularly
   by one place each time.  Bands of ``ROWS`` coordinates make the bucket keys.
   At a similarity of 0.75 a pair misses all bands with a probability of 5e-6.
3. The most central member of a bucket is its head.  Each class is compared, on the
   full sets, with that one of its buckets' heads with which it shares most buckets, and links
   join components; then, where a bucket's members still lie in several components, every member
   with the bucket's head, which settles buckets of two.
4. Larger buckets whose members still lie in several components are resolved exactly: among
   their members, a prefix-filter join (two sets with enough in common share one of
   their rarest shingles) yields every pair of different components that can reach the
   threshold, and these are compared on the full sets.  So no bucket is capped, no
   bucket's pairs are listed, and no link between components is lost.

Texts and sets are moved for the classes that a step needs only: a bitmap of bounded size (``sieved``)
drops most other rows where they are read, the join that follows is exact.

All links inside a component need not be listed; components equal those of all links.

Defined results: null, empty and blank texts have empty sets and are linked with
nothing; a null id is passed through, and a component's id is the smallest id that
is not null; rows that repeat id and text get the same result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import as_bytes, lean, slices, staged, worker_cache

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Documents are linked where PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Bits of a set's bitmap.
BITS = 2048
#: A shingle's row in the prefix join names so many of the shingles before it.
BEFORE = 4
#: The largest bitmap of wanted values: 2**SLOT_BITS bits (8 MB).
SLOT_BITS = 26

U64, U32 = np.uint64, np.uint32
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], U64)
#: Fixed by the task: words are separated by these bytes only.
SPACES = b" \t\n\x0b\x0c\r"


def mix64(x: np.ndarray, odd=ODD[0]) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * odd
    x = (x ^ (x >> U64(29))) * ODD[1]
    return x ^ (x >> U64(32))


def byte_table() -> np.ndarray:
    """A random 64-bit number for each place in a word and each byte; 0 for separators."""
    table = mix64(np.arange(1, 64 * 256 + 1, dtype=U64) * ODD[2]).reshape(64, 256)
    table[:, list(SPACES)] = 0
    return table.reshape(-1)


def word_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased text, in order."""
    raw = np.frombuffer(text, np.uint8)
    apart = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~apart
    first[1:] &= apart[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U64)
    place = np.arange(len(raw))
    place -= np.repeat(starts, np.diff(starts, append=len(raw))) if starts[0] == 0 else np.concatenate(
        [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(raw)))])
    values = table[((place & 63) << 8) | raw]
    if (place > 63).any():
        values = values * ((place >> 6).astype(U64) * ODD[3] | U64(1))
    return mix64(np.add.reduceat(values, starts))


def shingles(text: bytes, table: np.ndarray) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text; A-Z are lower-cased."""
    words = word_hashes(text.lower(), table)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, U64) * ODD[4]
    for j in range(size):
        total += words[j:j + n] * ODD[j]
    return np.unique(mix64(total, ODD[3]))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    return x


def signature(items: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate i: the least value of pi at sigma(item) + i, circularly, over all items."""
    sigma = scrambled((items >> U64(32)).astype(U32) ^ U32(0x5BD1E995))
    shift = np.arange(k, dtype=U32)[:, None]
    out = np.full(k, 0xFFFFFFFF, U32)
    for a in range(0, len(sigma), 1024):
        np.minimum(out, scrambled(sigma[None, a:a + 1024] + shift).min(axis=1), out=out)
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    bands = sign.reshape(BANDS, ROWS).astype(U64)
    total = np.arange(1, BANDS + 1, dtype=U64) * ODD[4]
    for j in range(ROWS):
        total = mix64(total + bands[:, j] * ODD[j])
    return total.view(np.int64)


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(mix64(items, ODD[2]).sum().view(np.int64)), int(mix64(items, ODD[4]).sum().view(np.int64))


def _table() -> np.ndarray:
    cache = worker_cache()
    if "bytes" not in cache:
        cache["bytes"] = byte_table()
    return cache["bytes"]


def signed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n, f1, f2, bands, text_key) of rows (doc_id, text, text_key)."""

    def run(batches):
        table, uid = _table(), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for raw in as_bytes(batch.column(1)):
                    items = shingles(raw, table)
                    rows.append((len(items), *fingerprint(items), band_keys(signature(items)) if len(items) else []))
                n, f1, f2, bands = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + len(rows))), batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()),
                    pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)],
                    names=["uid", "doc_id", "n", "f1", "f2", "bands", "text_key"])
                uid += len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"uid long, doc_id {kind}, n long, f1 long, f2 long, bands array<bigint>, text_key long")


def bitmap(items: np.ndarray) -> np.ndarray:
    """``BITS`` bits as longs: bit h is set where some item hashes to h."""
    bits = np.zeros(BITS, np.uint8)
    bits[(items & U64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def sieved(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose value of a column is one of the wanted ones, and a few others: saves a join most of what it would shuffle.

    A bitmap with 32 bits or more per wanted value, ``2**SLOT_BITS`` at most, is broadcast; with more
    wanted values than that serves, more other rows stay.  ``wanted`` is read twice.
    """
    slots = 1 << min(SLOT_BITS, max(15, (32 * wanted.count()).bit_length()))
    slot = F.xxhash64(column).bitwiseAND(F.lit(slots - 1)) + 1
    maps = (wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__map")))
    hit = F.expr("getbit(cast(conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int), cast(__bit % 8 as int)) = 1")
    return (rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).withColumn("__bit", F.bitmap_bit_position(slot))
            .join(F.broadcast(maps), "__bucket").filter(hit).select(*rows.columns))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, bits, items): the sets of the wanted classes (cls, doc_id, f1, f2), made anew from the texts."""

    def run(batches):
        table = _table()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                cls, f1, f2 = (batch.column(i).to_pylist() for i in range(3))
                found = []
                for c, a, b, raw in zip(cls, f1, f2, as_bytes(batch.column(3)), strict=True):
                    items = shingles(raw, table)
                    if fingerprint(items) == (a, b):  # another text may bear the same id
                        found.append((c, len(items), bitmap(items), items.view(np.int64)))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["cls", "n", "bits", "items"])

    rows = (sieved(docs, "doc_id", wanted).join(wanted.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
            .select("cls", "f1", "f2", "text"))
    return rows.mapInArrow(lean(run), "cls long, n long, bits array<bigint>, items array<bigint>")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    Bitmaps of the sets go first: a bit that one set has and the other has not stands for at least one
    shingle that is not shared, so most pairs drop out before full sets are moved.
    """
    small = [sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "bits"))) for x in "ab"]
    lacks = lambda x, y: F.aggregate(F.zip_with(
        x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, c: n + c)
    shared = F.least(F.col("n_a") - lacks("bits_a", "bits_b"), F.col("n_b") - lacks("bits_b", "bits_a"))
    enough = lambda c: (100 + PERCENT) * c >= PERCENT * (F.col("n_a") + F.col("n_b"))
    left = staged(pairs.join(small[0], F.col("a") == F.col("cls_a")).join(small[1], F.col("b") == F.col("cls_b"))
                  .filter(enough(shared)).select("a", "b", "n_a", "n_b"), "left")
    sets = sieved(sets.select("cls", "items"), "cls", left.select(F.explode(F.array("a", "b")).alias("cls")))
    a = sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    return (left.join(a, "a").join(b, "b").filter(enough(F.size(F.array_intersect("items_a", "items_b"))))
            .select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's component, by label passing and pointer jumping.

    Every round is written to the shared folder.
    """
    both = staged(edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
                  .unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "edges")
    labels = both.select("v").distinct().withColumn("label", F.col("v"))
    while True:
        heard = (both.join(labels.select(F.col("v").alias("u"), "label"), "u").select("v", "label", F.lit(None).cast("long").alias("own"))
                 .unionByName(labels.select("v", "label", F.col("label").alias("own")))
                 .groupBy("v").agg(F.min("label").alias("label"), F.max("own").alias("own")))
        further = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        labels = staged(heard.join(further, "label").select("v", F.least("label", "further").alias("label"), "own"), "labels")
        if labels.filter("label <> own").isEmpty():
            return labels.drop("own")


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (cls, label) after links (a, b): the components of the linked labels take their smallest label."""
    a = labels.select(F.col("cls").alias("a"), F.col("label").alias("x"))
    b = labels.select(F.col("cls").alias("b"), F.col("label").alias("y"))
    between = links.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(between).select(F.col("v").alias("label"), F.col("label").alias("new"))
    return staged(labels.join(merged, "label", "left").select("cls", F.coalesce("new", "label").alias("label")), "labels")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, size, cls, label, head, head_label) of the buckets that hold several components.

    The head is the most central member: the one with most neighbours over all its buckets.
    """
    named = buckets.join(labels, "cls")
    heads = (named.groupBy("key").agg(F.max(F.struct("central", "cls", "label")).alias("first"),
                                      F.min("label").alias("low"), F.max("label").alias("high"))
             .filter("low <> high").select("key", F.col("first.cls").alias("head"), F.col("first.label").alias("head_label")))
    return named.join(heads, "key").drop("central")


def outside(members: DataFrame) -> DataFrame:
    return members.filter("label <> head_label")


def head_pairs(members: DataFrame) -> DataFrame:
    """One pair (a, b) per class that lies outside a head's component: the head it shares most buckets with."""
    return (outside(members).groupBy("cls", "head").agg(F.count("*").alias("shared"))
            .groupBy("cls").agg(F.max(F.struct("shared", "head")).alias("most"))
            .select(F.least("cls", "most.head").alias("a"), F.greatest("cls", "most.head").alias("b")).distinct())


def prefix_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, label, n, item, i, early, before): the shingles of the members (cls, label) that can be the first one of a pair (``prefix_pairs``).

    i: the shingle's place in the set; early: it is early enough for the smaller set of a pair; before: the
    ``BEFORE`` listed shingles before it.
    """
    rows = sieved(sets, "cls", members).join(members, "cls").select("cls", "label", "n", F.explode("items").alias("item"))
    often = (rows.groupBy("item").agg(F.count("*").alias("often"), F.min("label").alias("low"), F.max("label").alias("high"))
             .filter("often > 1").select("item", "often", (F.col("low") != F.col("high")).alias("open")))
    order = (rows.join(often, "item", "left")
             .groupBy("cls", "label", "n").agg(F.array_sort(F.collect_set(F.struct(
                 F.coalesce("often", F.lit(1)).alias("often"), "item", F.coalesce("open", F.lit(False)).alias("open")))).alias("order")))
    long = F.expr(f"cast(n - ceil(n * {PERCENT} / 100D) + 1 as int)")
    short = F.expr(f"cast(n - ceil(n * {2 * PERCENT} / {100 + PERCENT}D) + 1 as int)")
    # Only shingles that several components have can pair members of different ones.
    places = F.filter(F.transform(F.slice("order", 1, long), lambda x, i: F.struct(i.alias("i"), x["item"].alias("item"), x["open"].alias("open"))),
                      lambda x: x["open"])
    compact = staged(order.withColumn("places", places).filter(F.size("places") > 0).select(
        "cls", "label", "n", short.alias("short"), F.transform("places", lambda x: x["item"]).alias("prefix"),
        F.transform("places", lambda x: x["i"]).alias("at")), "prefix")
    before = F.slice("prefix", F.greatest(F.col("k") - BEFORE + 1, F.lit(1)), F.least("k", F.lit(BEFORE)))
    return (compact.select("cls", "label", "n", "short", "prefix", "at", F.posexplode("prefix").alias("k", "item"))
            .withColumn("i", F.get("at", "k")).withColumn("early", F.col("i") < F.col("short"))
            .withColumn("before", before).drop("short", "prefix", "at", "k"))


def prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (cls, label) with different labels that can reach the threshold.

    Shingles are ordered from rare to common among the members' sets.  Let x be the smaller and y
    the larger set of a pair that reaches the threshold.  Then they have at least
    need = 75/175 (|x| + |y|) shingles in common, so one of the first |x| - 6/7 |x| + 1 of x is one of the
    first |y| - 3/4 |y| + 1 of y, and after the first one that both have there is room for the rest.
    A pair that qualifies at a later common shingle does so at the first one too, as
    there is less room behind the later one.  So each common shingle may make the pair, once it is made distinct, and rows
    need not carry whole prefixes (their bytes would grow with the square of a prefix): the last
    ``BEFORE`` shingles before each one spare most repeats, since a shingle common to both lists shows that
    this one is not the first.

    Of the members with one shingle only those outside its most frequent component are paired
    with all others, so a large component is never paired with itself.
    """
    prefix = prefix_rows(members, sets)
    most = (prefix.groupBy("item", "label").agg(F.count("*").alias("times"))
            .groupBy("item").agg(F.max(F.struct("times", "label")).alias("most")).select("item", F.col("most.label").alias("major")))
    named = prefix.join(most, "item")
    a = named.filter("label <> major").select("item", *(F.col(c).alias(f"{c}_a") for c in prefix.columns if c != "item"))
    b = named.select("item", "major", *(F.col(c).alias(f"{c}_b") for c in prefix.columns if c != "item"))
    smaller = F.expr("n_a < n_b OR (n_a = n_b AND cls_a < cls_b)")
    need = F.expr(f"ceil({PERCENT} * (n_a + n_b) / {100 + PERCENT}D)")
    return (a.join(b, "item")
            .filter("label_a <> label_b AND (label_b = major OR cls_a < cls_b)")
            .filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
            .filter(F.when(smaller, F.col("early_a")).otherwise(F.col("early_b")))
            .filter(F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= need)
            .filter(~F.arrays_overlap("before_a", "before_b"))
            .select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_key (xxhash64 of the text)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(signed(source.withColumn("text_key", F.xxhash64("text"))), "signatures")
    classes = staged(rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("first_id")),
                     "classes")
    keys = (rows.join(classes.select("cls"), F.col("uid") == F.col("cls"))
            .select("cls", F.explode("bands").alias("key")))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = keys.join(shared, "key")
    central = buckets.groupBy("cls").agg(F.sum("members").alias("central"))
    buckets = staged(buckets.join(central, "cls").select("key", F.col("members").alias("size"), "cls", "central"), "buckets")

    ids = rows.select(F.col("uid").alias("cls"), "doc_id", "f1", "f2")
    labels = staged(buckets.select("cls").distinct().withColumn("label", F.col("cls")), "labels")
    sets = staged(full_sets(source, staged(ids.join(labels.select("cls"), "cls"), "wanted")), "sets")
    labels = joined_up(labels, staged(linked(head_pairs(open_buckets(buckets, labels)), sets), "links"))

    still = staged(open_buckets(buckets, labels), "open")
    # Every member against its bucket's head settles the buckets of two.
    pairs = outside(still).select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()
    members = staged(still.filter("size > 2").select("cls", "label").distinct(), "members")
    more = staged(pairs.unionByName(prefix_pairs(members, sets)).distinct(), "pairs")
    labels = joined_up(labels, staged(linked(more, sets), "links"))

    named = (classes.join(labels, "cls", "left")
             .select("f1", "f2", "first_id", F.coalesce("label", "cls").alias("label")))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(smallest, "label").select("f1", "f2", "component_id")
    known = rows.filter("n > 0").join(of_set, ["f1", "f2"]).select("doc_id", "n", "component_id", "text_key")
    blank = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_key")
    return known.unionByName(blank).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def near_dedup_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
