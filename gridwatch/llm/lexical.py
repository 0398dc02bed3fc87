"""Ranked lexical search over bit-sliced Bloom signatures.

Index (``build_index``), independent of the queries: documents are put into blocks by the size of their
signature (a power of two of bits, 16 to 32 for each key).  A document's keys are its terms, and again its terms that stand
2, 4, 8 or more times, each under a hash of its own.  A block stores its signatures by bit position:
one bitmap over its documents ("slice") for each position, with the documents' ids, text hashes and
exact lengths.

Search, for a block of queries:

1. N, L and the exact document frequencies of the queries' terms are counted over all whole texts.
2. For every block, the bitmaps of a key's positions are ANDed.  They may claim a key that a document lacks, but miss none.
   Sums of the terms' weights over these bitmaps, times the most that a term frequency of that step can
   give at the document's exact length, are upper bounds of all scores of the block.
3. For each query, the ``k`` documents of the highest bounds are scored exactly; their least score is a floor that
   the k-th best score cannot be below.
4. Every document whose bound reaches the floor is scored exactly from its whole text, and ranked.  A
   document that isn't has k documents above it, so the result is that of scoring all.

Equal texts have equal scores, so a text is scored once for a query, and of its documents only the k smallest
ids can rank.  Queries come to the driver in blocks of about ``BLOCK_CHARS`` characters; each block reads the
index anew.

Defined results: a null or empty text has no terms and is never found; a query without terms, or of terms
that no document holds, has no rows; repeated document rows are ranked once per row (the ids repeat); a null
id is behind all others of its score; repeated queries are answered once per row; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.llm.common import as_bytes, slices, staged

TOP = 50
#: Bits per key of a signature at the least, positions per key, and signature bits of one block.
BITS_PER_KEY = 16
HASHES = 5
CELLS = 1 << 21
#: Term frequencies from which a term has a further key.
STEPS = (1, 2, 4, 8)
#: Characters of queries in a block.
BLOCK_CHARS = 1 << 19

#: Fixed by the task: terms are runs of digits, letters (A-Z lower-cased) and all characters from U+0080, as UTF-8 bytes.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def weight(n_docs: int, df: int) -> int:
    """Fixed by the task."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n, n_docs: int, total: int):
    """Fixed by the task: m of a document of ``n`` terms."""
    return 100 - 50 + (50 * n * n_docs) // total


def gain(tf, m):
    """Fixed by the task: what one unit of weight adds at ``tf`` occurrences; it grows with ``tf``."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def term_hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term)


def keyed(hashes: np.ndarray, step: int) -> np.ndarray:
    """Keys of terms that stand STEPS[step] times or more."""
    x = hashes + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES positions of each key in a signature of ``bits`` (a power of two) bits."""
    start, stride = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((start[:, None] + steps * stride[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def signature_keys(counts: Counter) -> np.ndarray:
    hashes = np.fromiter(map(term_hash, counts), np.uint64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    return np.concatenate([keyed(hashes[times >= least], i) for i, least in enumerate(STEPS)])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of signatures: ids, k1, k2 (text hashes), n (terms) of the documents and the slices of ``bits`` positions."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2"),
                         F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def run(batches):
        open_: dict[int, list] = {}

        def block(bits):
            rows = open_.pop(bits)
            matrix = np.zeros((-(-len(rows) // 8) * 8, bits), bool)
            for i, (*_, keys) in enumerate(rows):
                matrix[i, positions(keys, bits)] = True
            ids, k1, k2, n, _ = zip(*rows, strict=True)
            lists = [pa.array([list(c)], pa.list_(t)) for c, t in ((ids, id_type), (k1, pa.int64()), (k2, pa.int64()), (n, pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [lists[0], pa.array([bits], pa.int32()), pa.array([len(rows)], pa.int32()), *lists[1:],
                 pa.array([np.packbits(matrix.T, axis=1).tobytes()], pa.binary())],
                names=["ids", "bits", "docs", "k1", "k2", "n", "slices"])

        id_type = None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                id_type = batch.column(0).type
                ids, k1, k2 = (batch.column(i).to_pylist() for i in range(3))
                for i, text in enumerate(as_bytes(batch.column(3))):
                    found = terms(text)
                    if not found:
                        continue
                    keys = signature_keys(Counter(found))
                    bits = BITS_PER_KEY << (len(keys) - 1).bit_length()
                    mine = open_.setdefault(bits, [])
                    mine.append((ids[i], k1[i], k2[i], len(found), keys))
                    if len(mine) >= max(8, CELLS // bits):
                        yield block(bits)
        for bits in sorted(open_):
            yield block(bits)

    id_kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"ids array<{id_kind}>, bits int, docs int, k1 array<long>, k2 array<long>, n array<long>, slices binary")


def statistics(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, int, dict[bytes, int]]:
    """N, L and the document frequency of each term of the vocabulary, over all whole texts."""

    def run(batches):
        found, n_docs, total = Counter(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                for text in as_bytes(batch.column(0)):
                    words = terms(text)
                    n_docs, total = n_docs + bool(words), total + len(words)
                    found.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, None, *found], pa.binary()), pa.array([0, 1] + [2] * len(found), pa.int32()),
             pa.array([n_docs, total, *found.values()], pa.int64())], names=["term", "kind", "n"])

    rows = (docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(run, "term binary, kind int, n long")
            .groupBy("kind", "term").agg(F.sum("n").alias("n")).collect())
    counts = {bytes(r.term): r.n for r in rows if r.kind == 2}
    sums = {r.kind: r.n for r in rows if r.kind != 2}
    return sums.get(0, 0), sums.get(1, 0), counts


class Queries:
    """A block of queries: for each, its distinct terms with their weights; hashes of all terms."""

    def __init__(self, items: list[list[bytes]], n_docs: int, total: int, df: dict[bytes, int]):
        self.n_docs, self.total = n_docs, total
        # A term that no document holds adds nothing, nor does one of weight 0.
        self.items = [{t: w for t in dict.fromkeys(item) if t in df and (w := weight(n_docs, df[t]))} for item in items]
        self.vocabulary = sorted(set().union(*self.items)) if self.items else []

    def bounds(self) -> Bounds:
        return Bounds(self)

    def score(self, item: int, counts: Counter, m: int) -> int:
        return sum(w * gain(counts[t], m) for t, w in self.items[item].items() if t in counts)


class Bounds:
    """Upper bounds of the scores of a block of documents."""

    def __init__(self, queries: Queries):
        self.queries = queries
        place = {t: i for i, t in enumerate(queries.vocabulary)}
        hashes = np.fromiter(map(term_hash, queries.vocabulary), np.uint64, len(place))
        self.keys = [keyed(hashes, i) for i in range(len(STEPS))]
        self.rows = [(np.array([place[t] for t in item], np.int64), np.array(list(item.values()), np.float64)) for item in queries.items]

    def of(self, bits: int, n: np.ndarray, packed: bytes) -> np.ndarray:
        """(queries, documents); whole numbers, exact as doubles."""
        q = self.queries
        table = np.frombuffer(packed, np.uint8).reshape(bits, -1)
        m = damping(n, q.n_docs, q.total)
        out = np.zeros((len(self.rows), len(n)))
        before, above = np.zeros(len(n), np.int64), None
        for i, least in enumerate(STEPS):
            most = np.minimum(n, STEPS[i + 1] - 1) if i + 1 < len(STEPS) else n
            at = positions(self.keys[i], bits)
            maps = table[at[:, 0]]
            for j in range(1, HASHES):
                maps &= table[at[:, j]]
            above = maps if above is None else above & maps
            some = above.any(axis=1)
            if not some.any():
                break
            present = np.unpackbits(above, axis=1, count=len(n)).astype(np.float32)
            here = gain(most, m)
            step = np.where(n >= least, here - before, 0)
            before = here
            for row, (places, weights) in enumerate(self.rows):
                live = some[places]
                if live.any():
                    out[row] += (weights[live] @ present[places[live]]) * step
        return out


def best(bound: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k greatest positive values."""
    at = np.flatnonzero(bound > 0)
    return at[np.argpartition(-bound[at], k - 1)[:k]] if len(at) > k else at


def scan_index(index: DataFrame, queries: Queries, k: int, floors: list[int] | None) -> DataFrame:
    """(item, doc_id, k1, k2, bound): with floors, all documents that reach them; without, each task's k highest bounds."""

    def run(batches):
        bounds, held = queries.bounds(), {}
        kind = None

        def out(rows):
            item, ids, k1, k2, bound = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, kind), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bound, pa.int64())],
                names=["item", "doc_id", "k1", "k2", "bound"])

        for whole in batches:
            for i in range(whole.num_rows):
                ids, bits, _, k1, k2, n, packed = (c[i] for c in whole.columns)
                kind = ids.values.type
                n = n.values.to_numpy()
                table = bounds.of(bits.as_py(), n, packed.as_buffer())
                rows = []
                for item in range(len(table)):
                    at = best(table[item], k) if floors is None else np.flatnonzero(table[item] >= max(1, floors[item]))
                    if len(at):
                        take = pa.array(at)
                        own = list(zip([item] * len(at), *(c.values.take(take).to_pylist() for c in (ids, k1, k2)),
                                       table[item][at].astype(np.int64).tolist(), strict=True))
                        if floors is None:
                            held[item] = sorted(held.get(item, []) + own, key=lambda r: -r[4])[:k]
                        else:
                            rows += own
                if rows:
                    yield out(rows)
        rows = [r for own in held.values() for r in own]
        if rows:
            yield out(rows)

    id_type = index.schema["ids"].dataType.elementType.simpleString()
    return index.select("ids", "bits", "docs", "k1", "k2", "n", "slices").mapInArrow(
        run, f"item int, doc_id {id_type}, k1 long, k2 long, bound long")


def first_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts to k in each task before the shuffle."""
    return (df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("__n") <= k).drop("__n"))


def scored(docs: DataFrame, pairs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """``pairs`` (item, doc_id, k1, k2) with their exact scores; a text is read once for all its queries."""
    wanted = (pairs.groupBy("k1", "k2").agg(F.collect_set("item").alias("items"), F.min("doc_id").alias("doc_id"))
              .withColumnsRenamed({"k1": "w1", "k2": "w2", "doc_id": "w_id"}))
    texts = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k1"),
                        F.xxhash64(F.lit(1), text_col).alias("k2"))
    same = F.col("d_id").eqNullSafe(F.col("w_id")) & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = []
                for k1, k2, items, text in zip(*(batch.column(i).to_pylist() for i in range(3)), as_bytes(batch.column(3)), strict=True):
                    found = terms(text)
                    counts, m = Counter(found), damping(len(found), queries.n_docs, queries.total)
                    out += [(item, k1, k2, queries.score(item, counts, m)) for item in items]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                        names=["s_item", "s1", "s2", "score"])

    # Repeated rows of one text give equal scores.
    scores = (texts.join(wanted, same).select("k1", "k2", "items", "text")
              .mapInArrow(run, "s_item int, s1 long, s2 long, score long").distinct())
    return (pairs.join(scores, (F.col("item") == F.col("s_item")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
            .select("item", "doc_id", "k1", "k2", "score"))


def query_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item id, text) of about BLOCK_CHARS characters, or of one longer query."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).head()[0] or 0) / BLOCK_CHARS))
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def candidates(docs: DataFrame, index: DataFrame, queries: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, k1, k2, bound) of all documents that are not provably outside the k best."""
    highest = staged(first_rows(scan_index(index, queries, k, None), ["item"], [F.desc("bound"), "k1", "k2", "doc_id"], k), "highest")
    floors = [0] * len(queries.items)
    least = scored(docs, highest, queries, id_col, text_col).groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    for r in least.filter(F.col("n") >= k).collect():
        floors[r.item] = r.least
    every = scan_index(index, queries, k, floors)
    return staged(first_rows(every, ["item", "k1", "k2"], [F.col("doc_id").asc_nulls_last()], k), "candidates")


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for each query."""
    spark = docs.sparkSession
    index = staged(build_index(docs, id_col, text_col), "signatures")
    out = None
    for block in query_blocks(benchmark, item_col, item_text_col):
        items = [terms(text.encode()) for _, text in block]
        queries = Queries(items, *statistics(docs, set().union(*items), text_col))
        pairs = candidates(docs, index, queries, k, id_col, text_col)
        ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "k1", "k2")
        rows = (scored(docs, pairs, queries, id_col, text_col).filter("score > 0")
                .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([
            T.StructField("i", T.IntegerType()), T.StructField("item_id", benchmark.schema[item_col].dataType)]))
        rows = rows.join(names, F.col("item") == F.col("i")).select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def search_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)
