"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each task reads its documents in chunks of bounded size, takes a 64-bit
   fingerprint of each normalised text (A-Z lower-cased) and writes the rows to a
   table bucketed by chunk.  For each owner (a range of fingerprints) a chunk adds
   one message: its distinct fingerprints, sorted and Golomb-Rice coded.
2. Owners decode the messages they get and answer each with a bitmap of the
   fingerprints that some other chunk holds too.  A fingerprint that one chunk
   holds a million times travels once.
3. The bitmaps go back to their chunks; as the table is bucketed by chunk, its
   rows are not shuffled for this.  Rows without a mark are unique.
4. Only the suspects' texts are shuffled and compared byte for byte, grouped by
   the text itself after a map-side combine, so a huge group of copies is one
   row per task before the shuffle.

Defined results: null text counts as empty; the largest id of a group stays, and
a null id is smaller than any other; of rows that repeat both id and text one stays
(the first as read); an empty table gives no rows; extra columns are ignored, or
carried along where asked for.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.llm.common import lean, slices, small_batches, staged
from gridwatch.session import shared_path

CHUNK_ROWS = 1 << 15
CHUNK_BYTES = 16 << 20
#: Fingerprints that one owner answers for, on average.
OWNER_FINGERPRINTS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(column):
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct unsigned integers: parameter and bytes.

    The gaps' quotients stand in unary in one bit string, their low bits in another.
    """
    gaps = np.diff(values, prepend=values.dtype.type(0))
    mean = max(1, int(values[-1]) // len(values))
    k = max(0, int(mean * 0.69).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def rice_decode(k: int, n: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    low_bytes = (n * k + 7) // 8
    split = len(raw) - low_bytes
    ends = np.flatnonzero(np.unpackbits(raw[:split]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(raw[split:])[:n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def owner_of(fingerprints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of fingerprints, so order by owner is order by fingerprint."""
    return (((fingerprints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def owner_start(owner: np.ndarray, owners: int) -> np.ndarray:
    """The smallest fingerprint of each owner."""
    return np.array([-(-(int(o) << 32) // owners) << 32 for o in owner], np.uint64)


def chunk_plan(fingerprints: np.ndarray, owners: int):
    """Per row: bit position and whether the chunk itself holds a copy; messages (owner, n, k, blob)."""
    distinct, inverse, counts = np.unique(fingerprints, return_inverse=True, return_counts=True)
    owner = owner_of(distinct, owners)
    names, first, sizes = np.unique(owner, return_index=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum((sizes + 7) // 8 * 8)[:-1]])
    bit = np.repeat(starts, sizes) + np.arange(len(distinct)) - np.repeat(first, sizes)
    messages = []
    for name, low, a, n in zip(names.tolist(), owner_start(names, owners), first, sizes.tolist(), strict=True):
        k, blob = rice_encode(distinct[a:a + n] - low)
        messages.append((name, n, k, blob))
    return bit[inverse], counts[inverse] > 1, messages


def exchange_table(docs: DataFrame, owners: int, text: str) -> DataFrame:
    """Rows of the documents with chunk, position and digest, and the chunks' messages."""
    schema = docs.schema
    names = [f.name for f in schema]

    def run(batches):
        first_chunk, made = TaskContext.get().partitionId() << 20, 0
        held, digests, size = [], [], 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        own = ["__chunk", "__place", "__bit", "__copied", "__sha", "__owner", "__n", "__k", "__blob"]

        def flush():
            nonlocal held, digests, size, made
            chunk = first_chunk + made
            prints = np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)
            bit, copied, messages = chunk_plan(prints, owners)
            types, place = held[0].schema.types, 0
            for i, batch in enumerate(held):
                n = batch.num_rows
                rows = slice(place, place + n)
                columns = [pa.array([chunk] * n, kinds[0]), pa.array(range(place, place + n), kinds[1]), pa.array(bit[rows], kinds[2]),
                           pa.array(copied[rows], kinds[3]), pa.array([d.hex() for d in digests[rows]], kinds[4]), *(pa.nulls(n, t) for t in kinds[5:])]
                held[i], place = None, place + n
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names + own)
            m = len(messages)
            owner, count, k, blob = (list(c) for c in zip(*messages, strict=True))
            columns = [pa.array([chunk] * m, kinds[0]), *(pa.nulls(m, t) for t in kinds[1:5]),
                       *(pa.array(c, t) for c, t in zip((owner, count, k, blob), kinds[5:], strict=True))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in types), *columns], names=names + own)
            held, digests, size, made = [], [], 0, made + 1

        for whole in batches:
            for piece in slices(whole, text, 2 << 20):
                for a in range(0, piece.num_rows, CHUNK_ROWS):
                    batch = piece.slice(a, CHUNK_ROWS)
                    if held and (len(digests) + batch.num_rows > CHUNK_ROWS or size + batch.nbytes > CHUNK_BYTES):
                        yield from flush()
                    held.append(batch)
                    # One text at a time becomes a Python object; only its digest stays.
                    digests += [hashlib.sha256((t.as_py() or "").encode().lower()).digest() for t in batch.column(names.index(text))]
                    size += batch.nbytes
        if held:
            yield from flush()

    own = ", ".join(f"{c} {t}" for c, t in (
        ("__chunk", "long"), ("__place", "long"), ("__bit", "long"), ("__copied", "boolean"), ("__sha", "string"), ("__owner", "long"),
        ("__n", "long"), ("__k", "long"), ("__blob", "binary")))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + T.StructType.fromDDL(own).fields)
    return docs.mapInArrow(lean(run), schema)


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: the fingerprints that more than one chunk sent."""
    sets = [rice_decode(k, n, b) for k, n, b in zip(pdf["__k"], pdf["__n"], pdf["__blob"], strict=True)]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    return pd.DataFrame({
        "__chunk": pdf["__chunk"], "__owner": pdf["__owner"],
        "__marks": [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sets]})


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Write to the shared folder, bucketed by a column, without a shuffle; read back as a bucketed scan."""
    spark = df.sparkSession
    name = f"exchange_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, column).option("path", shared_path(spark, "llm", name)).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay
    return table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the carried columns.

    ``carry`` names columns of ``docs`` to return as well (c0, c1, ... in that order).
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"),
                         *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    carried = [f"c{i}" for i in range(len(carry))]
    owners = max(16, docs.count() // OWNER_FINGERPRINTS + 1)
    with small_batches(docs.sparkSession):
        table = bucketed(exchange_table(source, owners, "__text"), "__chunk")
    marks = staged(table.filter(F.col("__owner").isNotNull()).select("__chunk", "__owner", "__n", "__k", "__blob")
             .groupBy("__owner").applyInPandas(answer, "__chunk long, __owner long, __marks binary")
             .groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct("__owner", "__marks"))).alias("__all"))
             .select("__chunk", F.aggregate(F.transform("__all", lambda x: x["__marks"]), F.lit(b""),
                                            lambda a, x: F.concat(a, x)).alias("__marks")), "marks")
    shared = F.expr("shiftright(cast(conv(hex(substring(__marks, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int), "
                    "cast(7 - __bit % 8 as int)) % 2 = 1")
    rows = (table.filter(F.col("__owner").isNull()).join(marks.hint("shuffle_hash"), "__chunk")
            .withColumn("__suspect", F.col("__copied") | shared)
            .withColumn("__row", F.col("__chunk") * CHUNK_ROWS + F.col("__place")))
    unique = rows.filter(~F.col("__suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("__sha").alias("text_sha256"), *carried)
    suspects = rows.filter("__suspect")
    groups = (suspects.groupBy("__sha", normalised(F.col("__text")).alias("__norm"))
              .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .groupBy("__sha").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                                    F.count("*").alias("__texts")))
    # Of equal ids the first row stays.
    first = (suspects.select("__sha", "doc_id", "__row").join(groups.select("__sha", "keep_id"), "__sha")
             .filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("__sha").agg(F.min("__row").alias("__first")))
    groups = staged(groups.join(first, "__sha"), "groups")
    # Two texts of one SHA-256 would make a group's row ambiguous: stop rather than merge them.
    verified = F.when(F.col("__texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.concat(F.lit("different texts share the digest "), F.col("__sha"))).cast("long"))
    copies = (suspects.select("doc_id", "__sha", "__row", *carried).join(groups, "__sha")
              .select("doc_id", "keep_id", verified.alias("group_size"), (F.col("__row") == F.col("__first")).alias("kept"),
                      F.col("__sha").alias("text_sha256"), *carried))
    return unique.unionByName(copies)
