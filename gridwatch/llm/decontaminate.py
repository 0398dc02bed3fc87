"""Benchmark decontamination with one Aho-Corasick automaton.

The texts of the benchmark's items (questions and answers in one text) are
normalised to words and cut into windows of ``WINDOW`` consecutive words; an item
of fewer words is one window.  All windows go into one automaton.  Each
document is normalised the same way and scanned once; a match's end is
mapped to the document's words, and from there to code points of the original
text.

The benchmark is normalised and dealt into blocks by a Spark job; a block holds about
``BLOCK_CHARS`` characters (or one longer item).  One block at a time comes to the driver
and is broadcast; it has its own automaton and its own scan, and the results of the blocks are merged per
document.  A benchmark of ordinary size is one block.  A worker keeps one automaton, known by its
items' digest, and drops it when another one is asked for.

Defined results: a null text has no words; items of null or wordless text have no
window; items without an id count for hits but not as items; equal items each
count; a repeated document row is reported once per row; an empty benchmark leaves
every document clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import as_bytes, lean, slices, staged, worker_cache

WINDOW = 10
#: Normalised benchmark text in one automaton: about 8 M nodes at the most repetitive.
BLOCK_CHARS = 1 << 20

#: Fixed by the task: words are runs of digits, letters a-z (A-Z lower-cased) and all characters from U+0080.
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: The same over UTF-8 bytes: word bytes stay (lower-cased), all others become spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split(b" ")


def normalise(text: bytes) -> str:
    """The words of a text, each with one space before, and a space at the end; empty if there are none."""
    words = b" ".join([w for w in normal_words(text) if w])
    return f" {words.decode()} " if words else ""


def windows(normal: str, size: int = WINDOW) -> list[str]:
    words = normal.split(" ")[1:-1] if normal else []
    if not words:
        return []
    return [f" {' '.join(words[i:i + size])} " for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str | None, str]]):
    """An Aho-Corasick automaton over the windows of normalised items: value (words in the window, item ids)."""
    import ahocorasick

    found: dict[str, set] = {}
    for item, normal in items:
        for w in windows(normal):
            found.setdefault(w, set()).add(item)
    if not found:
        return None
    machine = ahocorasick.Automaton()
    for w, ids in found.items():
        machine.add_word(w, (w.count(" ") - 1, frozenset(ids)))
    machine.make_automaton()
    return machine


def scan(machine, normal: str) -> tuple[list[tuple[int, int]], set]:
    """Merged runs [first word, last word + 1) inside occurrences, and the items that occur."""
    hits = list(machine.iter(normal))
    if not hits:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])  # the space after word i is number i + 1
    items, runs = set(), []
    for a, b in sorted((int(e) - v[0], int(e)) for e, (_, v) in zip(ends, hits, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for _, (_, ids) in hits:
        items |= ids
    return [tuple(r) for r in runs], items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans in the original text of runs of words."""
    words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    return [(words[a][0], words[b - 1][1]) for a, b in runs]


def normalised(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item id as text, normalised text) of the items that have words."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([normalise(t) for t in as_bytes(batch.column(1))], pa.string())], names=["item", "normal"])

    return (benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
            .mapInArrow(lean(run), "item string, normal string").filter("normal <> ''"))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item id as text, normalised text) of about BLOCK_CHARS in all; one empty list for no items."""
    rows = staged(normalised(benchmark, item_col, text_col), "benchmark")
    chars = rows.agg(F.sum(F.length("normal"))).head()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("item", "normal"), F.lit(blocks)) == b
        yield sorted(((r.item, r.normal) for r in rows.filter(mine).collect()), key=lambda r: (r[0] or "", r[1]))


def kept_automaton(items: list[tuple[str | None, str]], key: str):
    """The worker's automaton; an older one is dropped before another is built."""
    cache = worker_cache()
    if cache.get("automaton", (None,))[0] != key:
        cache.pop("automaton", None)
        cache["automaton"] = (key, automaton(items))
    return cache["automaton"][1]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, runs (of hit words), spans (code points of the original), items (ids as text), c0, c1, ...

    ``carry`` names columns of ``docs`` to return as well.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"),
                         *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scanner(shared, key):
        def run(batches):
            machine = kept_automaton(shared.value, key)
            for whole in batches:
                for batch in slices(whole, "__text"):
                    out = []
                    for raw in as_bytes(batch.column(1)):
                        normal = normalise(raw)
                        runs, items = scan(machine, normal) if machine and normal else ([], set())
                        spans = original_spans(raw.decode(), runs) if runs else []
                        out.append((max(0, normal.count(" ") - 1), runs, spans, sorted(i for i in items if i is not None)))
                    n, runs, spans, items = (list(c) for c in zip(*out, strict=True))
                    as_pairs = lambda lists: pa.array([[{"start": a, "end": b} for a, b in x] for x in lists], pair)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(n, pa.int64()), as_pairs(runs), as_pairs(spans),
                         pa.array(items, pa.list_(pa.string())), *batch.columns[2:]],
                        names=["doc_id", "n_words", "runs", "spans", "items", *batch.schema.names[2:]])
        return run

    def schema(frame):
        kind = {f.name: f.dataType.simpleString() for f in frame.schema}
        return ", ".join([f"doc_id {kind['doc_id']}", "n_words long", "runs array<struct<start:bigint,end:bigint>>",
                          "spans array<struct<start:bigint,end:bigint>>", "items array<string>",
                          *(f"`{c}` {kind[c]}" for c in frame.columns[2:])])

    def one(block, frame):
        key = hashlib.sha256(pickle.dumps(block)).hexdigest()
        return frame.mapInArrow(lean(scanner(spark.sparkContext.broadcast(block), key)), schema(frame))

    blocks = item_blocks(benchmark, item_col, item_text_col)
    first, rest = next(blocks), next(blocks, None)
    if rest is None:
        return one(first, source)
    # Several blocks: rows are told apart by id and text, repeated rows by their number.
    keyed = source.withColumn("__row", F.struct("doc_id", F.sha2(F.coalesce("__text", F.lit("")), 256).alias("sha")))
    light = keyed.select("doc_id", "__text", "__row")
    parts = one(first, light)
    while rest is not None:
        parts, rest = parts.unionByName(one(rest, light)), next(blocks, None)
    merged = parts.groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    kind = "__row " + merged.schema["__row"].dataType.simpleString() + ", " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in merged.schema.fields[1:])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([merged_runs(x) for x in c.to_pylist()], pair) if name in ("runs", "spans") else c
                 for name, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return keyed.join(merged.mapInArrow(lean(run), kind), "__row").select("doc_id", "n_words", "runs", "spans", "items",
                                                                    *(f"c{i}" for i in range(len(carry))))


def merged_runs(runs: list[dict]) -> list[dict]:
    """Sorted runs with those that touch or overlap joined."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["start"], r["end"])):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append(dict(r))
    return out


def n_hit():
    return F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns of ``contamination``."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))
