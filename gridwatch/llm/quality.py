"""Quality: nearest-neighbour voting over latent-semantic vectors.

1. A text's terms are n-grams of its surface (letters and digits folded to
   classes, punctuation and white space kept), marks for words that repeat the word before,
   and character trigrams; they are hashed to ``TERMS`` columns.
2. On at most ``MAX_LABELS`` labelled rows (a documented bound) the weighted
   term matrix is decomposed; ``RANK`` singular directions make the latent space.
3. The labelled vectors (``MAX_LABELS * RANK`` floats at most, 2.5 MB) are
   broadcast.  For blocks of documents the exact cosine products with all of them
   are computed, and the ``NEIGHBOURS`` nearest vote with their similarity.

Defined results: null counts as empty; a text without terms has the share of label 1
as its score; a null id is not held out; null labels are not learnt from; without
labels every score is 0.5; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import as_bytes, bucket_of_id, slices
from gridwatch.llm.toxicity import sample_labelled

MAX_LABELS = 10_000
SURFACE, TRIGRAMS = 1024, 512
TERMS = SURFACE + TRIGRAMS
#: Weight of the lexical half of the terms against the surface half.
LEXICAL = 0.35
RANK = 64
NEIGHBOURS = 24
#: Votes are similarities to this power.
SHARPNESS = 12
THRESHOLD = 0.7
BLOCK = 512

CLASSES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
SIZES = (1, 2, 3, 4)


def term_counts(text: bytes) -> np.ndarray:
    """Hashed term frequencies, square-rooted, of one text."""
    out = np.zeros(TERMS)
    if not text:
        return out
    shape = np.frombuffer(text.translate(CLASSES), np.uint8)
    folded = np.isin(shape, (97, 65, 48))
    keep = np.ones(len(shape), bool)
    keep[1:] = ~(folded[1:] & (shape[1:] == shape[:-1]))
    points = shape[keep].astype(np.uint32)
    hashed = None
    for size in SIZES:
        n = len(points) - size + 1
        if n <= 0:
            break
        hashed = points[:n] * np.uint32(0x9E3779B1) if hashed is None else (hashed[:n] + points[size - 1:]) * np.uint32(0x85EBCA6B)
        hashed ^= hashed >> np.uint32(15)
        out[:SURFACE] += np.bincount(hashed % np.uint32(SURFACE - 2), minlength=SURFACE) / n
    words = text.split()
    if len(words) > 1:
        same = sum(map(bytes.__eq__, words, words[1:]))
        out[SURFACE - 2] = 4 * same / (len(words) - 1)
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(raw) > 2:
        grams = (raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]
        grams ^= grams >> np.uint32(13)
        out[SURFACE:] = np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(23), minlength=TRIGRAMS) / len(grams)
    return np.sqrt(out)


def term_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([term_counts(t) for t in texts], np.float32).reshape(len(texts), TERMS)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Both halves weighted and of unit length, side by side."""
    both = terms * idf
    return np.hstack([unit(both[:, :SURFACE]), LEXICAL * unit(both[:, SURFACE:])]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labels: int = MAX_LABELS) -> dict:
    """The latent space and the labelled vectors in it."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                terms = term_matrix(as_bytes(batch.column(0))).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array([t.tobytes() for t in terms], pa.binary())], names=["label", "terms"])

    rows = sample_labelled(docs, labels, label, max_labels).mapInArrow(run, "label int, terms binary").toArrow()
    if not rows.num_rows:
        return {"labels": np.empty(0)}
    terms = np.frombuffer(b"".join(rows.column("terms").to_pylist()), np.float16).reshape(rows.num_rows, TERMS)
    y = np.array(rows.column("label").to_pylist(), np.float32)
    idf = np.log((1 + len(y)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
    gram, mean = np.zeros((TERMS, TERMS)), np.zeros(TERMS)
    blocks = range(0, len(y), BLOCK)
    for a in blocks:
        mean += weighted(terms[a:a + BLOCK].astype(np.float32), idf).sum(axis=0)
    mean = (mean / len(y)).astype(np.float32)
    for a in blocks:
        x = weighted(terms[a:a + BLOCK].astype(np.float32), idf) - mean
        gram += x.T @ x
    directions = np.linalg.eigh(gram)[1][:, ::-1][:, :RANK].astype(np.float32)
    model = {"idf": idf, "mean": mean, "directions": directions, "labels": y}
    model["vectors"] = np.vstack([latent(terms[a:a + BLOCK].astype(np.float32), model) for a in blocks])
    return model


def latent(terms: np.ndarray, model: dict) -> np.ndarray:
    """Unit vectors in the latent space."""
    return unit((weighted(terms, model["idf"]) - model["mean"]) @ model["directions"]).astype(np.float32)


def votes(terms: np.ndarray, model: dict) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    y = model["labels"]
    if not len(y):
        return np.full(len(terms), 0.5)
    k = min(NEIGHBOURS, len(y))
    products = latent(terms, model) @ model["vectors"].T
    near = np.argpartition(-products, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(products, near, axis=1), 0).astype(float) ** SHARPNESS + 1e-9
    score = (weight * y[near]).sum(axis=1) / weight.sum(axis=1)
    return np.where((terms > 0).any(axis=1), score, y.mean())


def with_score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                for a in range(0, batch.num_rows, BLOCK):
                    block = batch.slice(a, BLOCK)
                    terms = term_matrix(as_bytes(block.column(block.schema.get_field_index(text_col))))
                    yield pa.RecordBatch.from_arrays(
                        [*block.columns, pa.array(votes(terms, shared.value).astype(float))], names=[*block.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(run, schema)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return with_score(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id", F.coalesce(bucket_of_id(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
