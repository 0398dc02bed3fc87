"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training, on at most ``MAX_LABELS`` labelled rows (a documented bound; the rows
with the smallest hash of their id, so the sample does not depend on the
partitioning):

1. count in Spark in how many texts of each class every n-gram stands;
2. keep the ``MAX_FEATURES`` n-grams with the strongest evidence and take their
   log-count ratios;
3. fit a logistic regression on presence times ratio, by Newton-CG on the driver (the
   sample's rows hold a few kept n-grams each).

Scoring streams all texts whole through the kept n-grams.  Texts are lower-cased,
white space is folded, and n-grams of ``SIZES`` characters are taken inside a text
with a space at each end.

Memory: a worker holds the n-grams of one piece of ``PIECE`` characters, the distinct
n-grams of one slice of ``COUNT_SLICE`` text bytes, and sorted runs of at most ``RUN`` n-grams
that wait to be merged.  Together that stays below 150 MB, whatever the texts are
(measured in tests/llm/test_classifiers.py).

Defined results: null counts as empty; an empty text has the score of a text without
any kept n-gram; a null id is not held out; labels that are null are not learnt from;
without labels of both classes every score is 0; repeated rows are scored alike;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import bucket_of_id, lean, slices

SIZES = (3, 4, 5, 6)
MAX_LABELS = 12_000
MAX_FEATURES = 8_000
#: An n-gram needs so many texts of the sample (either class) to be kept.
MIN_TEXTS = 3
SMOOTHING = 1.0
PENALTY = 0.5
THRESHOLD = 0.3

#: Characters whose n-grams are held at a time, text bytes counted at a time, and n-grams waiting to be merged.
PIECE = 1 << 16
COUNT_SLICE = 512 << 10
RUN = 1 << 19

#: n-grams are packed into 64 bits through these odd multipliers.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def code_points(text: str) -> np.ndarray:
    """Folded text as code points."""
    folded = f" {' '.join(text.lower().split())} "
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, sizes=SIZES, starts: int | None = None) -> list[np.ndarray]:
    """For each size, a 64-bit hash of the n-gram that starts at each of the first ``starts`` characters (all if None)."""
    points = points.astype(np.uint64)
    out, hashed = [], None
    for size in range(1, max(sizes) + 1):
        n = len(points) - size + 1
        if n <= 0:
            break
        hashed = points[:n] + MIX[1] if hashed is None else hashed[:n] * MIX[0] + points[size - 1:]
        hashed = hashed ^ (hashed >> np.uint64(32))
        if size in sizes:
            out.append(hashed[:starts] * MIX[1])
    return out


def piecewise(text: str | None):
    """``gram_hashes`` of a whole text, piece by piece; every n-gram belongs to the piece it starts in."""
    points = code_points(text or "")
    for a in range(0, len(points), PIECE):
        yield gram_hashes(points[a:a + PIECE + max(SIZES) - 1], starts=PIECE)


def distinct_grams(text: str | None) -> np.ndarray:
    found = np.empty(0, np.uint64)
    for grams in piecewise(text):
        if grams:
            own = np.unique(np.concatenate(grams))
            found = np.union1d(found, own) if len(found) else own
    return found


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run (keys, counts) of several."""
    keys, counts = (np.concatenate(c) for c in zip(*runs, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first)


def counted(batches):
    """Batches (gram, n0, n1) of batches (text, label), summed in sorted runs.

    A run's counts hold the texts of class 0 in the lower and those of class 1 in the upper 32 bits.
    """

    def out(run):
        keys, counts = run
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(counts & 0xFFFFFFFF), pa.array(counts >> 32)], names=["gram", "n0", "n1"])

    runs, held = [], 0
    for whole in batches:
        for batch in slices(whole, "text", COUNT_SLICE):
            own, size = [], 0
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = distinct_grams(text)
                own.append((grams, np.full(len(grams), 1 << 32 if label else 1, np.int64)))
                size += len(grams)
                if size > RUN:
                    own, size = [merged(own)], 0
            if size or len(own) == 1:
                runs.append(merged(own))
                held += len(runs[-1][0])
            if held > RUN:
                yield out(merged(runs))
                runs, held = [], 0
    if held:
        yield out(merged(runs))


def class_counts(sample: DataFrame) -> DataFrame:
    """(gram, n0, n1): texts of each class with the n-gram; summed per task before the shuffle."""
    return (sample.select("text", "label").mapInArrow(lean(counted), "gram long, n0 long, n1 long")
            .groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def present(texts: list[str | None], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature numbers of the kept n-grams (sorted hashes) in each text.

    A table of one byte per 16 hash bits drops most n-grams before the search.
    """
    if not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    door = np.zeros(1 << 18, bool)
    door[kept >> np.uint64(46)] = True
    rows, features = [], []
    for i, t in enumerate(texts):
        found = []
        for grams in piecewise(t):
            for g in grams:
                g = g[door[g >> np.uint64(46)]]
                at = np.minimum(np.searchsorted(kept, g), len(kept) - 1)
                found.append(np.unique(at[kept[at] == g]))
        if found:
            found = np.unique(np.concatenate(found))
            rows.append(np.full(len(found), i))
            features.append(found)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(features)


def fit_logistic(rows, columns, values, labels, width, penalty=PENALTY, steps=30):
    """Weights and bias of an L2-penalised logistic regression on sparse rows, by Newton with conjugate gradients."""
    n = len(labels)
    w = np.zeros(width + 1)
    reg = np.append(np.full(width, penalty), 1e-6)
    times = lambda v: np.bincount(rows, values * v[columns], n) + v[-1]
    back = lambda r: np.append(np.bincount(columns, values * r[rows], width), r.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -40, 40)))
        gradient = back(p - labels) + reg * w
        if np.abs(gradient).max() < 1e-4 * n:
            break
        curve = p * (1 - p)
        step, residual = np.zeros_like(w), -gradient
        direction, size = residual.copy(), residual @ residual
        for _ in range(50):
            pushed = back(curve * times(direction)) + reg * direction
            alpha = size / (direction @ pushed)
            step += alpha * direction
            residual -= alpha * pushed
            new = residual @ residual
            if new < 1e-8 * (gradient @ gradient):
                break
            direction, size = residual + direction * (new / size), new
        w += step
    return w[:-1], w[-1]


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows that are not held out.

    Rows are one per id, text and label, however often they stand in the tables; the ``bound`` smallest
    by hash of their id are taken.  The chosen keys are at most bound * 32 bytes, so they may be broadcast.
    """
    marked = (labels.select(F.col("doc_id").alias("id"), (F.col(label) > 0).cast("int").alias("label"))
              .filter(F.col("label").isNotNull() & F.col("id").isNotNull() & (bucket_of_id(F.col("id"), 4) != 2)).distinct())
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    chosen = (texts.drop("text").join(marked, F.col("doc_id") == F.col("id")).select("id", "k1", "k2", "label").distinct()
              .orderBy(F.xxhash64("id"), "id", "k1", "k2", "label").limit(bound).withColumnsRenamed({"k1": "c1", "k2": "c2"}))
    at = (F.col("doc_id") == F.col("id")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    return texts.join(F.broadcast(chosen), at).select("doc_id", "text", "label").distinct().select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labels: int = MAX_LABELS) -> dict:
    """The model: kept n-gram hashes (sorted), their weights, and a bias."""
    sample = sample_labelled(docs, labels, label, max_labels)
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    empty = {"kept": np.empty(0, np.uint64), "weights": np.empty(0), "bias": -40.0}
    if not n0 or not n1:
        return empty
    ratio = F.log(((F.col("n1") + SMOOTHING) / (n1 + 2 * SMOOTHING)) / ((F.col("n0") + SMOOTHING) / (n0 + 2 * SMOOTHING)))
    top = (class_counts(sample).withColumn("ratio", ratio).filter(F.col("n1") + F.col("n0") >= MIN_TEXTS)
           .withColumn("evidence", F.abs("ratio") * F.sqrt(F.greatest(F.col("n1") / n1, F.col("n0") / n0)))
           .orderBy(F.desc("evidence"), "gram").limit(MAX_FEATURES).select("gram", "ratio").toPandas())
    if not len(top):
        return empty
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    kept, ratios = grams[order], top["ratio"].to_numpy()[order]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                r, c = present(batch.column(0).to_pylist(), kept)
                cut = np.searchsorted(r, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array([c[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                    names=["label", "features"])

    data = sample.mapInArrow(lean(run), "label int, features binary").toPandas()
    features = [np.frombuffer(f, "<u2") for f in data["features"]]
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.concatenate(features).astype(np.int64)
    weights, bias = fit_logistic(rows, columns, ratios[columns], data["label"].to_numpy(float), len(kept))
    return {"kept": kept, "weights": weights * ratios, "bias": float(bias)}


def with_score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the score of each whole text."""
    kept, weights, bias = model["kept"], model["weights"], model["bias"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                r, c = present(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), kept)
                z = np.bincount(r, weights[c], batch.num_rows) + bias if len(r) else np.full(batch.num_rows, bias)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(lean(run), schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    return with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(bucket_of_id(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
