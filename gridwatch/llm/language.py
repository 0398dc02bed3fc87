"""Language identification with interpolated Kneser-Ney character models.

1. Texts are lower-cased, everything but letters becomes a space, and runs of spaces
   one space.  n-grams of ``ORDER`` characters are counted per language over all
   learning rows, whole texts: per Arrow batch first, then in Spark.
2. From these counts every language gets an interpolated Kneser-Ney model: continuation counts
   for the lower orders, absolute discounts, back-off weights.  The languages' n-grams
   are held together in one sorted array of hashes per order, with one column of log
   probabilities per language (``Model``), if that has at most ``8 * MAX_GRAMS`` log probabilities in its top order.
   Otherwise the same model stays in tables in the shared folder (``Tables``): the log probabilities of
   the most frequent n-grams, as many as that, are broadcast; those of the texts' other n-grams are joined.
3. A text's language is the one of the lowest cross-entropy per character.
4. Rejection is calibrated with a first model that lacks one learning row in ``CALIBRATION``: beyond the
   ``QUANTILE`` of a language's cross-entropies on these rows, the column ``rejected`` is true (the best
   language is still named).  The model that predicts has the counts of all learning rows, so a language of
   a single row is learnt too; a language without calibrating rows has no limit.

Defined results: a null text and one without letters give ``und`` with score 0; rows
of null id or null lang are not learnt from; a null id is not held out; without learning rows
every text is ``und``; of languages that tie, the first by name wins; repeated rows
are treated alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import bucket_of_id, slices, staged, worker_cache

ORDER = 4
#: For eight languages, the n-grams whose log probabilities are broadcast; it bounds memory, not the model.
MAX_GRAMS = 200_000
#: One learning row in so many calibrates; the first model does not count it.
CALIBRATION = 32
QUANTILE = 0.995
#: The confidence counts at most so many characters.
CONFIDENT = 40
BITS = np.uint64(16)
SPACE = 32


def letter_table() -> np.ndarray:
    """Each code point's number in n-grams: itself for letters (16 bits, folded beyond), a space for the rest."""
    cache = worker_cache()
    if "letters" not in cache:
        points = np.arange(0x110000, dtype=np.uint64)
        folded = np.where(points < 65536, points, (points * np.uint64(0x9E3779B1) >> np.uint64(8)) % np.uint64(60000) + np.uint64(5000))
        letters = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        cache["letters"] = np.where(letters, folded, SPACE).astype(np.uint16)
    return cache["letters"]


def letters(text: str | None, table: np.ndarray) -> np.ndarray:
    """A text's numbers with single spaces between words and at both ends; empty if it has no letter."""
    raw = table[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = raw != SPACE
    if not word.any():
        return raw[:0]
    keep = word.copy()
    keep[1:] |= word[:-1]
    raw = raw[keep]
    return np.concatenate([[SPACE], raw, [SPACE]] if raw[-1] != SPACE else [[SPACE], raw]).astype(np.uint16)


def grams(points: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each character but the first; the text is led in by spaces."""
    lead = np.full(ORDER - 2, SPACE, np.uint16)
    x = np.concatenate([lead, points]).astype(np.uint64)
    n = len(x) - ORDER + 1
    out = x[:n].copy()
    for j in range(1, ORDER):
        out = (out << BITS) | x[j:j + n]
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (lang, text)."""

    def run(batches):
        table = letter_table()
        for whole in batches:
            for batch in slices(whole, "text"):
                by_lang: dict[str, list] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    points = letters(text, table)
                    if len(points):
                        by_lang.setdefault(lang, []).append(grams(points))
                for lang, parts in by_lang.items():
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                        names=["lang", "gram", "n"])

    return (rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """Log probabilities of all languages over sorted arrays of n-grams.

    ``keys[n]`` are the n-grams of order n that some language has, ``logs[n]`` their log
    probabilities in every language; ``contexts[n]`` and ``weights[n]`` are the logs of the back-off weights.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        size = len(self.languages)
        own = [self.orders(*counts[lang]) for lang in self.languages]
        alphabet = len(np.unique(np.concatenate([o[1][0] for o in own]))) + 1 if own else 1
        self.keys, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        lower = np.full((1, size), 1 / alphabet)  # order 0: uniform
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([o[n][0] for o in own]))
            contexts = np.unique(keys >> BITS)
            weight = np.ones((len(contexts), size))
            probability = np.zeros((len(keys), size))
            for i, o in enumerate(own):
                k, c = o[n]
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                context, first, kinds = np.unique(k >> BITS, return_index=True, return_counts=True)
                total = np.add.reduceat(c, first).astype(float)
                weight[np.searchsorted(contexts, context), i] = discount * kinds / total
                probability[np.searchsorted(keys, k), i] = (c - discount) / np.repeat(total, kinds)
            below = lower[np.searchsorted(self.keys[n - 1], keys & ((np.uint64(1) << BITS * np.uint64(n - 1)) - np.uint64(1)))] if n > 1 else lower
            lower = probability + weight[np.searchsorted(contexts, keys >> BITS)] * below
            self.keys[n], self.logs[n] = keys, np.log(lower).astype(np.float32)
            self.contexts[n], self.weights[n] = contexts, np.log(weight).astype(np.float32)
        self.floor = np.float32(-np.log(alphabet))

    @classmethod
    def of(cls, arrays: dict) -> Model:
        """The model of another one's attributes."""
        out = cls.__new__(cls)
        out.__dict__.update(arrays)
        return out

    @staticmethod
    def orders(keys: np.ndarray, counts: np.ndarray) -> dict:
        """Counts of the top order, continuation counts of the others; keys sorted."""
        at = np.argsort(keys)
        out = {ORDER: (keys[at], counts[at].astype(np.int64))}
        for n in range(ORDER - 1, 0, -1):
            suffix = out[n + 1][0] & ((np.uint64(1) << BITS * np.uint64(n)) - np.uint64(1))
            out[n] = np.unique(suffix, return_counts=True)
        return out

    def lookup(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probabilities, one row per n-gram and one column per language."""
        if not n:
            return np.full((len(keys), len(self.languages)), self.floor)
        at = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
        out = self.logs[n][at]
        missing = np.flatnonzero(self.keys[n][at] != keys)
        if len(missing):
            rest = keys[missing]
            context = rest >> BITS
            at = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
            weight = np.where((self.contexts[n][at] == context)[:, None], self.weights[n][at], np.float32(0))
            out[missing] = weight + self.lookup(rest & ((np.uint64(1) << BITS * np.uint64(n - 1)) - np.uint64(1)), n - 1)
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character of each non-empty text in each language."""
        parts = [grams(t) for t in texts]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        sums = np.add.reduceat(self.lookup(np.concatenate(parts)).astype(np.float64), starts, axis=0)
        return -sums / np.array([len(p) for p in parts])[:, None]


def learning_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the rows that may be learnt from."""
    return docs.select("doc_id", "lang", "text").filter((bucket_of_id(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())


def calibrates():
    return F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0


class Tables:
    """The model of ``Model`` in tables, from counts (lang, gram, n) of any size.

    ``counts[n]``: (lang, gram, n); ``contexts[n]``: (lang, context, total, kinds); ``discounts[n]``: a number per language.
    ``keys`` and ``logs`` hold the log probabilities of the most frequent n-grams of the top order.
    """

    def __init__(self, counts: DataFrame, languages: list[str]):
        self.languages = languages
        self.counts, self.contexts, self.discounts = {ORDER: counts}, {}, {}
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                self.counts[n] = staged(self.counts[n + 1].groupBy("lang", suffix("gram", n).alias("gram")).agg(F.count("*").alias("n")), "grams")
            self.contexts[n] = staged(self.counts[n].groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(
                F.sum("n").alias("total"), F.count("*").alias("kinds")), "contexts")
            rare = self.counts[n].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
            self.discounts[n] = {r.lang: r.ones / (r.ones + 2 * r.twos) if r.ones and r.twos else 0.5 for r in rare}
        self.alphabet = self.counts[1].select("gram").distinct().count() + 1

        # The least count for which at most so many n-grams are held, from counts of counts.
        step = F.floor(F.log2("n") * 4)
        totals = counts.groupBy("gram").agg(F.sum("n").alias("n"))
        held, least = 0, None
        for r in totals.groupBy(step.alias("step")).agg(F.count("*").alias("grams")).orderBy(F.desc("step")).collect():
            held += r.grams
            if held > 8 * MAX_GRAMS // len(languages):
                break
            least = r.step
        self.keys, self.logs = np.empty(0, np.uint64), np.empty((0, len(languages)), np.float32)
        if least is not None:
            data = self.log_probabilities(totals.filter(step >= least).select("gram")).toArrow()
            keys = data.column("gram").to_numpy().view(np.uint64)
            logs = pa.compute.list_flatten(data.column("logs")).to_numpy().reshape(-1, len(languages))
            at = np.argsort(keys)
            self.keys, self.logs = keys[at], logs[at]

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, logs): log probabilities of distinct n-grams of the top order, in the order of the languages."""
        rows = grams.withColumn("lang", F.explode(F.array(*map(F.lit, self.languages)))).withColumn("p", F.lit(1 / self.alphabet))
        for n in range(1, ORDER + 1):
            discount = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(self.discounts[n].items()) for x in pair)), F.col("lang"))
            rows = (rows.withColumn("key", suffix("gram", n)).withColumn("context", F.shiftrightunsigned("key", 16))
                    .join(self.counts[n].withColumnRenamed("gram", "key"), ["lang", "key"], "left")
                    .join(F.broadcast(self.contexts[n]) if n == 1 else self.contexts[n], ["lang", "context"], "left")
                    .withColumn("p", F.when(F.col("total").isNull(), F.col("p")).otherwise(
                        (F.coalesce(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("p")) / F.col("total")))
                    .select("gram", "lang", "p"))
        return rows.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("lang", F.log("p").cast("float").alias("log")))).alias("logs")).select(
            "gram", F.col("logs.log").alias("logs"))

    def values(self, texts: DataFrame) -> DataFrame:
        """(k1, k2, length, values) of rows (k1, k2, text): once per text that has letters, its cross-entropies."""
        shared = texts.sparkSession.sparkContext.broadcast((self.keys, self.logs))
        size = len(self.languages)

        def run(batches):
            table, (keys, logs) = letter_table(), shared.value
            for whole in batches:
                for batch in slices(whole, "text", 2 << 20):
                    out = []
                    for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                        points = letters(text, table)
                        if not len(points):
                            continue
                        own, times = np.unique(grams(points), return_counts=True)
                        at = np.searchsorted(keys, own)
                        found = at < len(keys)
                        found[found] = keys[at[found]] == own[found]
                        known = times[found] @ logs[at[found]].astype(np.float64) if found.any() else np.zeros(size)
                        out.append((k1, k2, len(points), known.tolist(), own[~found].view(np.int64).tolist(), times[~found].tolist()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                            pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)],
                            names=["k1", "k2", "length", "known", "missed", "times"])

        kind = "k1 long, k2 long, length long, known array<double>, missed array<long>, times array<long>"
        # Rows of one text are equal, so any of them will do.
        parts = staged(texts.select("k1", "k2", "text").mapInArrow(run, kind).groupBy("k1", "k2").agg(
            *(F.first(c).alias(c) for c in ("length", "known", "missed", "times"))), "texts")
        missed = parts.select("k1", "k2", F.explode(F.arrays_zip("missed", "times")).alias("m")).select("k1", "k2", "m.missed", "m.times")
        logs = staged(self.log_probabilities(missed.select(F.col("missed").alias("gram")).distinct()), "logs")
        rest = (missed.join(logs, F.col("missed") == F.col("gram")).groupBy("k1", "k2")
                .agg(F.array(*(F.sum(F.col("times") * F.col("logs")[i]) for i in range(size))).alias("rest")))
        # ``grams`` gives one n-gram less than points.
        return parts.join(rest, ["k1", "k2"], "left").select("k1", "k2", "length", F.zip_with(
            "known", F.coalesce("rest", F.array_repeat(F.lit(0.0), size)), lambda x, y: -(x + y) / (F.col("length") - 1)).alias("values"))


def suffix(gram: str, n: int):
    """The last ``n`` characters of n-grams."""
    return F.col(gram) if n == ORDER else F.col(gram).bitwiseAND(F.lit((1 << 16 * n) - 1))


def model_of(counts: DataFrame) -> Model | Tables | None:
    """The model of counts (lang, gram, n), in memory if it is small; both forms give the same probabilities."""
    sizes = {r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    if sum(sizes.values()) * len(languages) > 8 * MAX_GRAMS:
        return Tables(counts, languages)
    data = counts.toArrow()
    by_lang = {}
    for lang in languages:
        part = data.filter(pa.compute.equal(data.column("lang"), lang))
        by_lang[lang] = (part.column("gram").to_numpy().view(np.uint64), part.column("n").to_numpy())
    return Model(by_lang)


def train(docs: DataFrame) -> dict:
    """The model and the cross-entropy of each language beyond which a text is rejected."""
    rows = learning_rows(docs)
    part = F.when(calibrates(), "1").otherwise("0")
    counts = staged(count_grams(rows.withColumn("lang", F.concat(part, "lang"))), "grams").select(
        F.substring("lang", 1, 1).alias("part"), F.expr("substring(lang, 2)").alias("lang"), "gram", "n")
    first = {"model": model_of(counts.filter("part = '0'").drop("part")), "limits": {}}
    limits = {}
    if first["model"] is not None:
        seen = identify(rows.filter(calibrates()).select("doc_id", "text"), first).filter("lang_pred <> 'und'")
        limits = {r.lang_pred: r.limit for r in seen.groupBy("lang_pred").agg(
            F.percentile_approx("cross_entropy", QUANTILE, 1000).alias("limit")).collect()}
    every = staged(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return {"model": model_of(every), "limits": limits}


PREDICTED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def decide(values: np.ndarray, lengths: list[int], languages: list[str], limits: dict) -> list[tuple]:
    """(lang_pred, score, cross_entropy, rejected) from the texts' cross-entropies in each language."""
    best = values.argmin(axis=1)
    low = values[np.arange(len(values)), best]
    odds = 1 / np.exp((low[:, None] - values) * np.minimum(lengths, CONFIDENT)[:, None]).sum(axis=1)
    names = [languages[b] for b in best]
    return [(n, s, h, h > limits.get(n, float("inf"))) for n, s, h in zip(names, odds.tolist(), low.tolist(), strict=True)]


def columns_of(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy (nats per character) and rejected."""
    if isinstance(model["model"], Tables):
        return identify_joined(docs, model, text_col)
    # Plain arrays only: a broadcast object's class would have to be installed on the executors, while
    # this function is shipped with the class.
    shared = docs.sparkSession.sparkContext.broadcast((None if model["model"] is None else vars(model["model"]), model["limits"]))

    def run(batches):
        table, (arrays, limits) = letter_table(), shared.value
        known = None if arrays is None else Model.of(arrays)
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                texts = [letters(t, table) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                out = [("und", 0.0, None, True)] * len(texts)
                rows = [i for i, t in enumerate(texts) if len(t)]
                if known is not None and rows:
                    found = decide(known.entropies([texts[i] for i in rows]), [len(texts[i]) for i in rows], known.languages, limits)
                    for i, r in zip(rows, found, strict=True):
                        out[i] = r
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns_of(out)],
                                                 names=[*batch.schema.names, "lang_pred", "score", "cross_entropy", "rejected"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), PREDICTED])
    return docs.mapInArrow(run, schema)


def identify_joined(docs: DataFrame, model: dict, text_col: str) -> DataFrame:
    """``identify`` with a model in tables; texts are known by a 128-bit hash."""
    k1, k2 = F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)
    languages, limits = model["model"].languages, model["limits"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = decide(np.array(batch.column(3).to_pylist()), batch.column(2).to_pylist(), languages, limits)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns_of(found)],
                                                 names=["__k1", "__k2", "__lang", "__score", "__entropy", "__rejected"])

    found = model["model"].values(docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))).mapInArrow(
        run, "__k1 long, __k2 long, __lang string, __score double, __entropy double, __rejected boolean")
    return docs.withColumn("__h1", k1).withColumn("__h2", k2).join(
        found, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left").select(
        *(F.col(f"`{c}`") for c in docs.columns), F.coalesce("__lang", F.lit("und")).alias("lang_pred"), F.coalesce("__score", F.lit(0.0)).alias("score"),
        F.col("__entropy").alias("cross_entropy"), F.coalesce("__rejected", F.lit(True)).alias("rejected"))


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every document."""
    return identify(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id", F.coalesce(bucket_of_id(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score",
        "cross_entropy", "rejected")
