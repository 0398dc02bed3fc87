"""Sequence packing along a space-filling curve.

1. Each document is tokenised and its tokens are hashed into a signed vector of
   ``HASHED`` components, which is projected to ``DIMS`` dimensions and
   quantised; the cell's position on a Hilbert curve is the document's key.
   Token ids and keys are written once to the shared folder.
2. Spark sorts the table by range of the key (ties spread by a hash of the id, so
   that a large group of equal texts is split over partitions).
3. Each partition is cut, in curve order, into sequences of ``capacity`` tokens.
   What is left at a partition's end is cut into sequences whose lengths are
   powers of two, so nothing is padded.

Memory per task is one Arrow batch and one open sequence.  Documents longer than
``SEGMENT`` tokens travel as several rows.

Defined results: null text counts as empty and gives the single end id; a null
id is packed like any other; repeated rows are packed once each; extra columns
are ignored.  A text that holds the string of a token that the tokenizer file adds (``<|endoftext|>``)
goes through encode() whole, so its ids are the library's with add_special_tokens=False.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import lean, slices, staged, worker_cache

CAPACITY = 4096
END_ID = 2
HASHED, DIMS, BITS = 1024, 4, 12
#: Tokens of a document in one row of the staged table at most.
SEGMENT = 1 << 16
#: Hashed vectors held at a time.
BLOCK = 1024
#: Bytes in each of the two generations of a worker's cache of words: text, ids and about
#: ``ENTRY`` bytes for the two objects and their place in the dict.
CACHE_BYTES = 48 << 20
ENTRY = 200

#: White space that the fast path and the tokenizer's \s both split at, and
#: control characters at which only str.split() splits.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words of which Python's lower-casing and categories equal the tokenizer's for sure.
PLAIN_WORD = re.compile("[\x00-ɏ]+")


def plain_split(pattern: str):
    """findall() of a pattern on lower-cased plain words, by the faster ``re`` where its classes name only letters and numbers."""
    import regex

    chars = sorted({x for c in range(0x250) for x in chr(c) + chr(c).lower()})  # some lower-case letters lie beyond
    classes = {rf"\p{{{kind}}}": "".join(re.escape(x) for x in chars if regex.match(rf"\p{{{kind}}}", x)) for kind in "LN"}
    if "\\p" in re.sub(r"\[[^\[\]]*\]", "", pattern):
        return regex.compile(pattern).findall
    for name, members in classes.items():
        pattern = pattern.replace(name, members)
    return regex.compile(pattern).findall if "\\p" in pattern else re.compile(pattern).findall


class WordTokenizer:
    """Token ids of whole texts, through a cache of words.

    Where the tokenizer drops white space and never looks across it (NFC,
    white-space folding, lower-casing, a split by one pattern, byte-level BPE),
    a text's ids are the ids of its words in turn.  Any other tokenizer, and any
    text with unusual separators, goes through the library's encode() whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(added)) if added else None
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        normal = [(x["type"], x.get("pattern")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            normal == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and before[0].get("behavior") == "Removed" and before[0].get("invert")
            and not before[1].get("add_prefix_space") and not before[1].get("use_regex", True)
            and spec.get("post_processor") is None and spec["model"]["type"] == "BPE")
        if self.by_word:
            self.split = plain_split(before[0]["pattern"]["Regex"])
            self.model = self.full.model
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.packed = [self.pack([i]) for i in range(self.full.get_vocab_size())]
        # Two generations: when the younger is full, it becomes the older one.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def part(self, part: str) -> bytes:
        """Ids of one part that the tokenizer's own pattern splits off, in lower case."""
        ids = self.words.get(part)
        if ids is None:
            ids = self.older.get(part)
            if ids is None:
                shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.alphabet)
                one = self.packed
                ids = b"".join([one[t.id] for t in self.model.tokenize(shown)])
            self.keep(part, ids)
        return ids

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            if word.isalpha():
                return self.part(word.lower())
            if word[:-1].isalpha():
                return self.part(word[:-1].lower()) + self.part(word[-1])
        if len(word) <= 256 and PLAIN_WORD.fullmatch(word):
            return b"".join(map(self.part, self.split(word.lower())))
        return self.pack(self.full.encode(word, add_special_tokens=False).ids)

    def keep(self, word: str, ids: bytes) -> None:
        if len(word) <= 64 and word not in self.words:
            self.words[word] = ids
            self.held += ENTRY + len(word) + len(ids)

    def text(self, text: str) -> bytes:
        """Ids as little-endian bytes of ``dtype``."""
        if not self.by_word or ODD_SPACE.search(text) or (self.added and self.added.search(text)):
            return self.pack(self.full.encode(text, add_special_tokens=False).ids)
        # Words that differ in case only share an entry; beyond ASCII lower-casing is left to each word.
        words = (text.lower() if text.isascii() else text).split()
        if self.held > CACHE_BYTES:
            self.older, self.words, self.held = self.words, {}, 0
        known, older = self.words.get, self.older.get
        out = list(map(known, words))
        for at in [i for i, ids in enumerate(out) if ids is None]:
            word = words[at]
            ids = known(word)
            if ids is None:
                ids = older(word)
                if ids is None:
                    ids = self.word(word)
                self.keep(word, ids)
            out[at] = ids
        return b"".join(out)


def hash_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Component and sign of each token id in the hashed vector."""
    x = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(HASHED)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((HASHED, DIMS))


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells, one row each, ``bits`` bits a dimension.

    Cells are turned into the curve's transposed index bit plane by bit plane:
    undo the reflections and exchanges from the highest plane down, then decode
    the Gray code, then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for i in range(dims):
            on = (x[i] >> plane) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


def curve_position(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed document vectors."""
    y = np.empty((len(vectors), matrix.shape[1]))
    for a in range(0, len(vectors), 64):  # few enough to stay in the processor's cache
        some = vectors[a:a + 64]
        some = np.copysign(np.sqrt(np.abs(some)), some)
        some /= np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-12)
        y[a:a + 64] = some @ matrix
    cells = np.floor((1 << BITS) / (1 + np.exp(-1.702 * y))).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, start, doc_tokens, curve, tie, ids): segments of documents with their curve keys."""

    def run(batches):
        cache = worker_cache()
        tokenizer = cache.get(("tokenizer", tokenizer_path))
        if tokenizer is None:
            tokenizer = cache[("tokenizer", tokenizer_path)] = WordTokenizer(tokenizer_path)
        table, sign = hash_table(max(END_ID + 1, tokenizer.full.get_vocab_size()))
        matrix = projection()
        end = tokenizer.pack([END_ID])
        width = tokenizer.dtype.itemsize
        for whole in batches:
            for batch in slices(whole, "text"):
                packed = [tokenizer.text(t or "") for t in batch.column(2).to_pylist()]
                curve = np.empty(len(packed), np.int64)
                for a in range(0, len(packed), BLOCK):
                    vectors = np.zeros((len(packed[a:a + BLOCK]), HASHED))
                    for i, p in enumerate(packed[a:a + BLOCK]):
                        ids = np.frombuffer(p, tokenizer.dtype)
                        vectors[i] = np.bincount(table[ids], sign[ids], HASHED)
                    curve[a:a + BLOCK] = curve_position(vectors, matrix)
                rows, start, ids = [], [], []
                for i, p in enumerate(packed):
                    p += end
                    for a in range(0, len(p), SEGMENT * width):
                        rows.append(i)
                        start.append(a // width)
                        ids.append(p[a:a + SEGMENT * width])
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), pa.array(start, pa.int64()),
                    pa.array([len(p) // width + 1 for p in packed], pa.int64()).take(rows),
                    pa.array(curve, pa.int64()).take(rows), batch.column(1).take(rows), pa.array(ids, pa.binary()),
                    pa.array([width] * len(rows), pa.int32()),
                ], names=["doc_id", "start", "doc_tokens", "curve", "tie", "ids", "width"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("tie"),
                         F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        lean(run), f"doc_id {id_type}, start long, doc_tokens long, curve long, tie long, ids binary, width int")


class Packer:
    """Cuts a stream of id runs into sequences; at the end, the rest into powers of two."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: list[tuple] = []
        self.filled = 0

    def add(self, doc, start: int, total: int, ids: np.ndarray):
        """Pieces (doc, start, total, ids, sequence, offset) of all sequences that became full."""
        while len(ids):
            take = min(len(ids), self.capacity - self.filled)
            self.open.append((doc, start, total, ids[:take], self.sequence, self.filled))
            self.filled += take
            start, ids = start + take, ids[take:]
            if self.filled == self.capacity:
                yield from self.open
                self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def rest(self):
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        room = 0
        for doc, start, total, ids, _, _ in rest:
            while len(ids):
                if not room:
                    room = size = 1 << (left.bit_length() - 1)
                    left -= size
                take = min(len(ids), room)
                yield doc, start, total, ids[:take], self.sequence, size - room
                start, ids, room = start + take, ids[take:], room - take
                self.sequence += not room


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset."""
    source = tokenised(docs, tokenizer_path, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def out(pieces):
            return pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pieces], ids_type), *(pa.array(c, pa.int64()) for c in (
                    [p[1] for p in pieces], [len(p[3]) for p in pieces])),
                pa.array([p[3].astype("<u4").tobytes() for p in pieces], pa.binary()),
                *(pa.array([p[i] for p in pieces], pa.int64()) for i in (2, 4, 5)),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        pieces, size, ids_type = [], 0, None
        for batch in batches:
            ids_type = batch.column(0).type
            for doc, start, total, ids, width in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for p in packer.add(doc, start, total, np.frombuffer(ids, f"<u{width}")):
                    pieces.append(p)
                    size += len(p[3])
                    if size > 1 << 20:
                        yield out(pieces)
                        pieces, size = [], 0
        pieces += packer.rest()
        if pieces:
            yield out(pieces)

    order = ["curve", "tie", "doc_id", "start"]
    return (staged(source, "packing").withColumn("same", F.xxhash64("ids"))
            .repartitionByRange(*order).sortWithinPartitions(*order, "same")
            .select("doc_id", "start", "doc_tokens", "ids", "width")
            .mapInArrow(lean(run), f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, "
                             "sequence_id long, offset long"))


def packing_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digest columns of ``pack_sequences``."""
    return pack_sequences(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
