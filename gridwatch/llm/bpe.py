"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by a fixed pattern; each match (piece) is encoded separately.  A piece that is
a token is that token.  Otherwise its bytes are merged pair by pair, always the
leftmost pair of lowest rank:

* the leaves of a segment tree are the piece's byte positions; the leaf of a live part holds
  the rank of the pair that it forms with its right neighbour, together with its position;
* an inner node holds the least of its children, so the root is the leftmost minimum;
* a merge writes three leaves (the merged part, the part left of it, the part that
  went) and renews their paths to the root: O(log n) a merge, O(n log n) a piece.

Pieces do not depend on each other, so those of a slice of text whose lengths round up to the
same power of two are merged side by side, one merge of every piece per step (``merge_together``).  A
long piece is merged alone, on typed arrays (``merge_alone``): 41 bytes for each of its bytes.
Ids of short pieces are kept in a cache of at most ``CACHE_BYTES`` bytes in each of two generations.

Decoding joins the tokens' bytes.

Defined results: null counts as empty; an empty text has no ids and decodes to no bytes; a null id
is passed through; repeated rows give one result each; extra columns are ignored.  An id outside the
vocabulary raises an error when decoded.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import slices, worker_cache

#: Text bytes encoded at a time.
SLICE = 1 << 20
#: Longest piece merged side by side with others, and leaves of one such group at most.
TOGETHER = 256
LEAVES = 1 << 19
CACHE_BYTES = 24 << 20
#: Bytes of a cache entry besides its text and ids.
ENTRY = 240
#: Longest piece in the cache.
CACHED_PIECE = 64

SHIFT = 32
NONE = (1 << 62) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks by bytes, bytes by rank, and the rank of each pair of tokens whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        if len(self.tokens) != len(ranks):
            raise ValueError("two tokens of one rank")
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte without a rank")
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(self.pairs.values(), np.int64, len(keys))[order]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where the joined bytes are no token."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


def merge_together(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of pieces of 2 to ``width`` bytes (a power of two); row i of every array belongs to piece i."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    place = np.arange(width)
    live = place < lengths[:, None]
    # One column more: position ``width`` is the end, where writes do no harm.
    token = np.full((n, width + 1), -1, np.int64)
    token[:, :width] = np.where(live, vocabulary.single[padded], -1)
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    after = np.where(after >= lengths[:, None], width, after)

    def key(rows, at):
        """Leaf of a part: the rank of its pair and its position; NONE without a right neighbour or a rank."""
        following = after[rows, at]
        rank = vocabulary.pair_rank(token[rows, at], token[rows, following])
        return np.where((following < width) & (rank < NONE), rank << SHIFT | at, NONE)

    tree = np.full((n, 2 * width), NONE, np.int64)
    rows, at = np.nonzero(live)
    tree[rows, width + at] = key(rows, at)
    level = width
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & ((1 << SHIFT) - 1)
        gone = after[rows, at]
        token[rows, at] = root >> SHIFT
        token[rows, gone] = -1
        following = after[rows, gone]
        after[rows, at] = following
        inner = following < width
        before[rows[inner], following[inner]] = at[inner]
        tree[rows, width + at] = key(rows, at)
        tree[rows, width + gone] = NONE
        left = before[rows, at]
        has = left >= 0
        tree[rows[has], width + left[has]] = key(rows[has], left[has])
        paths = [width + at, width + gone, width + np.maximum(left, 0)]
        while paths[0][0] > 1:
            paths = [p >> 1 for p in paths]
            for p in paths:
                tree[rows, p] = np.minimum(tree[rows, 2 * p], tree[rows, 2 * p + 1])
        rows = rows[tree[rows, 1] < NONE]
    kept = token[:, :width]
    return [row[row >= 0] for row in kept]


def merge_alone(piece: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of one long piece."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    first = vocabulary.single[np.frombuffer(piece, np.uint8)]
    token = array("q", first.tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    leaves = np.full(2 * width, NONE, np.int64)
    rank = vocabulary.pair_rank(first[:-1], first[1:])
    leaves[width:width + n - 1] = np.where(rank < NONE, rank << SHIFT | np.arange(n - 1), NONE)
    level = width
    while level > 1:
        leaves[level // 2:level] = np.minimum(leaves[level:2 * level:2], leaves[level + 1:2 * level:2])
        level //= 2
    tree = array("q", leaves.tobytes())
    pairs, mask = vocabulary.pairs, (1 << SHIFT) - 1

    def write(at, value):
        """A point update; it ends where a node keeps its value."""
        at += width
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            least = value if value < other else other
            at >>= 1
            if tree[at] == least:
                return
            tree[at] = value = least

    while tree[1] < NONE:
        at = tree[1] & mask
        merged = tree[1] >> SHIFT
        gone = after[at]
        token[at], token[gone] = merged, -1
        following = after[at] = after[gone]
        write(gone, NONE)
        if following < n:
            before[following] = at
            r = pairs.get(merged << SHIFT | token[following])
            write(at, NONE if r is None else r << SHIFT | at)
        else:
            write(at, NONE)
        left = before[at]
        if left >= 0:
            r = pairs.get(token[left] << SHIFT | merged)
            write(left, NONE if r is None else r << SHIFT | left)
    ids = np.frombuffer(token, np.int64)
    return ids[ids >= 0]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list = [None] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            out[i] = np.array([whole])
        elif len(piece) > TOGETHER:
            out[i] = merge_alone(piece, vocabulary)
        elif piece:
            by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        else:
            out[i] = np.empty(0, np.int64)
    for width, at in by_width.items():
        step = max(1, LEAVES // width)
        for a in range(0, len(at), step):
            group = at[a:a + step]
            for i, ids in zip(group, merge_together([pieces[i] for i in group], width, vocabulary), strict=True):
                out[i] = ids
    return out


class Codec:
    """Encoder and decoder of whole texts for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids (int32 bytes) of pieces that the younger generation lacks; short ones are kept."""
        out = {p: self.older[p] for p in pieces if p in self.older}
        fresh = sorted(pieces - out.keys())
        for p, ids in zip(fresh, encode_pieces([p.encode() for p in fresh], self.vocabulary), strict=True):
            out[p] = ids.astype("<i4").tobytes()
        if self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        for p, ids in out.items():
            if len(p) <= CACHED_PIECE:
                self.known[p] = ids
                self.held += ENTRY + len(p) + len(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; pieces that are new are merged side by side."""
        split = [self.split(text or "") for text in texts]
        ids = [list(map(self.known.get, pieces)) for pieces in split]
        new = {p for pieces, own in zip(split, ids, strict=True) if None in own for p, i in zip(pieces, own, strict=True) if i is None}
        if new:
            found = self.learn(new)
            ids = [[found[p] if i is None else i for p, i in zip(pieces, own, strict=True)] if None in own else own
                   for pieces, own in zip(split, ids, strict=True)]
        return [b"".join(own) for own in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def worker_codec(path: str, pattern: str) -> Codec:
    """The worker's codec; one of another rank file or pattern is dropped first."""
    cache = worker_cache()
    if cache.get("bpe", (None,))[0] != (path, pattern):
        cache.pop("bpe", None)
        cache["bpe"] = ((path, pattern), Codec(read_ranks(path), pattern))
    return cache["bpe"][1]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the token ids of each whole text."""

    def run(batches):
        codec = worker_codec(rank_path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids = codec.encode(batch.column(1).to_pylist())
                offsets = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with one more column: the bytes that the token ids stand for (null ids: none)."""

    def run(batches):
        codec = worker_codec(rank_path, pattern)
        for whole in batches:
            at = whole.schema.get_field_index(ids_col)
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                texts = [codec.decode(ids.values.to_numpy().tolist()) if ids.is_valid else b"" for ids in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` binary"])
    return rows.mapInArrow(run, schema)


def bpe_query(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Digest columns of ``encode`` and ``decode``: n_tokens, ids_sha256, decoded_sha256."""
    return decode(encode(docs, rank_path, pattern), rank_path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
