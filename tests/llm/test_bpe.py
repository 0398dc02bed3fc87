"""Byte-level BPE against the tiktoken library and against a plain merge loop; exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridwatch.llm import bpe
from gridwatch.llm.common import load

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", "a", " ", "It's we'll 12 34th -- ***", "É élan ÀÇ straße ÿ", "tab\tnl\n\x0b\x0c\x85\xa0nbsp  \n\n x ", "fs\x1cgs\x1d",
         "日本語 テキスト ΣΑΣ 'S", "<|endoftext|> x", "x" * 3000, "ab" * 700, "🙂🙃 ok", "\x00\x01", "combíning ́", "1234567890" * 40, " \n" * 600]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), PATTERN)


def ids_of(codec, texts):
    return [np.frombuffer(i, "<i4").tolist() for i in codec.encode(texts)]


def test_equals_library(codec, library):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices(["a", "b", "é", "日", "🙂", " ", "\n", "1", "!", "ñ", "́", "'s", "th"], k=rng.randint(0, 300)))
                     for _ in range(500)]
    assert ids_of(codec, texts) == [library.encode_ordinary(t) for t in texts]
    assert all(codec.decode(i).decode() == t for i, t in zip(ids_of(codec, texts), texts, strict=True))


def plain(piece, ranks):
    """Always the leftmost pair of lowest rank, found by looking at all pairs."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_both_trees_equal_a_plain_loop():
    """Small vocabularies in which a merge may give a pair of lower rank than its own."""
    rng = random.Random(5)
    for _ in range(40):
        words = list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(25)})
        rng.shuffle(words)
        ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + words)}
        v = bpe.Vocabulary(ranks)
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(2, 70))) for _ in range(40)]
        want = [plain(p, ranks) for p in pieces]
        assert [i.tolist() for i in bpe.encode_pieces(pieces, v)] == want
        alone = [p for p in pieces if p not in ranks]
        assert [bpe.merge_alone(p, v).tolist() for p in alone] == [plain(p, ranks) for p in alone]


def test_long_piece(codec, library):
    for text in ("a" * 60_000, "".join(random.Random(1).choices("etaoin", k=60_000))):
        assert ids_of(codec, [text]) == [library.encode_ordinary(text)]


def test_cache_is_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    small = bpe.Codec(codec.vocabulary.ranks, PATTERN)
    for i in range(60):
        text = " ".join(f"word{chr(97 + i % 26)}{j}q" for j in range(40))
        assert ids_of(small, [text]) == [library.encode_ordinary(text)]
        assert len(small.known) + len(small.older) < 2 * (20_000 // bpe.ENTRY + 200)


def test_bad_vocabularies():
    with pytest.raises(ValueError, match="without a rank"):
        bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError, match="one rank"):
        bpe.Vocabulary({b"a": 0, b"b": 0})


def digests(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, library):
    rows = [*enumerate(TEXTS), (100, None), (None, "null id"), (7, TEXTS[7]), (101, "long " * 80_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, decoded int")
    got = sorted(map(tuple, bpe.bpe_query(df.repartition(3), PATH, PATTERN).collect()), key=str)
    assert got == sorted(((i, *digests(t, library)) for i, t in rows), key=str)
    assert bpe.bpe_query(df.limit(0), PATH, PATTERN).count() == 0


def test_documents(spark, library):
    df = load(spark, "/root/testdata/sf0.001", "documents")
    got = {tuple(r) for r in bpe.bpe_query(df, PATH, PATTERN).collect()}
    assert got == {(r.doc_id, *digests(r.text, library)) for r in df.collect()}
