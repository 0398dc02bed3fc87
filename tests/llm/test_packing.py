"""Packing: ids equal the library's, every id lies in one piece, no padding, curve is continuous."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridwatch.llm import packing
from gridwatch.llm.common import load

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "a", "It's we'll 12 34th -- ***", "É élan ÀÇ straße ÿ İx", "combíning ́x", "tab\tnl\n\x0b\x0c\x85\xa0nbsp em",
    "fs\x1cgs\x1dend", "日本語 テキスト ΣΑΣ 'S", "<|endoftext|> x<|startoftext|>", "x" * 3000, "​zero﻿", "🙂🙃 ok",
]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(PATH)


def test_word_path_equals_library(full):
    t = packing.WordTokenizer(PATH)
    assert t.by_word
    for text in TEXTS + [" ".join(TEXTS), "".join(TEXTS)]:
        assert np.frombuffer(t.text(text), t.dtype).tolist() == full.encode(text, add_special_tokens=False).ids, text


def test_strings_of_added_tokens(full):
    """The fixed ids are those of the tokenizer file with add_special_tokens=False."""
    t = packing.WordTokenizer(PATH)
    assert np.frombuffer(t.text("end of page <|endoftext|> next"), t.dtype).tolist() == [806, 539, 2504, 49407, 1131]
    for text in ("a <|startoftext|> b", "x<|endoftext|><|endoftext|>y z", "A <|ENDOFTEXT|> b", "<|endoftext| >", "two  <|endoftext|>\n ends"):
        assert np.frombuffer(t.text(text), t.dtype).tolist() == full.encode(text, add_special_tokens=False).ids, text


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    t, fresh = packing.WordTokenizer(PATH), packing.WordTokenizer(PATH)
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(30))
        assert t.text(text) == fresh.text(text)
        assert len(t.words) + len(t.older) < 2 * (20_000 // packing.ENTRY + 200)


def test_plain_words_are_split_as_by_the_pattern(full):
    """The faster split finds the parts that the tokenizer's own pattern finds, for every plain character and pair of kinds."""
    import json

    import regex

    with open(PATH, encoding="utf-8") as f:
        pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    fast, slow = packing.plain_split(pattern), regex.compile(pattern)
    assert not isinstance(getattr(fast, "__self__", None), type(slow))
    chars = [chr(c) for c in range(0x250) if not 0x1c <= c <= 0x1f]
    for c in chars:
        for word in (c, f"a{c}", f"{c}1", f"-{c}é", f"{c}'s{c}", f"'{c}LL"):
            assert fast(word.lower()) == slow.findall(word.lower()), word
    # A class of one kind only, outside brackets, stays with the library.
    assert packing.plain_split(r"\p{L}+|x")("ab1é") == ["ab", "é"]
    t = packing.WordTokenizer(PATH)
    for text in ("Foo FOO foo, Foo.", "İstanbul ISTANBUL ſ ß", "".join(chars), " ".join(chars)):
        assert np.frombuffer(t.text(text), t.dtype).tolist() == full.encode(text, add_special_tokens=False).ids, text
    assert "foo" in t.words and "FOO" not in t.words


def test_curve_position_in_blocks():
    """A document's place on the curve doesn't depend on the documents it comes with."""
    vectors, matrix = np.random.default_rng(3).integers(-4, 5, (150, packing.HASHED)).astype(float), packing.projection()
    alone = np.concatenate([packing.curve_position(v[None], matrix) for v in vectors])
    assert (packing.curve_position(vectors, matrix) == alone).all()


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def check(rows, texts, full):
    """rows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    ids = {i: full.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        want = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(want) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_pieces(spark, full):
    texts = dict(enumerate(TEXTS + [None, "word " * 9000, "word " * 9000] + ["same text here"] * 40))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, ids string, curve int")
    check(packing.packing_query(df.repartition(3), PATH).collect(), texts, full)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packing_query(df, PATH).count() == 0


def test_null_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c")], "doc_id long, text string")
    rows = packing.packing_query(df, PATH).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 2


def test_documents(spark, full):
    df = load(spark, "/root/testdata/sf0.001", "documents")
    check(packing.packing_query(df, PATH).collect(), {r.doc_id: r.text for r in df.collect()}, full)
