"""Ranked search against scoring every document; bounds hold; rows outside the candidates cannot rank."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridwatch.llm import lexical as X
from gridwatch.llm.common import load

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, k=50):
    bags = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    counted = [(i, len(w), Counter(w)) for i, w in bags if w]
    out = []
    for item, text in items:
        scores = []
        for i, n, c in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def result(docs, bench):
    return sorted([tuple(r) for r in X.search_query(docs, bench).collect()], key=str)


@pytest.mark.parametrize("chars", [1 << 19, 60])
def test_small_cases(spark, monkeypatch, chars):
    monkeypatch.setattr(X, "BLOCK_CHARS", chars)
    monkeypatch.setattr(X, "CELLS", 1 << 13)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "K9", "k9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 90])))) for i in range(240)]
    docs += [(1000 + i, "w1 w2 w3, W4!") for i in range(130)] + [(2000, None), (2001, ""), (2002, "!! \n"), (None, "w1 w2 w3, W4!"), (None, "w7")]
    docs += [(5, docs[5][1])] * 3 + [(2003, "w8 " * 30_000), (2004, "w9-w9_w9")]
    items = [(1, "w1 w2 w3 w4"), (2, None), (3, "!!"), (4, "absent"), (5, "K9, É é"), (None, "w5 w5 w6"), (7, "w8"), (7, "w8 w9"), (8, " ".join(vocabulary))]
    frame = spark.createDataFrame([(*r, 3, "q") for r in docs], "doc_id long, text string, score int, rank string")
    bench = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    assert result(frame.repartition(4), bench) == brute(docs, items)
    assert result(frame.limit(0), bench) == [] and result(frame, bench.limit(0)) == []


def test_one_common_term_and_ties(spark):
    docs = [(i, "same words here" if i % 2 else f"same u{i}") for i in range(400)]
    items = [(1, "same"), (2, "same words"), (3, "u8")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    assert result(frame, spark.createDataFrame(items, "item_id string, text string")) == brute(docs, [(str(i), t) for i, t in items])


def test_bounds_are_not_below_scores():
    rng = random.Random(2)
    bags = [Counter(f"t{rng.randint(0, 300)}".encode() for _ in range(rng.choice([5, 40, 200]))) for _ in range(64)]
    n = np.array([sum(b.values()) for b in bags])
    df = Counter(t for b in bags for t in b)
    items = [[f"t{rng.randint(0, 400)}".encode() for _ in range(12)] for _ in range(9)]
    q = X.Queries(items, len(bags), int(n.sum()), df)
    for bits in (64, 1024, 1 << 14):  # the smallest claims nearly every key
        matrix = np.zeros((64, bits), bool)
        for i, b in enumerate(bags):
            matrix[i, X.positions(X.signature_keys(b), bits)] = True
        bound = q.bounds().of(bits, n, np.packbits(matrix.T, axis=1).tobytes())
        exact = np.array([[q.score(i, b, X.damping(int(k), q.n_docs, q.total)) for b, k in zip(bags, n, strict=True)] for i in range(9)])
        assert (bound >= exact).all()
    assert bound.sum() < 1.5 * exact.sum()


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = load(spark, sf, "documents"), load(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert result(docs, bench) == want
