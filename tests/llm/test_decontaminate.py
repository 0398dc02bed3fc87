"""Decontamination against brute force; several blocks give the result of one."""

import hashlib

import pytest

from gridwatch.llm import decontaminate as D
from gridwatch.llm.common import load


def words(text):
    return [m.group() for m in D.WORD.finditer((text or "").translate(D.LOWER))]


def brute(docs, items):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            size = min(10, len(v))
            grams = {tuple(v[j:j + size]) for j in range(len(v) - size + 1)} if v else set()
            for j in range(len(w) - size + 1):
                if tuple(w[j:j + size]) in grams:
                    hit |= set(range(j, j + size))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(docs, bench):
    return sorted([tuple(r) for r in D.decontamination_query(docs, bench).collect()], key=str)


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, "Short, ITEM"), (10, LONG), (2, "short item"), (3, None), (4, "!!"), (None, "null id item"), (5, "é É x"), (5, "é É x")]
DOCS = [(1, "a SHORT item b shortitem"), (2, LONG.upper() + "." + LONG), (3, None), (4, ""), (5, "short\n\titem short-item"),
        (6, " ".join(f"w{i}" for i in range(5, 17))), (None, "the null id, item"), (7, "é É X"), (7, "é É X"), (8, "É é x"),
        (9, "w1 w2 " + LONG * 2), (11, "unshort item"), (12, "x" * 100000 + " short item")]


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_small_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BLOCK_CHARS", limit)
    docs = spark.createDataFrame([(*r, 5, ["q"]) for r in DOCS], "doc_id long, text string, n_words int, items array<string>")
    bench = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int")
    assert result(docs.repartition(3), bench) == brute(DOCS, ITEMS)


def test_spans_are_of_the_original(spark):
    text = "é🙂, SHORT—item! Short  Item?"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "short item")], "item_id long, text string")
    spans = D.contamination(docs, bench).first()["spans"]
    assert [text[s["start"]:s["end"]] for s in spans] == ["Short  Item"]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert result(docs, bench) == brute([(1, "a")], [])
    assert D.decontamination_query(docs.limit(0), bench).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = load(spark, sf, "documents"), load(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[-1] for r in want) and result(docs, bench) == want


def test_worker_keeps_one_automaton(spark):
    """Two calls of one benchmark share an automaton; another benchmark replaces it."""
    docs = spark.createDataFrame([(1, "a short item"), (2, "none")], "doc_id long, text string")
    for words_, hits in (("short item", 1), ("short item", 1), ("none", 1), ("short", 1)):
        bench = spark.createDataFrame([(1, words_)], "item_id long, text string")
        assert sum(r.contaminated for r in D.decontamination_query(docs, bench).collect()) == hits
    D.worker_cache().pop("automaton", None)
    first = D.kept_automaton([("1", " a b ")], "x")
    assert D.kept_automaton([("1", " a b ")], "x") is first
    assert D.kept_automaton([("1", " c ")], "y") is not first
    assert D.worker_cache()["automaton"][0] == "y" and sum("automaton" in str(k) for k in D.worker_cache()) == 1
    D.worker_cache().pop("automaton")
