"""Exact dedup: the code round-trips, results equal brute force."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwatch.llm import exact_dedup as E
from gridwatch.llm.common import load


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=200))
def test_rice_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    k, blob = E.rice_encode(values)
    assert (E.rice_decode(k, len(values), blob) == values).all()


def test_owners_hold_ranges():
    prints = np.sort(np.random.default_rng(1).integers(0, 2**64, 10000, dtype=np.uint64))
    for owners in (1, 16, 37):
        own = E.owner_of(prints, owners)
        assert (np.diff(own) >= 0).all() and (E.owner_start(own, owners) <= prints).all()
        assert (E.owner_of(E.owner_start(np.arange(owners), owners), owners) == np.arange(owners)).all()


def brute(rows):
    low = str.maketrans(E.UPPER, E.LOWER)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    out, taken = [], set()
    for i, t in rows:
        t = (t or "").translate(low)
        keep = max((x for x in groups[t] if x is not None), default=None)
        stays = i == keep and t not in taken  # one of the rows that repeat the id
        if stays:
            taken.add(t)
        out.append((i, keep, len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in E.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_small_cases(spark, monkeypatch):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "a b"), (None, "n"), (8, "x " * 50000),
            (9, "X " * 50000), (10, "once"), (10, "other text of one id"), (11, "t"), (11, "t"), (None, "u"), (None, "U")] + [(100 + i, "Hot") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, __chunk int, kept string")
    assert result(df.repartition(5)) == brute(rows)


def test_empty(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_with_carried_columns(spark):
    df = load(spark, "/root/testdata/sf0.001", "documents")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    got = E.exact_dedup(df, carry=("text", "source")).collect()
    texts = {r.doc_id: (r.text, r.source) for r in df.collect()}
    assert all(texts[r.doc_id] == (r.c0, r.c1) for r in got)


def test_worker_memory_is_given_back(monkeypatch):
    """A task releases what its allocators hold when its input ends, and when its reader stops early."""
    from gridwatch.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    task = common.lean(lambda batches: (2 * b for b in batches))
    assert list(task(iter([1, 2, 3]))) == [2, 4, 6] and len(calls) == 1
    begun = task(iter([1, 2, 3]))
    next(begun)
    begun.close()
    assert len(calls) == 2


def test_exchange_reads_small_batches(spark, monkeypatch):
    """Whole texts reach the exchange in small Arrow batches; the caller's setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, seen = spark.conf.get(key), []
    made = E.bucketed
    monkeypatch.setattr(E, "bucketed", lambda *a: (seen.append(int(spark.conf.get(key))), made(*a))[1])
    rows = E.exact_dedup(spark.createDataFrame([(1, "A"), (2, "a"), (3, None)], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    assert seen == [1024] and spark.conf.get(key) == old
