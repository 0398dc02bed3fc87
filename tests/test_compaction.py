"""Folding stored stream batches: readers see the same rows before, between and after, and when a folded batch comes again."""

from datetime import datetime

import pytest

from gridwatch.streaming import near, sinks, windows
from gridwatch.streaming.sinks import BATCH_COL


def counts(spark, path):
    return {(r.window_start.day, r.incident_type): r.incidents for r in windows.read_window_counts(spark, path).collect()}


def put(spark, path, batch, rows):
    day = lambda d: datetime(2024, 1, d)
    (spark.createDataFrame([(day(d), day(d + 1), t, n) for d, t, n in rows],
                           "window_start timestamp_ntz, window_end timestamp_ntz, incident_type string, incidents long")
     .write.mode("overwrite").parquet(f"{path}/{BATCH_COL}={batch}"))


def test_window_counts(spark, scratch, monkeypatch):
    put(spark, scratch, "b1", [(1, "theft", 3), (2, None, 1)])
    put(spark, scratch, "b2", [(1, "theft", 4), (3, "arson", 2)])
    want = {(1, "theft"): 7, (2, None): 1, (3, "arson"): 2}
    assert counts(spark, scratch) == want
    with monkeypatch.context() as m:  # stopped between the two steps
        m.setattr(windows, "remove_path", lambda *a: None)
        windows.compact_window_counts(spark, scratch, "f1")
    assert counts(spark, scratch) == want
    windows.compact_window_counts(spark, scratch, "f2")
    assert counts(spark, scratch) == want
    assert spark.read.parquet(scratch).select(BATCH_COL).distinct().count() == 1
    put(spark, scratch, "b2", [(1, "theft", 4), (3, "arson", 2)])  # written again by its stream
    put(spark, scratch, "b3", [(1, "theft", 1)])
    want[1, "theft"] = 8
    assert counts(spark, scratch) == want
    windows.compact_window_counts(spark, scratch, "f3")
    assert counts(spark, scratch) == want
    with pytest.raises(ValueError):
        windows.compact_window_counts(spark, scratch, "f3")


def test_quarantine_is_a_set(spark, scratch):
    rows = spark.createDataFrame([(1, "a", "bad_hour"), (2, None, "missing_id")], "seq long, id string, reasons string")
    for batch in ("b1", "b2"):  # read under two checkpoints
        rows.write.parquet(f"{scratch}/quarantine/{BATCH_COL}={batch}")
    want = [(1, "a", "bad_hour"), (2, None, "missing_id")]
    read = lambda: sorted((r.seq, r.id, r.reasons) for r in sinks.read_quarantine(spark, scratch).collect())
    assert read() == want
    sinks.compact(spark, scratch, "quarantine", "f1")
    assert read() == want


def versions(spark, rows):
    return spark.createDataFrame([(s, i, y, -82.0, datetime(2024, 1, d, 12) if d else None) for s, i, y, d in rows],
                                 "seq long, id string, latitude double, longitude double, offense_date timestamp_ntz")


def links(spark, out):
    return sorted((r.id_a, r.id_b) for r in near.read_near(spark, out).collect())


@pytest.mark.parametrize("days", [None, ("2024-01-04", "2024-01-06")])
def test_near(spark, scratch, monkeypatch, days):
    sink = near.NearSink(scratch, "/ckpt/1", 500.0, 7)
    one = versions(spark, [(10, "a", 29.0, 5), (11, "b", 29.001, 6), (12, "c", 29.0, 25), (13, "d", None, 5), (14, "e", 29.0, None)])
    two = versions(spark, [(3, "b", 29.0, 20), (30, "a", 29.0, 24), (31, "d", 29.0, 5), (32, "f", 29.0, 4)])
    sink(one, 0)
    sink(two, 1)
    near.NearSink(scratch, "/ckpt/2", 500.0, 7)(one, 0)
    want = [("a", "f"), ("b", "c")]
    assert links(spark, scratch) == want
    with monkeypatch.context() as m:  # stopped before anything is deleted
        m.setattr(near, "remove_path", lambda *a: None)
        near.compact_near(spark, scratch, "f1", days)
    assert links(spark, scratch) == want
    near.compact_near(spark, scratch, "f2", days)
    assert links(spark, scratch) == want
    stored = spark.read.parquet(f"{scratch}/versions")
    if days is None:  # one version per incident is left, those without day or point too
        assert sorted((r.id, r.seq) for r in stored.collect()) == [("a", 10), ("b", 3), ("c", 12), ("d", 13), ("e", 14), ("f", 32)]
    assert spark.read.parquet(f"{scratch}/links").select(BATCH_COL).distinct().count() <= 1
    # A batch that was folded is tried again; new records meet the folded versions; the first version of e comes last.
    sink(two, 1)
    assert links(spark, scratch) == want
    sink(versions(spark, [(1, "e", 29.0, 19), (40, "g", 29.0, 6)]), 2)
    assert links(spark, scratch) == [("a", "f"), ("a", "g"), ("b", "c"), ("b", "e"), ("c", "e"), ("f", "g")]
    with pytest.raises(ValueError):
        near.compact_near(spark, scratch, "f2", days)


def test_near_links_once_and_after_failures(spark, scratch):
    """A record read again under another checkpoint is not linked again; a batch that failed before its links is."""
    from datetime import datetime

    from gridwatch.session import remove_path
    from gridwatch.streaming.sinks import run_token

    schema = "id string, seq long, latitude double, longitude double, offense_date timestamp_ntz"
    rows = [(f"i{n % 25}", n, 29.6 + n % 7 * 0.001, -82.3, datetime(2024, 1, 5 + n % 3)) for n in range(30)]
    one, two = (spark.createDataFrame(part, schema) for part in (rows[::2], rows[1::2]))
    sink, again = near.NearSink(scratch, "/ckpt/1", 500.0, 7), near.NearSink(scratch, "/ckpt/2", 500.0, 7)
    read = lambda: sorted(tuple(r) for r in near.read_near(spark, scratch).collect())
    stored = lambda key: spark.read.parquet(f"{scratch}/links").filter(f"batch = '{key}'").count()
    sink(one, 0)
    sink(two, 1)
    want = read()
    again(one, 0)
    assert want and read() == want and stored(f"{run_token('/ckpt/2')}_{0:012d}") == 0

    remove_path(spark, f"{scratch}/links/batch={run_token('/ckpt/1')}_{1:012d}")  # as if the second batch had failed there
    assert read() != want
    near.compact_near(spark, scratch, "f1")
    again(two, 1)
    assert read() == want
    sink(two, 1)  # the failed batch is tried again
    near.compact_near(spark, scratch, "f2", ("2024-01-05", "2024-01-05"))
    near.compact_near(spark, scratch, "f3")
    assert read() == want
    assert {r[0] for r in spark.read.parquet(f"{scratch}/versions").select("batch").distinct().collect()} == {"f3"}
