"""Streaming equals batch; replays and retried batches are idempotent."""

from pyspark.sql import functions as F

from gridwatch.operators import clean, facts, graph
from gridwatch.sources import standin
from gridwatch.streaming import runner, sinks, source

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _batch_fact(spark):
    t = clean.type_incidents(standin.incident_payloads(spark, SF))
    return facts.fact_first_wins(t).select("id", "seq")


def test_stream_one_and_many_batches_equal_batch(spark, scratch):
    records = standin.incident_json(spark, SF)
    want = _rows(_batch_fact(spark))
    for n_files in (1, 5):
        base = f"{scratch}/n{n_files}"
        source.land_records(records, f"{base}/landing", n_files)
        runner.run_incidents(spark, source.file_stream(spark, f"{base}/landing"), f"{base}/store", f"{base}/ckpt")
        got = _rows(sinks.read_fact(spark, f"{base}/store").select("id", "seq"))
        assert got == want
        edges = _rows(sinks.read_edges(spark, f"{base}/store").select("edge_type", "src", "dst"))
        g = graph.graph_input(clean.type_incidents(standin.incident_payloads(spark, SF)))
        assert edges == _rows(graph.edges_all(g))


def test_replay_is_idempotent(spark, scratch):
    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 3)
    store = f"{scratch}/store"
    runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), store, f"{scratch}/ckpt")
    first = _rows(sinks.read_fact(spark, store))
    # Same checkpoint: nothing new to read.
    runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), store, f"{scratch}/ckpt")
    assert _rows(sinks.read_fact(spark, store)) == first
    # New checkpoint over the same store: everything is re-read, nothing is re-inserted.
    runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), store, f"{scratch}/ckpt2")
    assert _rows(sinks.read_fact(spark, store)) == first
    assert sinks.read_edges(spark, store).groupBy("edge_type", "src", "dst").count() \
        .filter(F.col("count") > 1).count() == 0


def test_retried_batch_overwrites_itself(spark, scratch):
    parsed = source.parsed(standin.incident_json(spark, SF))
    sink = sinks.IncidentSink(f"{scratch}/store", f"{scratch}/ckpt")
    sink(parsed, 0)
    once = _rows(sinks.read_fact(spark, f"{scratch}/store"))
    sink(parsed, 0)   # the same batch again, e.g. after an executor was lost
    assert _rows(sinks.read_fact(spark, f"{scratch}/store")) == once
    sink(parsed, 1)   # a later batch with the same ids inserts nothing
    assert _rows(sinks.read_fact(spark, f"{scratch}/store")) == once


def test_window_counts_stream(spark, scratch):
    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 3)
    got = runner.run_window_counts(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/out", f"{scratch}/ckpt")
    t = clean.type_incidents(standin.incident_payloads(spark, SF)).filter(F.col("offense_date").isNotNull())
    want = t.groupBy(F.to_date("offense_date").alias("d"), "incident_type").count()
    assert got.count() == want.count()
    assert got.agg(F.sum("incidents")).first()[0] == t.count()


def _late_feed(spark, path):
    """Three files in order: March, then offences of January that are reported late."""
    rows = [(1, "a", "2024-03-10 12:00:00"), (2, "b", "2024-01-02 12:00:00"), (3, "c", "2024-01-03 12:00:00")]
    for seq, i, day in rows:
        df = spark.createDataFrame([(seq, i, day)], "seq long, id string, offense_date string").select(
            "seq", F.to_json(F.struct("id", "offense_date", F.lit("Theft").alias("narrative"), F.lit("29.6").alias("latitude"),
                                      F.lit("-82.3").alias("longitude"))).alias("value"))
        df.coalesce(1).write.mode("append").json(path)


def test_late_rows_are_counted_and_linked(spark, scratch):
    from gridwatch.streaming import near

    _late_feed(spark, f"{scratch}/landing")
    got = runner.run_window_counts(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/out", f"{scratch}/w")
    assert sorted(str(r.window_start)[:10] for r in got.collect()) == ["2024-01-02", "2024-01-03", "2024-03-10"]
    runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/store", f"{scratch}/ckpt")
    pairs = near.run_near_stream(spark, f"{scratch}/store", f"{scratch}/near", f"{scratch}/n", 500.0, 7, max_files_per_trigger=1)
    assert _rows(pairs.select("id_a", "id_b")) == [("b", "c")]


def test_smaller_seq_in_a_later_batch_wins(spark, scratch):
    def batch(seq, lat):
        value = F.to_json(F.struct(F.lit("x").alias("id"), F.lit("Main").alias("address"), F.lit(lat).alias("latitude"),
                                   F.lit("-82.3").alias("longitude")))
        return source.parsed(spark.range(1).select(F.lit(seq).alias("seq"), value.alias("value")))

    sink = sinks.IncidentSink(f"{scratch}/store", f"{scratch}/ckpt")
    sink(batch(100, "1.0"), 0)
    sink(batch(5, "2.0"), 1)
    assert [(r.seq, r.latitude) for r in sinks.read_fact(spark, f"{scratch}/store").collect()] == [(5, 2.0)]
    assert [r.lat for r in sinks.read_locations(spark, f"{scratch}/store").collect()] == [2.0]


def test_near_pairs_stand_once_after_a_retried_batch(spark, scratch):
    from gridwatch.streaming import near

    parsed = source.parsed(standin.incident_json(spark, SF).limit(200))
    sink = sinks.IncidentSink(f"{scratch}/store", f"{scratch}/ckpt")
    sink(parsed, 0)
    args = (f"{scratch}/store", f"{scratch}/near", f"{scratch}/n", 500.0, 7)
    first = _rows(near.run_near_stream(spark, *args))
    assert first
    sink(parsed, 0)  # written again under new file names after it was read
    assert _rows(near.run_near_stream(spark, *args)) == first


def test_compaction_changes_no_row(spark, scratch):
    parsed = source.parsed(standin.incident_json(spark, SF))
    sink = sinks.IncidentSink(f"{scratch}/store", f"{scratch}/ckpt")
    for i in range(3):
        sink(parsed.filter(F.col("seq") % 3 == i), i)
    for table in sinks.MERGES:
        before = _rows(sinks.read_merged(spark, f"{scratch}/store", table))
        sinks.compact(spark, f"{scratch}/store", table, "folded_1")
        stored = spark.read.parquet(f"{scratch}/store/{table}")
        assert [r[0] for r in stored.select("batch").distinct().collect()] == ["folded_1"]
        assert _rows(sinks.read_merged(spark, f"{scratch}/store", table)) == before


def test_failure_of_one_query_stops_the_other(spark, scratch):
    import pytest

    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 2)
    stream = source.parsed(source.file_stream(spark, f"{scratch}/landing"))

    def fails(df, i):
        raise ValueError("sink is gone")

    queries = [runner.start(stream, fails, f"{scratch}/a", available_now=False),
               runner.start(stream, lambda df, i: None, f"{scratch}/b", available_now=False)]
    with pytest.raises(Exception, match="sink is gone"):
        runner.wait(spark, queries, available_now=False)
    assert not any(q.isActive for q in queries)


def test_progress_counts(spark, scratch):
    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 2)
    qs = runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/store", f"{scratch}/ckpt")
    counts = runner.batch_counts(qs[0])
    assert sum(c["records"] for c in counts) == records.count()


def test_stateful_stream_is_insert_once_across_restarts(spark, scratch):
    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 2)
    store, ckpt = f"{scratch}/store", f"{scratch}/ckpt"
    runner.run_incidents_stateful(spark, source.file_stream(spark, f"{scratch}/landing"), store, ckpt)
    first = _rows(sinks.read_fact(spark, store).select("id", "seq"))
    assert first == _rows(_batch_fact(spark))
    g = graph.graph_input(clean.type_incidents(standin.incident_payloads(spark, SF)))
    edges = _rows(sinks.read_edges(spark, store).select("edge_type", "src", "dst"))
    assert edges == _rows(graph.edges_all(g))
    locs = _rows(sinks.read_locations(spark, store).select("address", "lat", "lon"))
    assert locs == _rows(graph.location_nodes(g).select("address", "lat", "lon"))
    # The same records arrive again (a replayed topic): state already holds every key.
    source.land_records(records, f"{scratch}/landing", 1)
    runner.run_incidents_stateful(spark, source.file_stream(spark, f"{scratch}/landing"), store, ckpt)
    assert _rows(sinks.read_fact(spark, store).select("id", "seq")) == first
    assert _rows(sinks.read_edges(spark, store).select("edge_type", "src", "dst")) == edges
    # Every edge is stored once: the keyed state dropped the replays.
    assert spark.read.parquet(f"{store}/edges").count() == len(edges)


def test_near_pairs_stream_equals_batch(spark, scratch):
    from gridwatch.operators import proximity
    from gridwatch.streaming import near

    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 3)
    runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/store", f"{scratch}/ckpt")
    got = near.run_near_stream(spark, f"{scratch}/store", f"{scratch}/near", f"{scratch}/near_ckpt", 500.0, 7)
    t = clean.type_incidents(standin.incident_payloads(spark, SF))
    want = proximity.near_incident_pairs(facts.fact_first_wins(t), 500.0, 7)
    assert _rows(got.select("id_a", "id_b")) == _rows(want.select("id_a", "id_b"))


def test_dual_mode_stores_each_quarantined_row_once(spark, scratch):
    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 2)
    runner.run_incidents(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/store", f"{scratch}/ckpt", mode="dual")
    got = _rows(sinks.read_quarantine(spark, f"{scratch}/store").select("seq", "reasons"))
    want = _rows(clean.quarantine(standin.incident_payloads(spark, SF)).select("seq", "reasons"))
    assert got == want
    assert _rows(sinks.read_fact(spark, f"{scratch}/store").select("id", "seq")) == _rows(_batch_fact(spark))


def test_stateful_day_and_season_nodes(spark, scratch):
    records = standin.incident_json(spark, SF)
    source.land_records(records, f"{scratch}/landing", 3)
    runner.run_incidents_stateful(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/store", f"{scratch}/ckpt")
    g = graph.graph_input(clean.type_incidents(standin.incident_payloads(spark, SF)))
    for table, nodes in (("day", graph.day_nodes(g)), ("season", graph.season_nodes(g))):
        got = _rows(sinks.read_merged(spark, f"{scratch}/store", table))
        assert got == _rows(nodes)


def test_incremental_risk_equals_batch_after_every_batch(spark, scratch):
    from gridwatch.operators import risk
    from gridwatch.streaming import risk as stream_risk

    records = standin.incident_json(spark, SF)
    out, landing = f"{scratch}/risk", f"{scratch}/landing"
    cols = ["address", "band", "risk_score", "incidents"]
    seen = None
    parts = [records.filter(F.col("seq") % 3 == 1), records.filter(F.col("seq") % 3 == 0), records.filter("seq < 400"), records.filter(F.col("seq") % 3 == 2)]
    for part in parts:  # the third batch only repeats records
        source.land_records(part, landing, 1)
        got = stream_risk.run_risk_stream(spark, source.file_stream(spark, landing), out, f"{scratch}/ckpt", partitions=2)
        seen = part if seen is None else seen.unionByName(part)
        want = risk.risk_scores(graph.graph_input(clean.type_incidents(source.parsed(seen))))
        assert _rows(got.select(cols)) == _rows(want.select(cols))
    # The feed read again under another checkpoint: its own scores, none doubled.
    again = stream_risk.run_risk_stream(spark, source.file_stream(spark, landing, 10), out, f"{scratch}/ckpt2", partitions=2)
    assert _rows(again.select(cols)) == _rows(want.select(cols))
    assert _rows(stream_risk.read_risk(spark, out, f"{scratch}/ckpt").select(cols)) == _rows(want.select(cols))


def test_risk_stream_reads_the_feed_in_one_query(spark, scratch, monkeypatch):
    """Both measures come from one query: the feed is not read, and its edges are not held, once for each measure."""
    from gridwatch.streaming import risk as stream_risk
    from gridwatch.streaming import runner

    started, start = [], runner.start
    monkeypatch.setattr(runner, "start", lambda *a: started.append(start(*a)) or started[-1])
    row = '{"id": "%s", "offense_date": "2024-01-05 10:00:00", "offense_hour_of_day": "%d", "address": "A"}'
    feed = [(1, row % ("i", 23)), (2, row % ("i", 1)), (3, row % ("i", 23)), (4, row % ("j", 22)), (5, row % ("j", 9))]
    source.land_records(spark.createDataFrame(feed, "seq long, value string"), f"{scratch}/landing", 1)
    got = stream_risk.run_risk_stream(spark, source.file_stream(spark, f"{scratch}/landing"), f"{scratch}/risk", f"{scratch}/ckpt", partitions=1)
    assert {(r.address, r.band, r.risk_score, r.incidents) for r in got.collect()} == {("A", "night", 3, 2), ("A", "day", 1, 1)}
    assert len(started) == 1


def _fact_rows(spark, rows):
    """Rows (seq, id, lat, lon, day of January) as a batch of the fact table."""
    from datetime import datetime

    df = spark.createDataFrame([(s, i, y, x, datetime(2024, 1, d, 12) if d else None) for s, i, y, x, d in rows],
                               "seq long, id string, latitude double, longitude double, offense_date timestamp_ntz")
    return df


def _near_links(spark, out):
    from gridwatch.streaming import near

    return sorted((r.id_a, r.id_b) for r in near.read_near(spark, out).collect())


def test_near_follows_moves_retries_and_other_checkpoints(spark, scratch):
    from gridwatch.streaming import near

    sink = near.NearSink(scratch, "/ckpt/1", 500.0, 7)
    one = _fact_rows(spark, [(10, "a", 29.0, -82.0, 5), (11, "b", 29.001, -82.0, 6), (12, "c", 29.0, -82.0, 25), (13, "d", None, -82.0, 5), (14, "e", 29.0, -82.0, None)])
    sink(one, 0)
    assert _near_links(spark, scratch) == [("a", "b")]
    sink(one, 0)  # retried
    near.NearSink(scratch, "/ckpt/2", 500.0, 7)(one, 0)  # read again under another checkpoint
    assert _near_links(spark, scratch) == [("a", "b")]
    # An earlier record of b moves it to the 20th, next to c; a later record of a changes nothing; d gets no point.
    sink(_fact_rows(spark, [(3, "b", 29.0, -82.001, 20), (30, "a", 29.0, -82.0, 24), (31, "d", 29.0, -82.0, 5)]), 1)
    assert _near_links(spark, scratch) == [("b", "c")]
    # The first version of e comes last.
    sink(_fact_rows(spark, [(1, "e", 29.0, -82.0, 19)]), 2)
    assert _near_links(spark, scratch) == [("b", "c"), ("b", "e"), ("c", "e")]


def test_near_batch_reads_only_days_and_cells_in_reach(spark, scratch):
    from gridwatch.streaming import near

    sink = near.NearSink(scratch, "/ckpt/1", 500.0, 7)
    far = [(i, f"f{i}", 20.0 + i % 10, -80.0 + i // 10, 1 + i % 28) for i in range(200)]
    here = [(1000 + d, f"h{d}", 29.0, -82.0, d) for d in range(1, 29)]
    edge = [(2000, "w", 0.0, 179.9999, 14), (2001, "x", 0.0, -179.9999, 15)]
    sink(_fact_rows(spark, far + here + edge[:1]), 0)
    new = sink.versions(_fact_rows(spark, [(3000, "n", 29.0001, -82.0, 14), edge[1]]))
    stored = sink.in_reach(spark, new, "other")
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = sink.in_reach(spark, new, "other")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    # Days, cells and the batch select partitions; no filter is left for rows.
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "day#" in filters and "cell#" in filters and "batch#" in filters and "DataFilters: []" in plan
    assert sorted(r.id for r in stored.collect()) == sorted([f"h{d}" for d in range(7, 23)] + ["w"])  # days 14 and 15, a week each way
    sink(_fact_rows(spark, [(3000, "n", 29.0001, -82.0, 14), edge[1]]), 1)
    got = _near_links(spark, scratch)
    assert ("w", "x") in got and {a for a, b in got if b == "n"} == {f"h{d}" for d in range(7, 22)}


def test_near_links_are_stored_once_and_read_as_they_are(spark, scratch):
    from gridwatch.streaming import near

    sink = near.NearSink(scratch, "/ckpt/1", 500.0, 7)
    rows = [(n, f"i{n}", 29.0 + n % 5 * 0.0001, -82.0, 1 + n % 4) for n in range(40)]
    sink(_fact_rows(spark, rows[::2]), 0)
    sink(_fact_rows(spark, rows[1::2]), 1)
    assert spark.read.parquet(f"{scratch}/links").count() == 40 * 39 // 2  # all are in reach of each other

    def shuffles():
        return near.read_near(spark, scratch)._jdf.queryExecution().sparkPlan().toString().count("HashAggregate")

    assert len(set(_near_links(spark, scratch))) == len(_near_links(spark, scratch)) == 40 * 39 // 2
    assert shuffles() == 0
    near.compact_near(spark, scratch, "f1")
    assert len(set(_near_links(spark, scratch))) == len(_near_links(spark, scratch)) == 40 * 39 // 2 and shuffles() == 0


def test_near_links_met_twice_are_read_once(spark, scratch):
    """A batch meets versions of one that failed before its links; when that is tried again, both have their common links."""
    from gridwatch.session import remove_path
    from gridwatch.streaming import near
    from gridwatch.streaming.sinks import run_token

    one, two = _fact_rows(spark, [(1, "a", 29.0, -82.0, 5), (2, "b", 29.0, -82.0, 5)]), _fact_rows(spark, [(3, "c", 29.0, -82.0, 6)])
    sink, other = near.NearSink(scratch, "/ckpt/1", 500.0, 7), near.NearSink(scratch, "/ckpt/2", 500.0, 7)
    key = f"{run_token('/ckpt/1')}_{0:012d}"
    sink(one, 0)
    remove_path(spark, f"{scratch}/links/batch={key}")  # as if it had failed before
    remove_path(spark, f"{scratch}/once/{key}")
    other(two, 0)
    sink(one, 0)
    want = [("a", "b"), ("a", "c"), ("b", "c")]
    assert spark.read.parquet(f"{scratch}/links").count() == 5 and _near_links(spark, scratch) == want
    sink(one, 0)  # again, after its links were stored
    assert _near_links(spark, scratch) == want
    near.compact_near(spark, scratch, "f1")
    assert spark.read.parquet(f"{scratch}/links").count() == 3 and _near_links(spark, scratch) == want
