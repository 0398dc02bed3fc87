import json

from pyspark.sql import functions as F

from gridwatch.operators import clean, facts
from gridwatch.schema import RAW_INCIDENT

FIELDS = [f.name for f in RAW_INCIDENT.fields]


def payload(**kw):
    return json.dumps({k: kw.get(k) for k in FIELDS})


def test_bad_payloads_are_quarantined_not_fatal(spark):
    rows = [
        (1, "this is not json"),
        (2, None),
        (3, json.dumps({"id": {"nested": 1}, "narrative": "Theft"})),
        (4, json.dumps([{"id": "x"}])),
        (5, payload(id="ok-1", narrative="Theft", offense_date="2023-10-31 23:00:00",
                    offense_hour_of_day="23", latitude="29.65", longitude="-82.32")),
    ]
    rec = spark.createDataFrame(rows, "seq long, value string")
    raw = clean.parse_payload(rec)
    q = {r.seq: r.reasons for r in clean.quarantine(raw).collect()}
    assert "unparseable_payload" in q[1] and "missing_id" in q[1]
    assert "unparseable_payload" in q[2]
    assert "bad_id" in q[3]
    assert 4 in q
    assert 5 not in q
    fact = facts.fact_first_wins(clean.type_incidents(raw)).collect()
    assert [r.id for r in fact] == ["ok-1"]


def test_typing_is_ansi_safe(spark):
    raw = spark.createDataFrame(
        [(1, "a", "bad", "14.0", "x", "-82.3"), (2, "b", "2024-01-01", "14", "29.6", "-82.3")],
        "seq long, id string, offense_date string, offense_hour_of_day string, latitude string, longitude string")
    for name in FIELDS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    t = {r.id: r for r in clean.type_incidents(raw).collect()}
    assert t["a"].offense_date is None and t["a"].offense_hour is None and t["a"].latitude is None
    assert t["a"].geometry is None
    assert t["b"].offense_hour == 14 and str(t["b"].offense_date) == "2024-01-01 00:00:00"
    assert t["b"].geometry == "POINT(-82.3 29.6)"
    reasons = {r.seq: r.reasons for r in clean.quarantine(raw).collect()}
    assert reasons[1] == "bad_offense_date,bad_hour,bad_latitude"


def test_csv_night_and_afternoon_risk(spark, scratch):
    from gridwatch.operators import graph, risk
    from gridwatch.sources.files import read_incident_csv

    path = scratch + "/seed.csv"
    spark.createDataFrame(
        [("n1", "Vandalism", "12 Harbour Row", 29.6401, -82.3105, "2024-02-17 02:15:00"),
         ("n2", "Fraud", "8 Mill Lane", 29.6022, -82.3909, "2024-07-05 13:40:00")],
        "ID string, `Crime Type` string, Location string, Latitude double, Longitude double, "
        "`Incident Date` string").coalesce(1).write.option("header", True).csv(path)
    typed = read_incident_csv(spark, path)
    g = graph.graph_input(typed)
    parts = {r.id: (r.part_of_day, r.season) for r in g.collect()}
    assert parts == {"n1": ("night", "Winter"), "n2": ("afternoon", "Summer")}
    night = {r.address: r.risk_score for r in risk.risk_band(g, "night").collect()}
    day = {r.address: r.risk_score for r in risk.risk_band(g, "day").collect()}
    assert night == {"12 Harbour Row": 1}
    assert day == {"8 Mill Lane": 1}


def test_csv_defaults_and_us_dates(spark, scratch):
    from gridwatch.sources.files import read_incident_csv

    path = scratch + "/dirty.csv"
    spark.createDataFrame(
        [(None, None, None, None, None, "10/31/2023 23:00"), ("7", "Theft", "A", 1.0, 2.0, "junk")],
        "ID string, `Crime Type` string, Location string, Latitude double, Longitude double, "
        "`Incident Date` string").coalesce(1).write.option("header", True).csv(path)
    rows = sorted(read_incident_csv(spark, path).collect(), key=lambda r: r.seq)
    a, b = rows
    assert a.id.startswith("unknown-") and a.incident_type == "Unspecified"
    assert a.address == "Unknown Location" and a.latitude == 0.0 and a.offense_hour == 23
    assert b.offense_date is None and b.offense_hour == 0 and b.offense_day_of_week == "Unknown"


def test_snapshot_roundtrip_two_rows(spark, scratch):
    from gridwatch.sources.files import read_snapshot

    path = scratch + "/historical.json"
    rows = [{"incident_id": "1", "incident_type": "Theft", "incident_date": "2023-01-01",
             "latitude": "29.6111", "longitude": "-82.3222"},
            {"incident_id": "2", "incident_type": "Assault", "incident_date": "2023-01-02",
             "latitude": "29.6333", "longitude": "-82.3444"}]
    import os

    os.makedirs(path, exist_ok=True)
    with open(path + "/part-0.json", "w") as fh:
        fh.write(json.dumps(rows))
    out = read_snapshot(spark, path).orderBy("seq").collect()
    assert [(r.id, r.incident_type, r.latitude, r.longitude) for r in out] == [
        ("1", "Theft", 29.6111, -82.3222), ("2", "Assault", 29.6333, -82.3444)]
    assert [r.id for r in read_snapshot(spark, path, limit=1).collect()] == ["1"]
    assert facts.beyond_limit(read_snapshot(spark, path), 1) == 1


def test_missing_snapshot_fails_visibly(spark, scratch):
    import pytest
    from pyspark.errors import AnalysisException

    from gridwatch.sources.files import read_snapshot

    with pytest.raises(AnalysisException):
        read_snapshot(spark, scratch + "/does-not-exist.json").collect()


def _write_csv(path, rows):
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("ID,Crime Type,Location,Latitude,Longitude,Incident Date\n")
        fh.writelines(",".join(r) + "\n" for r in rows)


def test_earlier_and_smaller_file_comes_first(spark, scratch):
    from gridwatch.sources.files import read_incident_csv

    _write_csv(f"{scratch}/2024-01.csv", [("x", "first", "A", "1", "1", "2024-01-01 10:00:00")])
    _write_csv(f"{scratch}/2024-02.csv", [("x", "second", "B", "1", "1", "2024-02-01 10:00:00")] + [
        (f"f{i}", "filler", "C", "1", "1", "2024-02-01 10:00:00") for i in range(500)])
    rows = read_incident_csv(spark, scratch)
    assert {r.id: r.incident_type for r in facts.fact_first_wins(rows).collect()}["x"] == "first"
    assert sorted(r.seq for r in rows.collect()) == list(range(502))


def test_keyless_ids_do_not_depend_on_splits(spark, scratch):
    from gridwatch.sources.files import read_incident_csv

    _write_csv(f"{scratch}/a.csv", [("", f"type {i}", "A", "1", "1", "2024-01-01 10:00:00") for i in range(300)])
    _write_csv(f"{scratch}/b.csv", [("", f"other {i}", "A", "1", "1", "2024-01-01 10:00:00") for i in range(50)])
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128MB", "1500b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(sorted((r.id, r.incident_type) for r in read_incident_csv(spark, scratch).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == 350


def test_snapshot_limit_exact_first_n(spark):
    df = spark.range(0, 50_000, numPartitions=16).select((F.col("id") * 7 % 50_000).alias("seq"),
                                                          F.col("id").cast("string").alias("v"))
    for n in (1, 999, 12_345, 49_999, 50_000, 60_000):
        got = [r.seq for r in facts.snapshot_limit(df, n).collect()]
        assert sorted(got) == list(range(min(n, 50_000)))
