"""A third of all rows on one key: results stay whole and match brute force."""

from collections import Counter

from pyspark.sql import functions as F

from gridwatch.operators import clean, facts, graph, risk
from gridwatch.schema import RAW_INCIDENT

FIELDS = [f.name for f in RAW_INCIDENT.fields]


def raw(spark, rows):
    df = spark.createDataFrame(rows, "seq long, id string, offense_hour_of_day string, address string, "
                                     "latitude string, longitude string")
    for name in FIELDS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def test_hot_id_and_hot_address(spark):
    rows = []
    n = 3000
    for s in range(n):
        if s % 3 == 0:      # a third of the rows: one replayed id, many hours and addresses
            rows.append((s, "HOT", str(s % 24), f"A{s % 7}", "29.6", "-82.3"))
        elif s % 3 == 1:    # a third of the rows: one address
            rows.append((s, f"i{s}", str(s % 24), "HOTADDR", "29.6", "-82.3"))
        else:
            rows.append((s, f"i{s}", str(s % 24), f"A{s % 11}", "29.6", "-82.3"))
    typed = clean.type_incidents(raw(spark, rows))
    fact = {r.id: r.seq for r in facts.fact_first_wins(typed).collect()}
    assert fact["HOT"] == 0 and len(fact) == 1 + 2 * n // 3
    g = graph.graph_input(typed)
    got = {r.address: r.risk_score for r in risk.risk_band(g, "night").collect()}

    # Brute force over the same rows: paths = distinct (case, address) x distinct night hours of the case.
    def part(h):
        return "night" if (h < 5 or h >= 21) else "other"
    addrs, hours = {}, {}
    for s, cid, h, a, *_ in rows:
        addrs.setdefault(cid, set()).add(a)
        if part(int(h)) == "night":
            hours.setdefault(cid, set()).add(int(h))
    want = Counter()
    for cid, aset in addrs.items():
        for a in aset:
            if hours.get(cid):
                want[a] += len(hours[cid])
    assert got == dict(want)
