"""Line dedup against brute force and its SQL."""

import hashlib
import time

import duckdb

from gridwatch.llm import line_dedup as L
from gridwatch.llm.common import load


def brute(rows):
    distinct = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    first, cover = {}, {}
    for i, t in distinct:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if any(x.strip(" ") for x in w):
                f = first.setdefault(w, (i, t, p))
                if f != (i, t, p):
                    own = set(range(f[2], f[2] + 3)) if f[:2] == (i, t) else set()
                    cover.setdefault((i, t), set()).update(set(range(p, p + 3)) - own)
    out = []
    for i, t in rows:
        gone = cover.get((i, t), set())
        lines = t.split("\n") if t is not None else []
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        out.append((i, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = L.line_dedup_query(df).collect()
    for r in rows:
        spans = [tuple(map(int, x.split("-"))) for x in r.removed.split(",") if x]
        assert sum(b - a for a, b in spans) == r.n_removed and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    return sorted([(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in rows], key=str)


def test_small_cases(spark):
    rows = [(5, "a\nb\nc\nd\ne"), (3, "x\na\nb\nc\nd"), (9, "a\nb\nc"), (8, "a\nb"), (1, "q\nq\nq\nq\nq\nq\nq"), (2, "q\nq\nq"),
            (4, None), (6, ""), (7, "\n\n\n\n"), (10, " \n\n\n\nz"), (11, "\n\n\nz"), (None, "a\nb\nc\nlast"), (12, "m\nn\no"),
            (12, "m\nn\no"), (13, "l1\nl2\nl3\n" * 4000), (14, "é\nü\nñ\r\nx"), (15, "é\nü\nñ\r\ny")] + [(100 + i, f"h\no\nt\nu{i}") for i in range(200)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, pos int, lines string")
    assert result(df.repartition(4)) == brute(rows)


def test_empty_table(spark):
    assert L.line_dedup_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_ranges(spark):
    """One text of 100,000 removed ranges: linear in its lines."""
    parts = [f"a{i}\nb{i}\nc{i}" for i in range(100_000)]
    first = "\n".join(parts)
    second = "\n".join(f"{p}\nown{i}" for i, p in enumerate(parts))
    df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in L.line_dedup(df).collect()}
    assert time.time() - began < 60
    assert got[1].text == first and got[2].text == "\n".join(f"own{i}" for i in range(100_000))
    assert len(got[2].ranges) == 100_000 and got[2].n_lines == 400_000


def test_documents_and_sql(spark):
    df = load(spark, "/root/testdata/sf0.01", "documents")
    got = result(df)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()]) and any(r[2] for r in got)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(L.ORACLE_SQL).df()
    have = L.line_dedup_query(df).toPandas()
    cols = ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"]
    assert want[cols].sort_values("doc_id").values.tolist() == have[cols].sort_values("doc_id").values.tolist()
