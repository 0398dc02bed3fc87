"""Line dedup over overlapping windows of three lines.

Every run of ``WINDOW`` consecutive lines of a document is a window, known by a 128-bit
hash.  Of equal windows in the whole corpus the first stays (smallest id, then smallest
text hash, then position); every later one covers its lines, but for lines of the
first one where the two overlap in one document.  Covered positions are merged
to ranges and their lines removed.  Everything runs on DataFrame functions.

Lines end at ``\\n``.  Windows of blank lines only do not count.

Defined results: a null text has no lines and stays null; a text of fewer lines
than a window is left alone; a null id sorts behind all others; rows that repeat id
and text count as one document and share the result; extra columns are ignored, or
carried along where asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.llm.common import staged

WINDOW = 3


def windows(source: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, key, pos): one row per window of rows (doc_id, key, text)."""
    lines = (source.filter(F.col("text").isNotNull())
             .withColumn("lines", F.split("text", "\n", -1)).filter(F.size("lines") >= WINDOW)
             .select("doc_id", "key", F.transform("lines", lambda x: F.struct(
                 F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(x) == "").alias("blank"))).alias("lines")))

    def window(i):
        at = [F.get("lines", i + j) for j in range(WINDOW)]
        blank = at[0]["blank"]
        for x in at[1:]:
            blank = blank & x["blank"]
        return F.struct(i.alias("pos"), F.xxhash64(*(x["a"] for x in at)).alias("h1"),
                        F.xxhash64(*(x["b"] for x in at)).alias("h2"), blank.alias("blank"))

    every = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)
    return (lines.select("doc_id", "key", F.explode(every).alias("w")).filter(~F.col("w.blank"))
            .select("w.h1", "w.h2", "doc_id", "key", "w.pos"))


def covered(occurrences: DataFrame) -> DataFrame:
    """(doc_id, key, ranges): merged ranges [start, end) of lines that later occurrences cover."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "pos")
    first = occurrences.groupBy("h1", "h2").agg(F.min(order).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    start = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    later = (occurrences.join(first, ["h1", "h2"]).filter(~same | (F.col("pos") != F.col("first.pos")))
             .select("doc_id", "key", F.struct(start.alias("start"), (F.col("pos") + WINDOW).alias("end")).alias("range"))
             .filter("range.start < range.end"))
    # Ranges in order of their start; one that begins behind all ends before it opens a new island.
    in_text = Window.partitionBy("doc_id", "key").orderBy("range.start", "range.end")
    before = F.max("range.end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    island = F.count_if(F.col("before").isNull() | (F.col("range.start") > F.col("before"))).over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    return (later.withColumn("before", before).withColumn("island", island)
            .groupBy("doc_id", "key", "island").agg(F.min("range.start").alias("start"), F.max("range.end").alias("end"))
            .groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, ranges (removed lines [start, end)), c0, c1, ..."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"),
                         *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    every = staged(windows(source.select("doc_id", "key", "text")), "windows")
    repeated = every.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2")
    occurrences = staged(every.join(repeated, ["h1", "h2"]), "occurrences")
    cover = covered(occurrences).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "ranges")

    # The lines are split before the join, so that no later expression splits again; one flag per line says whether it stays.
    lines = source.withColumn("lines", F.split("text", "\n", -1)).drop("text")
    starts = F.concat(F.array(F.lit(0)), F.transform("ranges", lambda r: r["end"]))
    ends = F.concat(F.transform("ranges", lambda r: r["start"]), F.array(F.size("lines")))
    stay = F.zip_with(starts, ends, lambda a, b: F.array_repeat(F.lit(True), b - a))
    go = F.transform("ranges", lambda r: F.array_repeat(F.lit(False), r["end"] - r["start"]))
    flags = F.flatten(F.zip_with(stay, go, lambda x, y: F.concat(x, F.coalesce(y, F.array().cast("array<boolean>")))))
    marked = F.filter(F.arrays_zip(F.col("lines").alias("line"), flags.alias("stays")), lambda x: x["stays"])
    kept = F.when(F.col("ranges").isNull(), F.col("lines")).otherwise(F.transform(marked, lambda x: x["line"]))
    return (lines.join(cover, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
            .select("doc_id", F.array_join(kept, "\n").alias("text"),
                    F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")).alias("ranges"),
                    *(f"c{i}" for i in range(len(carry)))))


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (ranges start-end of lines, end exclusive), kept_sha256 (null text: empty)."""
    return line_dedup(docs).select(
        "doc_id", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")).alias("n_lines"),
        F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Compares the lines themselves, position by position, without hashes or ranges.
ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
w AS (
  SELECT doc_id, pos, line AS l0, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
o AS (
  SELECT doc_id, pos, first_value(doc_id) OVER f AS first_doc, first_value(pos) OVER f AS first_pos
  FROM w WHERE l2 IS NOT NULL AND trim(l0 || l1 || l2, ' ') <> ''
  WINDOW f AS (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM o, range(3) AS s(j)
  WHERE (doc_id <> first_doc OR pos <> first_pos)
    AND NOT (doc_id = first_doc AND pos + j BETWEEN first_pos AND first_pos + 2)),
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 1 AS b
  FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone)
  GROUP BY doc_id, island),
removed AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text
  FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id),
total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(total.n, 0) AS n_lines, coalesce(removed.n, 0) AS n_removed,
       coalesce(spans, '') AS removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
