from pyspark.sql import functions as F

from gridwatch.functions import calendar as cal


def test_part_of_day_boundaries(spark):
    hours = [-1, 0, 4, 5, 11, 12, 16, 17, 20, 21, 23, None]
    expected = ["night", "night", "night", "morning", "morning", "afternoon", "afternoon",
                "evening", "evening", "night", "night", "night"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hours)], "i int, h int")
    out = df.select("i", cal.part_of_day(cal.hour_or_default(F.col("h"))).alias("p")).orderBy("i")
    assert [r.p for r in out.collect()] == expected


def test_season_boundaries(spark):
    months = list(range(1, 13)) + [None]
    expected = (["Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer",
                 "Fall", "Fall", "Fall", "Winter"] + ["Winter"])
    df = spark.createDataFrame([(i, m) for i, m in enumerate(months)], "i int, m int")
    out = df.select("i", cal.season_of_month(F.coalesce("m", F.lit(cal.DEFAULT_MONTH))).alias("s")).orderBy("i")
    assert [r.s for r in out.collect()] == expected


def test_season_without_default_is_fall(spark):
    df = spark.createDataFrame([(None,)], "m int")
    assert df.select(cal.season_of_month(F.col("m")).alias("s")).first().s == "Fall"


def test_hour_label_and_colour(spark):
    df = spark.createDataFrame([(0, 5), (12, 6), (13, 1), (23, 0)], "h int, r int")
    out = df.select(cal.hour_label(F.col("h")).alias("l"), cal.risk_colour(F.col("r")).alias("c")).collect()
    assert [(r.l, r.c) for r in out] == [("12:00 AM", "orange"), ("12:00 PM", "red"),
                                         ("1:00 PM", "orange"), ("11:00 PM", "orange")]


def test_day_name_is_full(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS t")
    assert df.select(cal.day_name(F.col("t")).alias("d")).first().d == "Monday"


def test_rules_over_whole_integer_ranges(spark):
    def part(h):
        if 5 <= h <= 11:
            return "morning"
        if 12 <= h <= 16:
            return "afternoon"
        if 17 <= h <= 20:
            return "evening"
        return "night"

    def season(m):
        return {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
                6: "Summer", 7: "Summer", 8: "Summer"}.get(m, "Fall")

    df = spark.range(-48, 201).select(F.col("id").cast("int").alias("v"))
    got = {r.v: (r.p, r.s, r.l) for r in df.select(
        "v", cal.part_of_day(F.col("v")).alias("p"), cal.season_of_month(F.col("v")).alias("s"),
        cal.hour_label(F.col("v")).alias("l")).collect()}
    for v in range(-48, 201):
        assert got[v][0] == part(v)
        assert got[v][1] == season(v)
    for h in range(24):
        h12 = h % 12 or 12
        assert got[h][2] == f"{h12}:00 {'PM' if h >= 12 else 'AM'}"


def test_current_hour_in_range(spark):
    h = spark.range(1).select(cal.current_hour().alias("h")).first().h
    assert 0 <= h <= 23
