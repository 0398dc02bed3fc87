from pyspark.sql import functions as F

from gridwatch.operators import clean, facts, graph
from gridwatch.sources import files, standin, tables

SF = "/root/testdata/sf0.001"


def test_fact_store_prunes_by_day(spark, scratch):
    typed = clean.type_incidents(standin.incident_payloads(spark, SF))
    fact = facts.fact_first_wins(typed)
    tables.write_fact(fact, scratch + "/fact")
    stored = tables.read_fact(spark, scratch + "/fact")
    assert stored.count() == fact.count()
    day = tables.facts_on(spark, scratch + "/fact", "2024-01-02")
    want = fact.filter(F.to_date("offense_date") == F.lit("2024-01-02").cast("date"))
    assert day.count() == want.count()
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(offense_day" in plan


def test_graph_full_refresh(spark, scratch):
    typed = clean.type_incidents(standin.incident_payloads(spark, SF))
    g = graph.graph_input(typed)
    tables.write_graph(g, typed, scratch + "/graph")
    tables.write_graph(g, typed, scratch + "/graph")   # reload replaces, never appends
    edges = spark.read.parquet(scratch + "/graph/edges")
    assert edges.count() == graph.edges_all(g).count()


def test_lake_json_roundtrip(spark, scratch):
    rows = spark.createDataFrame([("Theft", "Main St"), ("Assault", None)], "crime string, location string")
    path = files.lake_path(scratch, "sample.json")
    assert path.endswith("/raw/crime/sample.json")
    files.write_json_list(rows, path)
    back = files.read_json_list(spark, path, rows.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_publish_json(spark, scratch):
    raw = standin.incident_payloads(spark, SF)
    out = files.publish_json(raw, scratch + "/topic")
    assert spark.read.json(scratch + "/topic").count() == raw.count() == out.count()


def test_hot_day_is_split_over_files(spark, scratch):
    rows = spark.range(40_000).select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 10 < 9, F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"))
        .when(F.col("id") % 20 == 9, F.lit("2024-01-06 10:00:00").cast("timestamp_ntz")).alias("offense_date"),
        (F.rand(1) * 10).alias("latitude"), F.rand(2).alias("longitude"), F.col("id").alias("seq"))
    for f in tables.FACT.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
        tables.write_fact(rows, scratch + "/fact")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    stored = tables.read_fact(spark, scratch + "/fact")
    files = {r.d: r["count"] for r in stored.select(F.col("offense_day").cast("string").alias("d"), F.col("_metadata.file_path").alias("f"))
             .distinct().groupBy("d").count().collect()}
    assert stored.count() == 40_000 and files["2024-01-05"] >= 3 and None in files


def test_predictions_are_unique_and_rerun_safe(spark, scratch):
    from gridwatch.operators import predict
    from gridwatch.schema import PREDICTION

    fact = facts.fact_first_wins(clean.type_incidents(standin.incident_payloads(spark, SF)), predict.CELL_INPUT)
    cells = predict.with_cells(fact, 0.0025)
    times = ["2024-01-26 23:00:00", "2024-01-27 14:00:00", "2024-01-26 23:00:00"]
    for t in times:
        predict.store_predictions(predict.grid_scores(cells, t, "v1"), scratch)
    predict.store_predictions(predict.grid_scores(cells, times[0], "v2", by_type=False), scratch)
    stored = spark.read.parquet(scratch)
    keys = ["grid_id", "incident_type", "prediction_time", "model_version"]
    assert stored.count() == stored.select(keys).distinct().count()
    want = sum(predict.grid_scores(cells, t, "v1").count() for t in set(times))
    assert stored.filter("model_version = 'v1'").count() == want
    assert {f.name for f in PREDICTION.fields} <= set(stored.columns)
    assert stored.filter("created_at IS NULL").count() == 0
