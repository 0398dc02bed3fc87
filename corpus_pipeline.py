"""Cleaning and packing of ``documents``: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All but the last keep the columns of
``docs`` and drop whole documents; the last returns pieces of packed sequences.

In every stage: a null text counts as empty, and an empty document is kept by the toxicity model only if the model's
constant says so, is a copy of all other empty ones, is linked with nothing, holds no benchmark window and packs as one end id.
Extra columns, also such as are named like the operators' own, are carried along.  An empty table gives an empty
table.  What each stage does with null ids, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from gridwatch.llm.common import load, staged
from gridwatch.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from these documents' labels.

    Rows without an id, and without labels of both classes all rows, are scored like any other (then 0: kept); repeated rows
    share their score and their fate.
    """
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, name="__toxicity").filter(
        F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id.

    A null id is smaller than any other; of rows that repeat id and text the first as read stays.
    """
    columns = tuple(docs.columns)
    rows = exact_dedup.exact_dedup(docs, carry=columns).filter("kept")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest id.

    A row goes if the operator does not keep its (id, text), null ids included; rows that repeat both share their fate.
    """
    gone = (near_dedup.near_duplicates(docs).filter("not kept")
            .select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    An empty benchmark keeps all; items without an id count too; repeated rows share their fate.
    """
    columns = tuple(docs.columns)
    rows = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark"), carry=columns).filter(F.size("runs") == 0)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids (unsigned 32-bit, little-endian) and the ids' crc32.

    Rows without an id and repeated rows are packed once each.
    """
    return packing.pack_sequences(docs, TOKENIZER).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The toxicity model and the tokenizer have no SQL form; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
