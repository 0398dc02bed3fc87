"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwatch.llm import toxicity
from gridwatch.llm.common import load, staged

from . import test_decontaminate, test_exact_dedup, test_near_dedup, test_packing

SF = "/root/testdata/sf0.001"
EXTRA = [(9001, "short one"), (9002, "SHORT one"), (9003, None), (9004, ""), (None, "no id at all here"), (9005, "x " * 20000)]


@pytest.fixture(scope="module")
def documents(spark):
    df = load(spark, SF, "documents")
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in EXTRA], df.schema)
    return staged(df.unionByName(more).withColumn("kept", F.lit("clash")).withColumn("c0", F.lit(1)), "test")


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages(spark, documents):
    docs = documents
    # Toxicity: what stays is what scores below the threshold; clean documents stay.
    out = staged(P.drop_toxic(spark, docs, SF), "test")
    model = toxicity.train(docs, load(spark, SF, "labels"))
    low = toxicity.with_score(docs.select("doc_id", "text"), model).filter(F.col("score") < toxicity.THRESHOLD)
    assert out.columns == docs.columns and sorted(rows(out), key=str) == sorted(rows(low), key=str)
    docs = out
    # Exact dedup.
    out = staged(P.drop_copies(spark, docs, SF), "test")
    want = [(r[0]) for r in test_exact_dedup.brute(rows(docs)) if r[3]]
    assert out.columns == docs.columns and sorted(map(str, (r[0] for r in rows(out)))) == sorted(map(str, want))
    docs = out
    # Near dedup: one document of each group.
    out = staged(P.drop_near_copies(spark, docs, SF), "test")
    want = [r[0] for r in test_near_dedup.brute(rows(docs)) if r[3]]
    assert out.columns == docs.columns and sorted(map(str, (r[0] for r in rows(out)))) == sorted(map(str, want))
    docs = out
    # Decontamination.
    out = staged(P.drop_contaminated(spark, docs, SF), "test")
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    want = [r[0] for r in test_decontaminate.brute(rows(docs), items) if not r[5]]
    assert out.columns == docs.columns and len(want) < docs.count()
    assert sorted(map(str, (r[0] for r in rows(out)))) == sorted(map(str, want))
    docs = out
    # Packing.
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    test_packing.check(P.pack(spark, docs, SF).collect(), dict(rows(docs)), full)


def test_run(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
