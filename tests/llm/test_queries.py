"""Every registered query of the package runs over its whole table and has the stated columns."""

import duckdb
import pytest

import __spark_entry__ as E
from gridwatch.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_hilbert_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
                            "sequence_id": "bigint", "offset": "bigint"},
    "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string",
                            "contaminated": "boolean"},
    "op4_quality_neighbours": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "removed": "string", "kept_sha256": "string"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
                     "grown_shard": "int"},
    "op10_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
                                 "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}
#: Queries with one row, or rows, for each key of another table than documents.
KEYS = {"op12_conversation_repair": ("conversations", "conv_id"), "op13_lexical_search": ("benchmark", "item_id")}


def test_names():
    assert set(queries.registry()) == set(COLUMNS) and set(COLUMNS) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = E.queries()[name](spark, SF)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    table, key = KEYS.get(name, ("documents", "doc_id"))
    keys = duckdb.connect().execute(f"SELECT count(DISTINCT {key}) FROM '{SF}/{table}.parquet'").fetchone()[0]
    assert out.select(key).distinct().count() == keys
    if name not in ("op2_hilbert_packing", "op13_lexical_search"):
        assert out.count() == keys
