"""The registered queries on the smallest tables: columns, rows, SQL twins."""

import pytest

from tests import twins
from wattledger.llm.catalog import QUERIES, SQL_TWINS

COLUMNS = {
    "op1_topk": ("embeddings", ["query_id", "rank", "vec_id", "score"]),
    "op2_quality": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op4_urls": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    "op5_bpe": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op6_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op7_minhash": ("documents", ["doc_id", "n_shingles", "component_id", "kept"]),
    "op8_mixing": ("documents", ["doc_id", "tokens", "rate", "copies"]),
    "op9_covertree": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op10_secrets": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op11_langid": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op12_codes": ("embeddings", ["vec_id", "code", "error", "label_error", "codebooks_sha256"]),
    "op13_merkle": ("documents", ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]),
}


def test_there_is_one_query_for_each_operator():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    table, columns = COLUMNS[name]
    got = QUERIES[name](spark, small)
    assert set(columns) <= set(got.columns)
    rows = spark.read.parquet(f"{small}/{table}.parquet")
    assert got.count() == (10 * rows.where("vec_id % 100 = 0").count() if name == "op1_topk" else rows.count())


@pytest.mark.parametrize("name", sorted(SQL_TWINS))
def test_twin(spark, small, name):
    got = twins.rows_of_spark(QUERIES[name](spark, small))
    assert twins.difference(got, twins.rows_of_sql(twins.connect(small), SQL_TWINS[name])) is None
