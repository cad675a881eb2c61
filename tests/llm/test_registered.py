"""Registered queries: those with SQL against DuckDB, all others for rows and columns."""

import duckdb
import pytest

from sonolake.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_lm_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_embeddings": {"vec_id", "n_links", "component_id", "kept"},
    "op10_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    table = {"op9_embeddings": "embeddings", "op10_warc": "pages"}.get(name, "documents")
    df = queries.QUERIES[name](spark, SF)
    assert set(df.columns) >= COLUMNS[name]
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
