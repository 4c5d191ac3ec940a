"""Registered queries on the smallest sample: columns of the contract, and SQL where it can express them."""
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from cargolake.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_minhash": "doc_id n_shingles component_id kept",
    "op4_best_fit": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_stratified_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_crf_quality": "doc_id held_out score predicted",
    "op11_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op12_cross_align": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}


@pytest.fixture(scope="module", autouse=True)
def data():
    if not Path(DATA).exists():
        pytest.skip("sample tables are not there")


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    key, table = ("vec_id", "embeddings") if name == "op13_vector_codes" else ("doc_id", "documents")
    documents = {r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in rows} == documents
    if name != "op4_best_fit":
        assert len(rows) == len(documents)
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for table in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        want = con.sql(sql)
        columns = sorted(want.columns)
        assert columns == sorted(df.columns)
        assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(want.select(*columns).fetchall())
