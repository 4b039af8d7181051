"""Columns, types and row counts of the registered queries on the smallest tables."""

import os

import pytest

from tessera.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    2: "doc_id bigint, held_out boolean, score double, predicted int",
    3: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    4: "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    5: "doc_id bigint, fingerprint string, component_id bigint",
    6: "query_id bigint, rank int, vec_id bigint, score double",
    7: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    8: "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    9: "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    10: "doc_id bigint, held_out boolean, score double, predicted int",
}


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_contract_columns(spark, name):
    n = int(name[2:].split("_")[0])
    df = QUERIES[name](spark, FOLDER)
    got = ", ".join(f"{c} {k}" for c, k in df.dtypes)
    assert got == COLUMNS[n] or got.startswith(COLUMNS[n] + ", ")
    rows = df.toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if n in (1, 2, 3, 4, 5, 7, 10):
        assert sorted(rows["doc_id"]) == sorted(r[0] for r in docs.select("doc_id").collect())
    elif n == 8:
        assert set(rows["doc_id"]) == {r[0] for r in docs.select("doc_id").collect()}
    elif n == 9:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
        assert len(rows) == 20 * len([i for i in range(0, vectors, 20)])
    assert not rows.drop(columns=["component_id"], errors="ignore").isna().any().any()


#: What SQL can say of a query's rows: the columns that don't need its method.
PARTS = {
    "op1_secret_scan": r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 12)) AS n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 18)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 16)) AS n_hex FROM documents""",
    "op3_token_counts": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "op4_media_chunks": """SELECT doc_id, strlen(t) AS n_bytes, n AS payload_bytes, sha256(encode(t) || from_hex(repeat('00', CAST(n - strlen(t) AS INTEGER)))) AS payload_sha256, n + 44 AS media_bytes
        FROM (SELECT doc_id, coalesce(text, '') AS t, greatest(64, CAST(ceil(strlen(coalesce(text, '')) / 64) * 64 AS BIGINT)) AS n FROM documents)""",
    "op7_byte_bpe": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "op9_chat_masks": """SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, '' ORDER BY turn, role, text), '')) AS loss_sha256
        FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]') GROUP BY conv_id""",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", PARTS)
def test_columns_that_sql_can_say(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    want = con.sql(PARTS[name])
    got = QUERIES[name](spark, FOLDER).select(want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((*map(lambda x: int(x) if isinstance(x, float) else x, r),) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", ["op2_pairwise_quality", "op10_toxicity_cnn"])
def test_the_held_out_fifth(spark, name):
    import zlib

    rows = QUERIES[name](spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows) and any(r["held_out"] for r in rows)
