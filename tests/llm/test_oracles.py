"""Queries that SQL can express, against DuckDB; the others against brute force."""

import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from symgraph.llm import queries
from symgraph.llm.tokens import vocabulary
from tests.oracle import assert_equal, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in docs}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(name, spark, sf_dir, con):
    assert_equal(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], con)


def test_toxicity_holds_up_on_unseen_documents(spark, sf_dir, con):
    rows = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf_dir).collect()}
    labels = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for d, r in rows.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    right = [rows[d]["predicted"] == y for d, y in labels.items() if rows[d]["held_out"]]
    assert sum(right) >= 0.85 * len(right)


def test_token_file(spark, sf_dir, docs, ids):
    rows = {r["doc_id"]: r for r in queries.op2_token_file(spark, sf_dir).collect()}
    start = 0
    for d, _ in docs:
        own = [*ids[d], 2]
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(own), crc(own))
        start += len(own)


def test_merge_dropout_decodes_every_text(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op4_merge_dropout(spark, sf_dir).collect()}
    assert {d: (rows[d]["decoded_crc32"], rows[d]["decoded_bytes"]) for d, _ in docs} == {d: (zlib.crc32(t.encode()), len(t.encode())) for d, t in docs}


def test_sharding(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op5_sharding(spark, sf_dir).collect()}
    fill, slots, groups = [0] * 16, {}, {}
    for d, t in docs:
        r = rows[d]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        fill[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(t, set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    largest = max(len(t.encode()) + 1 for _, t in docs)
    assert max(fill) - min(fill) <= largest


def test_packing(spark, sf_dir, docs, ids):
    rows = queries.op8_packing(spark, sf_dir).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, _ in docs:
        own, at = [*ids[d], 0], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(own[at : at + r["length"]]) and r["doc_tokens"] == len(own)
            at += r["length"]
        assert at == len(own)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values())) + len(docs)
    assert total >= 0.97 * 1024 * (len(windows) - 1)


def test_language_id(spark, sf_dir):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = queries.op10_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
