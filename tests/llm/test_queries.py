"""The registered queries over whole tables: a row for each row, and the SQL's rows where there is SQL."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_simhash import brute, by_definition
from tokenizers import Tokenizer

from corpuslens.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_whole_table(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    key, of = {"op3_html_extraction": ("page_id", "pages"), "op13_vector_codes": ("vec_id", "embeddings")}.get(name, ("doc_id", "documents"))
    table = spark.read.parquet(f"{SF}/{of}.parquet")
    got = {r[key] for r in rows} if name == "op12_best_fit_packing" else [r[key] for r in rows]  # a row for each piece
    assert sorted(got) == sorted(r[0] for r in table.select(key).collect())
    if name not in registry.ORACLE_SQL:
        return
    c = duckdb.connect()
    for x in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {x} AS SELECT * FROM '{SF}/{x}.parquet'")
    r = c.sql(registry.ORACLE_SQL[name])
    columns = sorted(r.columns)
    assert sorted(rows[0].asDict()) == columns
    at = [r.columns.index(x) for x in columns]
    assert sorted(str(tuple(x[k] for k in columns)) for x in rows) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op4_by_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in texts(spark).items()}
    out = registry.QUERIES["op4_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in out} == want and all(r.over_limit == (r.n_tokens > 512) for r in out)


def test_op5_by_the_library(spark):
    t, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, set()
    for i, x in sorted(texts(spark).items()):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in registry.QUERIES["op5_token_files"](spark, SF).collect()} == want


def test_op7_by_brute_force(spark):
    docs = sorted(texts(spark).items())
    fps = np.array([by_definition(t) for _, t in docs], np.uint64)
    want = {i: (f"{int(f):016x}", docs[k][0]) for (i, _), f, k in zip(docs, fps, brute(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op7_simhash_near_dedup"](spark, SF).collect()} == want


def test_op12_by_the_library_and_plain_packing(spark):
    t, at, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    rows = sorted(registry.QUERIES["op12_best_fit_packing"](spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    for i, x in texts(spark).items():
        own[i] = [*t.encode(x or "", add_special_tokens=False).ids, 2]
    for r in rows:
        assert r.offset == at.get(r.sequence_id, 0) and r.offset + r.length <= 1024
        at[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.length == 1024 or r.piece == 0
    assert sum(r.length for r in rows) == sum(map(len, own.values()))
    left = []  # plain best fit, from the longest piece on
    for n in sorted((r.length for r in rows), reverse=True):
        k = min((k for k, room in enumerate(left) if room >= n), key=lambda k: left[k], default=None)
        if k is None:
            left.append(1024 - n)
        else:
            left[k] -= n
    assert len(at) <= len(left)
