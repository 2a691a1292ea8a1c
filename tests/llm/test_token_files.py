import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import token_files as tf
from corpuslens.llm.token_count import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = tf.Words(PATH)


def by_library(text):
    return encoder(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"]), st.sampled_from(" 'stredvmlİÉΣ1²ª")), max_size=60))
def test_ids_equal_the_library(text):
    assert np.frombuffer(WORDS.ids(text), "<i4").tolist() == by_library(text)


def test_special_strings_and_long_texts():
    for text in ("<|endoftext|>", "a<|startoftext|>b", "Word's " * (tf.LONG_TEXT // 6)):
        assert np.frombuffer(WORDS.ids(text), "<i4").tolist() == by_library(text)


def test_round_trip_order_and_encodings(spark, tmp_path):
    rows = [(i * 7 % 101, f"Text number {i} it's ÉTÉ", i) for i in range(101)] + [(None, None, 0), (5, "", 0), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    tf.write_tokens(df, PATH, str(tmp_path / "t"))
    out = tf.checked_tokens(spark, str(tmp_path / "t")).collect()
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = by_library(t) + [tf.END_ID]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [r[1:] for r in sorted((r.start, r.n_tokens) + (0,) for r in out)]
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1])
    assert [g for g in got if g[0] != 5] == [w for w in want if w[0] != 5]
    assert sorted(g[2] for g in got if g[0] == 5) == sorted(w[2] for w in want if w[0] == 5)
    assert got[-1][1] + got[-1][2] == at
    files = sorted((tmp_path / "t").glob("*.parquet"))
    c = pq.ParquetFile(files[0]).metadata.row_group(0)
    by = {c.column(k).path_in_schema: c.column(k) for k in range(c.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and any("DICTIONARY" in e for e in by["ids.list.element"].encodings)
    assert by["doc_id"].has_column_index and by["doc_id"].has_offset_index
    ids = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert {r.doc_id for r in tf.read_tokens(spark, str(tmp_path / "t"), 3, 9).collect()} == set(range(3, 10))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    tf.write_tokens(df, PATH, str(tmp_path / "t"))
    assert tf.checked_tokens(spark, str(tmp_path / "t")).collect() == []
