import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = sc.Codec(PATH)


def ids(text: str) -> list[int]:
    return np.frombuffer(CODEC.encode([text])[0], "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("   the ing▁\n\té日")), max_size=50))
def test_ids_and_texts_equal_the_library(text):
    want = LIBRARY.encode(text)
    assert ids(text) == want
    assert CODEC.decode(np.array(want, np.int32)) == LIBRARY.decode(want)


@pytest.mark.parametrize("block", [20, 1000])
def test_blocks_of_the_index_overlap(monkeypatch, block):
    monkeypatch.setattr(sc, "INDEX_CHARS", block)
    texts = ["theinformationabout" * 40, "a" * 500, " " * 300 + "x", "word " * 200, "<s> </s> <0x0A>"]
    got = sc.Codec(PATH).encode(texts)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [LIBRARY.encode(t) for t in texts]


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(sc, "CACHE_ENTRIES", 3)
    codec = sc.Codec(PATH)
    texts = ["one two three four five", "six seven one", "two nine ten", ""]
    for _ in range(2):
        assert [np.frombuffer(g, "<i4").tolist() for g in codec.encode(texts)] == [LIBRARY.encode(t) for t in texts]


def test_operator_rows_and_decoding(spark):
    rows = [(1, "Hello  world", 1), (None, None, 2), (2, "", 3), (2, "", 3), (3, "é日 \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r.doc_id, tuple(r.ids), r.n_tokens, r.round_trip) for r in sc.encoded(df, PATH).collect()}
    assert out == {(i, tuple(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")), True) for i, t, _ in rows}
    back = sorted(str(r.text) for r in sc.decoded(sc.encoded(df, PATH), PATH).collect())
    assert back == sorted(t or "" for _, t, _ in rows)
    assert sc.encoded(df.limit(0), PATH).collect() == []


def test_long_chunks_equal_the_library():
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(["the", "ing", "tion", "a", "e", "日", "\n", "é", "x", "qz", "="]) for _ in range(n)) for n in (20, 41, 400, 30_000)]
    texts += ["ab" * 20_000, "a" * 39 + " " + "b" * 41, "é" * 300 + "퟿" * 50, "=" * 1000]
    got = sc.Codec(PATH).encode(texts)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [LIBRARY.encode(t) for t in texts]


def test_millions_of_characters_without_a_space_take_bounded_memory():
    code = "import random,sys,resource;sys.path.insert(0,sys.argv[1]);from corpuslens.llm import sentencepiece_codec as sc;r=random.Random(1);t=''.join(r.choices(['the','ing','e','tion','q','st'],k=700_000));c=sc.Codec(sys.argv[2]);a=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;n=len(c.encode([t])[0]);print(len(t),n,(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss-a)//1024)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    chars, size, megabytes = map(int, subprocess.run([sys.executable, "-c", code, root, PATH], capture_output=True, text=True, check=True).stdout.split())
    assert chars > 1_400_000 and size > 1_000_000 and megabytes < 350
