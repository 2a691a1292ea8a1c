import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import packing as pk
from corpuslens.llm.common import stored
from corpuslens.llm.token_count import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
IDS = pk.Ids(PATH)
ONES = (1.0, 1.0, 1.0)


def by_library(text):
    return encoder(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"]), st.sampled_from(" 's\n中")), max_size=60))
def test_ids_equal_the_library(text):
    assert np.frombuffer(IDS.ids(text), "<u4").tolist() == by_library(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "\xa0", "a", "it's", "12", "é", ".", "!?", "中", "<|endoftext|>", "'", "\r\n"]), max_size=14))
def test_ids_of_words_and_white_space(parts):
    text = "".join(parts)
    assert np.frombuffer(IDS.ids(text), "<u4").tolist() == by_library(text)


def test_both_mergers_agree(monkeypatch):
    import json

    class Shuffled:
        """The same tokenizer, whose merges can't be told to be in the order of ids."""

        model, to_str = encoder(PATH).model, lambda self: json.dumps({"model": {**json.loads(encoder(PATH).to_str())["model"], "ignore_merges": True}})
        get_added_tokens_decoder = lambda self: encoder(PATH).get_added_tokens_decoder()

    by_ids, by_model, rng = pk.merger(encoder(PATH)), pk.merger(Shuffled()), random.Random(2)
    words = [" " + "".join(rng.choice("abcdefghiklmnoprstuvé中") for _ in range(rng.randint(1, 15))) for _ in range(3000)] + ["'", "  ", "\n\n", "😀" * 9]
    assert all(by_ids(w.encode()) == by_model(w.encode()) for w in words)


def test_special_strings():
    for text in ("<|endoftext|>", "a <|endoftext|><|endoftext|> b", "word " * 300_000):
        assert np.frombuffer(IDS.ids(text), "<u4").tolist() == by_library(text)


def one_by_one(lengths, whole, score, weights):
    """The rule in plain loops: (length, sequence, offset) for each piece, longest first."""
    bins, out = [], []
    for n in sorted(lengths, reverse=True):
        ask = (n, 1, n * n)
        able = [k for k, left in enumerate(bins) if all(a <= b for a, b in zip(ask, left, strict=True))]
        if able:
            k = min(able, key=lambda k: (pk.fit(bins[k], ask, whole, score, weights), k))
        else:
            k = len(bins)
            bins.append(tuple(whole))
        out.append((n, k, whole.tokens - bins[k][0]))
        bins[k] = tuple(b - a for a, b in zip(ask, bins[k], strict=True))
    return out


def spread(steps):
    return [(s.length, s.sequence + i // s.each, s.offset + i % s.each * s.length) for s in steps for i in range(s.pieces)]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize(("whole", "weights"), [(pk.capacity(50), ONES), (pk.capacity(50, 3), ONES), (pk.capacity(50, 4, 900), (1.0, 2.0, 0.5)), (pk.capacity(7, 2, 49), ONES)])
def test_plan_equals_placing_one_by_one(whole, weights, score):
    rng = random.Random(3)
    for n in (0, 1, 5, 60, 400):
        for most in (whole.piece(), max(1, whole.piece() // 4)):
            lengths = [rng.randint(1, most) for _ in range(n)]
            assert spread(pk.plan(Counter(lengths), whole, score, weights)) == one_by_one(lengths, whole, score, weights)


def test_plan_is_small_however_many_pieces():
    rng = random.Random(5)
    few = {n: rng.randint(1, 1000) for n in range(1, 1025)}
    many = {n: c * 10**7 + rng.randint(0, 10**6) for n, c in few.items()}
    steps = pk.plan(many, pk.capacity())
    total = sum(n * c for n, c in many.items())
    assert len(steps) < 20_000
    used = max(s.sequence + -(-s.pieces // s.each) for s in steps)
    assert used >= total / 1024 and used < 1.01 * total / 1024


def holds(rows, whole):
    """Every sequence is gapless from 0 and within its capacities."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= whole.tokens and len(own) <= whole.documents and sum(n * n for _, n in own) <= whole.cost
    return len(by)


@pytest.mark.parametrize("whole", [pk.capacity(64), pk.capacity(64, 3, 2000)])
def test_documents(spark, whole):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta's", "été", "中文", "x9"]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, "no id"), (7, "again"), (7, "again"), (600, "long text " * 30_000), (601, "a<|endoftext|>b")]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, piece int, place int")
    rows = pk.pack(df, PATH, whole, with_ids=True).collect()
    assert holds(rows, whole) == len({s for _, s, _ in one_by_one([r.length for r in rows], whole, "norm", ONES)})
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    for i, text in docs:
        own = sorted(got[i], key=lambda r: (r.piece, r.sequence_id, r.offset))
        if i == 7:
            continue
        ids = [*by_library(text), 2]
        assert [x for r in own for x in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == whole.piece() for r in own[1:]) and all(r.start == sum(x.length for x in own[: r.piece]) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    again = zlib.crc32(np.array([*by_library("again"), 2], "<u4").tobytes())
    assert sum(r.ids_crc32 == again for r in got[7]) == 2


def test_sequences(spark):
    df = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(100)], "doc_id long, text string")
    placed = stored(pk.pack(df, PATH, pk.capacity(50), with_ids=True), "placed")
    rows = pk.sequences(placed).collect()
    assert sum(len(r.ids) for r in rows) == sum(len(by_library("word " * (i % 40))) + 1 for i in range(100))
    assert all(len(r.ids) == sum(r.lengths) <= 50 and len(r.doc_ids) == len(r.lengths) for r in rows)
    assert all(r.ids[sum(r.lengths[: k + 1]) - 1] == 2 for r in rows for k in range(len(r.lengths)))


def test_empty_table_and_bad_capacity(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError, match="positive"):
        pk.capacity(10, -1)
