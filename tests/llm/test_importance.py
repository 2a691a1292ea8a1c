import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from corpuslens.llm import importance as im


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, target, percent, least, longest, buckets, seed):
    """The definition in loops: (doc_id, n_features, weight, score, rank) in the order of docs."""

    def found(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    each = [found(t) for _, t in docs]
    s, t = Counter(b for x in each for b in x), Counter(b for x in target for b in found(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for (i, text), x in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least])
    order = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    ranks = {k: n + 1 for n, k in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_by_plain_loops(spark, longest):
    docs = [(i, f"Word{i % 7} ÉTÉ the-the {'common ' * (i % 50)}x_{i}") for i in range(120)] + [(500, None), (501, ""), (502, "?!\n\x7f"), (503, "A" * 200_000 + " b" * 30), (None, "Nobody's words " * 20), (7, "again " * 25)]
    docs += [(600, "same text " * 15)] * 2
    target = ["common words été", None, "word3 x_3 The end"]
    df = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, rank int, gain string")
    out = im.resampled(df, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), 30, 20, longest, 97, "s").collect()
    got = sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out)))
    assert got == sorted(map(str, plain(docs, target, 30, 20, longest, 97, "s")))


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, f"w{i} " * 25, i * 2) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept int")
    judged = im.resampled(df, spark.createDataFrame([("w3 w4",)], "text string"), 25)
    out = im.drawn(df, judged).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in judged.collect() if r["rank"]) and len(out) == 10
    assert all(r.kept == 2 * r.doc_id for r in out)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(im, "gumbel", lambda doc_id, seed: F.lit(0).cast("long"))
    df = spark.createDataFrame([(i, "a b " * 10) for i in range(50)], "doc_id long, text string")
    out = {r.doc_id: r["rank"] for r in im.resampled(df, df).collect()}
    assert out == {i: i + 1 if i < 5 else None for i in range(50)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert im.resampled(none, some).collect() == []
    (r,) = im.resampled(some, none, percent=100).collect()
    assert r["rank"] == 1 and r.n_features == 30


def test_no_python_on_the_way(spark):
    out = im.resampled(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("b",)], "text string"))
    assert "Python" not in (plan := out._jdf.queryExecution().toString()) and "Arrow" not in plan
