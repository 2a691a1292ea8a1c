import random

import numpy as np
import pytest
import xxhash

from corpuslens.llm import simhash as sh


def by_definition(text):
    words, w = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}):
        if c in " \t\n\x0b\x0c\r":
            words.append(w)
            w = ""
        else:
            w += c
    words = [w for w in [*words, w] if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "A b c D", "a b c d e", "É é\x0bx\xa0y z w", "w " * 50_000 + "end", "x" * 100_000])
def test_fingerprint_by_definition(text):
    assert sh.fingerprint(text) == by_definition(text)


def brute(fps):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("layout", list(sh.LAYOUTS))
def test_every_close_pair_shares_a_home_anchor(layout):
    rng = random.Random(3)
    for _ in range(40):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        key, row, home = sh.anchors(np.array([x, y], np.uint64), sh.LAYOUTS[layout])
        at = [set(key[(row == i) & home].tolist()) for i in (0, 1)], [set(key[row == i].tolist()) for i in (0, 1)]
        assert at[0][0] & at[1][1] and at[0][1] & at[1][0]
        assert (np.unique(np.stack([key, row]), axis=1).shape[1]) == len(key)


@pytest.mark.parametrize(("layout", "block"), [("coarse", 200_000), ("fine", 200_000), ("coarse", 20)])
def test_components_match_brute_force(spark, layout, block):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for i in range(150):  # chains, stars and a dense ball
        base = fps[rng.randrange(len(fps))] if i % 3 else fps[0]
        for b in rng.sample(range(64), rng.randint(1, 5)):
            base ^= 1 << b
        fps.append(base)
    arr = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long").repartition(5)
    star = {r.v: r.root for r in sh.starred(sh.near_links(nodes, sh.LAYOUTS[layout]), block=block).collect()}
    roots = brute(arr)
    got, want = {}, {}
    for x, r in zip(arr.view(np.int64).tolist(), roots, strict=True):
        got.setdefault(star.get(x, x), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize(("layout", "most"), [("coarse", 3), ("coarse", 40), ("fine", 10)])
def test_hot_anchors_match_brute_force(spark, layout, most):
    """Fingerprints that share their lowest 32 bits, some linked; groups stay hot after the second dealing, too."""
    rng = random.Random(6)
    fps = [rng.getrandbits(32) << 32 | 77 for _ in range(100)] + [rng.getrandbits(64) for _ in range(50)]
    for i in range(250):
        base = fps[rng.randrange(len(fps))] if i % 2 else fps[0]
        for b in rng.sample(range(64), rng.randint(1, 4)):
            base ^= 1 << b
        fps.append(base)
    arr = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long").repartition(3)
    star = {r.v: r.root for r in sh.starred(sh.near_links(nodes, sh.LAYOUTS[layout], most)).collect()}
    got, want = {}, {}
    for x, r in zip(arr.view(np.int64).tolist(), brute(arr), strict=True):
        got.setdefault(star.get(x, x), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_hot_anchor_is_split_over_tasks(spark):
    """100,000 fingerprints at one anchor: no group that a task compares has more than HOT_ROWS twice."""
    from pyspark.sql import functions as F

    n = 100_000
    nodes = spark.range(n).select((F.xxhash64("id").bitwiseAND(F.lit(-(2**21)))).alias("fp")).distinct()
    placed = []

    def spy(df, most):
        placed.append(df)
        return real_split(df, most)

    real_split = sh.split_hot
    sh.split_hot = spy
    try:
        links = sh.near_links(nodes, sh.LAYOUTS["coarse"])
        assert links.count() >= 0
    finally:
        sh.split_hot = real_split
    assert len(placed) == 2  # hot once; its segments aren't
    first, second = (p.groupBy("anchor").count().agg(F.max("count")).first()[0] for p in placed)
    assert first > sh.HOT_ROWS > second


def test_operator_on_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " x"), (9, base), (9, base), (None, None), (7, ""), (8, "lonely words here and now"), (None, "only null has this text, it is alone")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    out = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in sh.near_duplicates(df).collect())
    fp = {t: f"{by_definition(t):016x}" for _, t in rows}
    assert [(a, b) for a, b, _ in out] == sorted((str(i), fp[t]) for i, t in rows)
    comp = {a: c for a, _, c in out if a != "None"}
    assert comp["5"] == comp["9"] and comp["7"] == "7" and comp["8"] == "8"
    assert sorted(c for a, _, c in out if a == "None") == ["7", "None"]
    assert sh.near_duplicates(df.limit(0)).collect() == []
    assert sum(r.kept for r in sh.representatives(df).collect()) == len({c for _, _, c in out})


def test_one_partition_of_more_nodes_than_a_forest_holds(spark):
    n = 100_000  # as many components of three, on 200,000 edges: contracted by one task
    edges = spark.range(n).selectExpr("id a", f"id + {n} b").unionByName(spark.range(n).selectExpr(f"id + {n} a", f"id + {2 * n} b"))
    star = sh.starred(edges)
    assert star.count() == 2 * n
    assert star.selectExpr("v", "root").exceptAll(spark.range(n, 3 * n).selectExpr("id v", f"id % {n} root")).count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_small_forests_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "FOREST_NODES", 5)
    monkeypatch.setattr(sh, "FOREST_EDGES", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        edges = spark.createDataFrame([(i, i + 10) for i in range(60)], "a long, b long")  # ten chains
        got = {(r.v, r.root) for r in sh.starred(edges, block=block).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(v, v % 10) for v in range(10, 70)}
