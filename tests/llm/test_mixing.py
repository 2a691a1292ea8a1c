import random
from collections import Counter
from fractions import Fraction

import pytest

from corpuslens.llm import mixing as mx


@pytest.mark.parametrize("seed", range(8))
def test_schedule_meets_deadlines_and_deviates_by_less_than_a_block(seed):
    rng = random.Random(seed)
    share = mx.shares({i: rng.random() ** 3 + 1e-6 for i in range(rng.randint(1, 30))}, 500)
    assert sum(share.values()) == 500 and min(share.values()) >= 1
    had = Counter()
    for t, s in enumerate(mx.schedule(share), 1):
        had[s] += 1
        assert all(abs(had[k] - t * a / 500) < 1 for k, a in share.items())
    assert had == share


def rows_of(spark, n=3000):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "b", "c", None]), f"t{i}", i) for i in range(n)] + [(7, "a", "same", 0)] * 5 + [(None, "zz", None, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, block long").repartition(7)


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 3, None: 2, "zz": 1}, {"a": 3, "b": 1}, {"absent": 1}])
def test_positions_blocks_and_deviation(spark, weights):
    rows, df = rows_of(spark)
    out = mx.mixed(df, weights, block_rows=20)
    assert out.columns == [*df.columns, "mix"]
    got = sorted(out.collect(), key=lambda r: r.mix.position)
    assert [r.mix.position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source, r.text, r.block) for r in got) == Counter(rows)
    counts = Counter(r[1] for r in rows)
    by_slot = {r.mix.slot: r.source for r in got}
    assert sorted(by_slot) == list(range(sum(-(-n // 20) for n in counts.values())))
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in got)
    assert max(Counter((r.source, r.mix.block) for r in got).values()) == 20
    want = mx.temperature(counts, 0.5) if weights is None else weights
    plan = mx.phases(counts, want, 20)
    for start in {p["start"] for p in plan}:
        live = {p["source"]: p["share"] / p["length"] for p in plan if p["start"] == start}
        n = sum(p["last"] - p["first"] for p in plan if p["start"] == start)
        had = Counter()
        for t in range(1, n + 1):
            had[by_slot[start + t - 1]] += 1
            assert all(abs(had[s] - t * w) < 1 for s, w in live.items())


def test_same_order_again_and_empty(spark):
    rows, df = rows_of(spark, 500)
    one, two = ({(r.doc_id, r.text): r.mix.slot for r in mx.mixed(x, block_rows=10).collect()} for x in (df, df.repartition(3)))
    assert one == two
    assert mx.mixed(df.limit(0)).collect() == []


def test_in_mixed_order_keeps_rows_and_columns(spark, tmp_path):
    rows, df = rows_of(spark, 400)
    mx.in_mixed_order(df, block_rows=10).write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.columns == df.columns and Counter(map(tuple, back.collect())) == Counter(rows)


@pytest.mark.parametrize("tiny", [False, True])
def test_exact_weights_over_many_slots(tiny):
    """A third of the rows in one source and 19 equal ones: less than a block from the given weights, after any number of slots."""
    counts = {"big": 400_000} | {f"s{i:02}": 42_105 for i in range(19)} | ({"tiny": 50} if tiny else {})
    weights = mx.temperature(counts, 0.5) | ({"tiny": 0.01} if tiny else {})
    plan = [p for p in mx.phases(counts, weights, 100) if p["start"] == 0]
    slots = sorted((t, p["source"]) for p in plan for t in p["places"][: p["last"] - p["first"]])
    assert len(slots) > 5_000 and [t for t, _ in slots] == list(range(len(slots)))
    total, had = sum(map(Fraction, weights.values())), Counter()
    for t, s in slots:
        had[s] += 1
        if t % 50 == 0 or t > len(slots) - 50:
            assert all(abs(had[k] - (t + 1) * Fraction(w) / total) < 1 for k, w in weights.items())


def test_many_rounds_of_integer_weights_and_a_vanishing_weight(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "x") for i in range(400)] + [(900, "c", "x")], "doc_id long, source string, text string")
    got = sorted(mx.mixed(df, {"a": 3, "b": 1, "c": 1e-300}, block_rows=2).collect(), key=lambda r: r.mix.position)
    assert [r.mix.position for r in got] == list(range(401))
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in got)
    assert Counter(r.source for r in got[:240]) == {"a": 180, "b": 60}


def by_lists(counts, weights, block_rows):
    """Pfair by definition, slot by slot: of the released blocks of live sources the one that is due first, all by fractions."""
    left = {s: -(-n // block_rows) for s, n in counts.items() if n}
    done, out, start, j = dict.fromkeys(left, 0), [], 0, dict.fromkeys(left, 0)
    while left:
        w = {s: Fraction(weights.get(s, 0)) for s in left if weights.get(s, 0) > 0} or {s: Fraction(1) for s in left}
        total, t = sum(w.values()), 0
        j = dict.fromkeys(w, 0)
        while True:
            ready = [(-(-(j[s] + 1) * total // w[s]), str(s), s) for s in w if j[s] * total // w[s] <= t]
            due, _, s = min(ready, key=lambda r: r[:2])
            out.append((s, done[s], start + j[s] * total // w[s], start + due, start + t))
            j[s] += 1
            done[s] += 1
            t += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        start += t
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 3, None: 2, "zz": 1}, {"a": 3, "b": 1}, {"absent": 1}])
def test_every_block_by_a_plain_loop(spark, weights):
    rows, df = rows_of(spark, 1200)
    counts = Counter(r[1] for r in rows)
    want = by_lists(counts, mx.temperature(counts, 0.5) if weights is None else weights, 20)
    got = {(r.source, r.mix.block, r.mix.release, r.mix.deadline, r.mix.slot) for r in mx.mixed(df, weights, block_rows=20).collect()}
    assert got == set(want) and len(want) == len(got)


def test_rows_that_differ_elsewhere_are_ordered(spark):
    rows = [(1, "a", "t", x) for x in range(40)]
    one, two = ({r.x: r.mix.position for r in mx.mixed(spark.createDataFrame(rs, "doc_id long, source string, text string, x int").repartition(3), block_rows=4).collect()} for rs in (rows, rows[::-1]))
    assert one == two and sorted(one.values()) == list(range(40))
