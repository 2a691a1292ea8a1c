import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import vector_codes as vc


def plain(rows, parts, entries, rounds):
    """The definition in loops: (vec_id, label, code, error) of the kept rows, and the codebooks."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def d2(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda k: d2(x[p], books[p][k])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(y) // len(own) for y in zip(*own, strict=True)]
    return [(i, label, "".join(f"{k:02x}" for k in c), sum(d2(x[p], books[p][c[p]]) for p in range(parts))) for (i, _, label), x, c in zip(kept, cut, assign(), strict=True)], books


def vectors(n, dims, seed, levels=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype(np.float32)
    return (np.round(v * levels) / 4096 if levels else v).astype(np.float32).tolist()


def df_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, codes string")


@pytest.mark.parametrize(("levels", "parts", "entries"), [(None, 8, 16), (1.2, 8, 16), (1.2, 2, 5)])
def test_by_plain_loops(spark, levels, parts, entries):
    """levels: few distinct integers, so many equal distances."""
    v = vectors(300, 16, 1, levels)
    rows = [(i * 7 % 301, x, i % 3 if i % 5 else None) for i, x in enumerate(v)]
    rows += [(900, None, 1), (901, [None] + v[0][1:], 1), (902, [float("nan")] + v[0][1:], 1), (903, [float("inf")] + v[0][1:], 1), (904, [], 1), (905, v[0][:8], 1), (None, v[3], 2), (5, v[4], 2), (5, v[4], 2)]
    out, books = vc.encoded(df_of(spark, rows), parts=parts, entries=entries)
    want, plain_books = plain(rows, parts, entries, 6)
    assert books.tolist() == plain_books
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.7, 2.0, 50.0]), st.integers(1, 9))
def test_bounds_never_change_a_result(seed, levels, n):
    x = vc.integers(np.array(vectors(80, 8, seed, levels)).ravel(), 8, 2)
    books = vc.Codebooks(x[:n].swapaxes(0, 1).copy())
    state, sums = books.assign(x), 0
    before = None
    for _ in range(6):
        sums = sums + books.changes(x, state[0], before)
        moved = vc.Codebooks(vc.mean_down(sums, books.entries), books.entries)
        before = state[0]
        *state, scanned = moved.again(x, *state)
        full = moved.assign(x)
        assert (state[0] == full[0]).all() and scanned <= x.shape[0] * x.shape[1]
        assert (state[1] >= full[1] * (1 - 1e-9)).all() and (state[2] <= full[2] * (1 + 1e-9)).all()
        books = moved


def test_bounds_spare_scans():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 8)) * 10
    x = vc.integers((centres[rng.integers(0, 4, 500)] + rng.normal(size=(500, 8)) * 0.1).ravel(), 8, 2)
    books = vc.Codebooks(vc.integers(centres.ravel(), 8, 2).swapaxes(0, 1).copy())
    state = books.assign(x)
    moved = vc.Codebooks(vc.mean_down(books.changes(x, state[0], None), books.entries), books.entries)
    assert moved.again(x, *state)[3] == 0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, x, None) for i, x in enumerate(vectors(n, 16, 2))]
    out, books = vc.encoded(df_of(spark, rows))
    want, plain_books = plain(rows, 8, 16, 6)
    assert books.tolist() == plain_books or n == 0
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_huge_components_and_lengths_that_do_not_divide(spark):
    rows = [(0, [1e30, -1e30, 0.5], 1), (1, [0.25, 1.0, -3.0], 1), (2, [3e38, 0.0, 0.0], 2)]
    out, books = vc.encoded(df_of(spark, rows), parts=2, entries=2)
    assert books.shape == (2, 2, 2) and len(out.collect()) == 3 and abs(books).max() <= vc.limit_of(3)


def test_decoded_and_label_errors(spark):
    rows = [(i, x, [None, 1, 2][i % 3]) for i, x in enumerate(vectors(60, 16, 4))]
    out, books = vc.encoded(df_of(spark, rows))
    back = vc.decoded(out, books).collect()
    for r in back:
        want = [x / 4096 for p in range(8) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)].tolist()]
        assert r.vector == want
    sums = {}
    for r in back:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in vc.with_label_error(out).collect())
