"""Occurrences in changed sources and changed lines, by side, with terms and roles; linear-time scanners."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.functions import scanners as sc
from corpuslens.functions import text as tx
from corpuslens.operators import changes as ch
from corpuslens.plans import scanned
from corpuslens.request import RequestError, validated

OLD = [
    ("src/a.py", "# needle kept\ndef f():\n    needle = 1\n    other = 2\n"),
    ("src/b.py", "needle\n"),
    ("gone.txt", "needle é needle"),
    ("same.txt", "needle\n"),
]
NEW = [
    ("src/a.py", "# needle kept\ndef f():\n    needle = 2\n    other = 'needle'\ndef g():\n    needle(other)\n"),
    ("src/b.py", "needle\n"),
    ("new.txt", "é needle\nother"),
    ("same.txt", "needle\n"),
]


@pytest.fixture(scope="module")
def engine(spark):
    version = lambda rows: spark.createDataFrame(rows, "path string, text string").withColumn("content_hash", F.sha2("text", 256))
    return Engine(spark, version(NEW), versions={"old": version(OLD), "new": version(NEW)})


def rows(engine, *columns, changes=(), **request):
    out = engine.search({**request, "changes": {"base": "old", "target": "new", **dict(changes)}}).evidence.collect()
    return sorted(tuple(r[c] for c in columns) for r in out)


def test_pattern_by_scope_and_side(engine):
    at = ("path", "change", "line_no", "byte_start")
    assert rows(engine, *at, pattern="needle", literal=True) == [("new.txt", "added", 1, 3), ("src/a.py", "modified", 1, 2), ("src/a.py", "modified", 3, 27), ("src/a.py", "modified", 4, 51), ("src/a.py", "modified", 6, 72)]
    lines = {"scope": "lines"}
    assert rows(engine, *at, pattern="needle", literal=True, changes=lines) == [("new.txt", "added", 1, 3), ("src/a.py", "modified", 3, 27), ("src/a.py", "modified", 4, 51), ("src/a.py", "modified", 6, 72)]
    assert rows(engine, *at, pattern="needle", literal=True, changes=lines | {"side": "old"}) == [("gone.txt", "removed", 1, 0), ("gone.txt", "removed", 1, 10), ("src/a.py", "modified", 3, 27)]
    assert rows(engine, "path", "line_no", pattern="^needle$", changes=lines) == []
    assert rows(engine, "path", "excerpt", pattern="needle.$", changes=lines) == [("src/a.py", "    other = 'needle'")]


def test_terms(engine):
    lines = {"scope": "lines"}
    assert rows(engine, "term", "path", "byte_start", anyOf=["needle", "other"], changes=lines, path="src") == [("needle", "src/a.py", 27), ("needle", "src/a.py", 51), ("needle", "src/a.py", 72), ("other", "src/a.py", 42), ("other", "src/a.py", 79)]
    assert rows(engine, "path", anyOf=["needle"]) == [("new.txt",)] + [("src/a.py",)] * 4  # no unchanged source
    assert rows(engine, "path", "occurrences", allOf=["needle", "other"]) == [("new.txt", [1, 1]), ("src/a.py", [4, 2])]
    assert rows(engine, "path", "occurrences", allOf=["needle", "other"], changes=lines | {"side": "old"}) == [("src/a.py", [1, 1])]
    assert rows(engine, "path", "label", allOf=["needle", "other"], allOfScope="function", changes=lines) == [("src/a.py", "f"), ("src/a.py", "g")]
    assert rows(engine, "path", "label", allOf=["needle", "kept"], allOfScope="function", changes=lines) == []


def test_roles(engine):
    at = ("path", "line_no")
    assert rows(engine, *at, pattern="needle", literal=True, roles=["comment"]) == [("src/a.py", 1)]
    assert rows(engine, *at, pattern="needle", literal=True, roles=["comment"], changes={"scope": "lines"}) == []
    assert rows(engine, *at, pattern="needle", literal=True, roles=["string", "call"], changes={"scope": "lines"}) == [("src/a.py", 4), ("src/a.py", 6)]


def test_files_lists_and_fields(engine):
    assert rows(engine, "path", "change") == [("gone.txt", "removed"), ("new.txt", "added"), ("src/a.py", "modified")]
    assert rows(engine, "path", "ranges", changes={"scope": "lines"}) == [("new.txt", ("", "1-2")), ("src/a.py", ("3-4", "3-6"))]
    assert rows(engine, "path", paths=["new.txt"]) == [("new.txt",)]
    assert len(engine.search({"pattern": "needle", "limit": 2, "changes": {"base": "old", "target": "new"}}).page()[0]) == 2
    assert len(engine.search({"anyOf": ["needle"], "limit": 2}).page()[0]) == 2 and len(engine.search({"allOf": ["needle"], "limit": 1}).page()[0]) == 1


@pytest.mark.parametrize(
    ("request_", "code"),
    [
        ({"changes": "x"}, "E_FIELD_VALUE"),
        ({"changes": {"base": "a"}}, "E_FIELD_MISSING"),
        ({"changes": {"base": "a", "target": "b", "lines": True}}, "E_FIELD_UNKNOWN"),
        ({"changes": {"base": "a", "target": "b", "scope": "all"}}, "E_FIELD_VALUE"),
        ({"changes": {"base": "a", "target": "b", "side": "left"}, "pattern": "x"}, "E_FIELD_VALUE"),
        ({"changes": {"base": "a", "target": "b", "side": "old"}}, "E_FIELD_CONFLICT"),
        ({"changes": {"base": "a", "target": "b"}, "roles": ["call"]}, "E_FIELD_MISSING"),
        ({"changes": {"base": "a", "target": "b"}, "pattern": "x", "modifiedAfter": 1}, "E_FIELD_CONFLICT"),
        ({"changes": {"base": "a", "target": "b"}, "anyOf": ["x"], "roles": ["call"]}, "E_FIELD_CONFLICT"),
    ],
)
def test_refused(request_, code):
    with pytest.raises(RequestError) as e:
        validated(request_)
    assert e.value.code == code


def test_too_much_work_is_said(spark, monkeypatch, engine):
    big = lambda seed: "\n".join(str((i * seed) % 9973) for i in range(9000))
    version = lambda t: spark.createDataFrame([("big.txt", t)], "path string, text string").withColumn("content_hash", F.sha2("text", 256))
    e = Engine(spark, version(big(7)), versions={"a": version(big(7)), "b": version(big(11))})
    r = e.search({"pattern": "1", "changes": {"base": "a", "target": "b", "scope": "lines"}})
    assert r.coverage["versions"] == "partial" and "big.txt" in r.notes[0] and r.count() == 0 and not r.complete


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "\n", "ab\n", "", "xa"]), max_size=14), st.lists(st.sampled_from(["a", "é", "\n", "ab\n", "", "xa"]), max_size=14))
def test_ranges_and_occurrences_by_plain_loops(old, new):
    a, b = "".join(old), "".join(new)
    lines = sc.changed_ranges(a, b)[1]
    start, end = ch.byte_ranges(lines, b)
    pieces, at, want = sc.split_lines(b), 0, []
    for n, line in enumerate(pieces, 1):
        size = len(line.encode())
        if any(x <= n <= y for x, y in lines):
            want += range(at, at + size)
        at += size
    assert [k for x, y in zip(start, end, strict=True) for k in range(x, y)] == want
    raw = b.encode()
    places = [k for k in range(len(raw)) if raw[k : k + 1] == b"a"]
    got = ch.hits(b, places, [k + 1 for k in places], start, end)
    assert [h["byte_start"] for h in got] == [k for k in places if k in want]
    assert all(h["line"] == pieces[h["line_no"] - 1].removesuffix("\n") and "a" in h["line"] for h in got)
    empty = np.arange(len(raw) + 1)
    held = ch.inside(empty, empty, start, end, len(raw), not b.endswith("\n"))
    assert [k for k in empty if held[k]] == [k for k in empty if k in want or (k == len(raw) and len(raw) - 1 in want and not b.endswith("\n"))]


M = 1_000_000


@pytest.mark.parametrize(
    ("scan", "text"),
    [(sc.redacted, x * (M // len(x))) for x in ("password_", 'password="', "-----BEGIN PRIVATE KEY-----", "a:", "sk-", "token='", "api_key_9_", "a_", "token = a.", "-", " ")]
    + [(sc.roles, x * (M // len(x))) for x in ("import a\n", "from a\n", "from (a,\n", "import \\\n")]
    + [(sc.outline, "".join(" " * i + f"def f{i}():\n" for i in range(1400))), (sc.outline, "def f(x):\n pass\n" * (M // 17))],
)
def test_a_megabyte_of_the_worst_text(scan, text):
    began = time.process_time()
    scan(text)
    assert time.process_time() - began < 6  # some tenths to two seconds on a free machine


def test_hits_of_one_long_line(spark):
    """A line with very many occurrences isn't repeated with each of them."""
    text = "er" * 20_000
    rows = spark.createDataFrame([(text,)], "text string")
    found = tx.occurrences(F.col("text"), tx.escaped("er"))
    bare = ch.with_hits(rows, found, ranged=False).select(F.inline("hits"))
    assert bare.columns == ["byte_start", "byte_end", "line_no"] and bare.count() == 20_000
    shown = ch.with_hits(rows, found, ranged=False, characters=500).select(F.inline("hits")).agg(F.count("*"), F.max(F.length("line")), F.min("line_no")).first()
    assert tuple(shown) == (20_000, 500, 1)


def moved_block(spark):
    """Two versions of a source of 5,500 lines, of which the first 2,500 move to its end: some twelve million steps of the greedy search."""
    head, rest = [f"her line {i}\n" for i in range(2500)], [f"another line {i}\n" for i in range(3000)]
    version = lambda lines: spark.createDataFrame([("big.txt", "".join(lines)), ("small.txt", "er\n" + lines[0])], "path string, text string").withColumn("content_hash", F.sha2("text", 256))
    return version(head + rest), version(rest + head)


def test_changed_lines_of_much_work_are_found(spark, monkeypatch):
    versions = moved_block(spark)
    monkeypatch.setattr(scanned.co, "two_versions", lambda *_: versions)
    for name, first in (("changed_line_occurrences_old", 1), ("changed_line_occurrences", 3001)):
        got = sorted((r.path, r.line_no) for r in scanned.QUERIES[name](spark, "").collect())
        assert got == [("big.txt", first + i) for i in range(2500)] + [("small.txt", 2)], name
    assert {tuple(r) for r in scanned.QUERIES["changed_line_ranges"](spark, "").collect()} == {("big.txt", "1-2500", "3001-5500"), ("small.txt", "2-2", "2-2")}


def test_unknown_changed_lines_are_no_result(spark):
    base, target = moved_block(spark)
    rows = ch.changed_sources(base, target).filter("path = 'big.txt'").withColumn("text", F.col("old"))
    rows = rows.withColumn("ranges", ch.changed_ranges(F.col("old"), F.col("new"), "old", sc.MYERS_WORK))
    with pytest.raises(Exception, match="changed lines of a source with occurrences are unknown"):
        ch.with_hits(rows, tx.occurrences(F.col("text"), "er"), ranged=True).select(F.inline("hits")).count()
    assert ch.with_hits(rows, tx.occurrences(F.col("text"), "no such"), ranged=True).select(F.inline("hits")).count() == 0
