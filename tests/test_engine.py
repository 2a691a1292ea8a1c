import pytest
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.request import Cursor, RequestError, normalized, parse_cursor, validated

FILES = [
    ("src/auth.py", "import os\nclass Auth:\n    def login(self, token):\n        return check(token)\n"),
    ("src/util.py", "def check(value):\n    return value == 'secret'\n"),
    ("docs/guide.md", "The token is kept.\nTokens expire.\n" * 80),
    (".cache/x", "token token"),
]


@pytest.fixture(scope="module")
def engine(spark):
    src = spark.createDataFrame(FILES, "path string, text string")
    hashed = src.withColumn("content_hash", F.sha2("text", 256))
    changed = hashed.filter("path != 'src/util.py'").withColumn("text", F.when(F.col("path") == "src/auth.py", F.concat("text", F.lit("x = 1\n"))).otherwise(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    vectors = spark.createDataFrame([("src/auth.py", 1, "auth login", [1.0, 0.0]), ("docs/guide.md", 1, "guide", [0.0, 1.0])], "path string, line_no int, text string, embedding array<float>")
    records = spark.createDataFrame([("1", "r1", "A title", "token body"), ("2", "r1", "Other", "nothing")], "id string, revision string, title string, content string")
    return Engine(spark, src, versions={"base": hashed, "head": changed, "saved": hashed, "current": changed}, embedder=lambda q: [1.0, 0.0], vectors=vectors, records=records)


def test_matches_and_pages(engine):
    r = engine.search({"pattern": "token", "literal": True, "ignoreCase": True, "mode": "matches"})
    assert r.count() == 163 and r.complete
    rows, cursor = r.page()
    more, end = engine.next_page(cursor)
    assert len(rows) + len(more) == 163 and end is None
    assert len({(x["path"], x["line_no"]) for x in rows + more}) == 163


def test_auto_takes_a_summary_when_a_page_is_too_small(engine):
    assert engine.search({"pattern": "token", "literal": True}).kind == "summary"
    assert engine.search({"pattern": "login", "literal": True}).kind == "matches"


def test_scope_expansion_is_said(engine):
    r = engine.search({"pattern": "login", "literal": True, "path": "docs", "mode": "matches"})
    assert r.count() == 1 and "whole corpus" in r.notes[0]
    assert engine.search({"pattern": "login", "literal": True, "path": "docs", "scope": "strict", "mode": "matches"}).count() == 0


def test_terms(engine):
    r = engine.search({"anyOf": ["token", "oken", "zzz"]})
    by = {x.term: x["count"] for x in r.evidence.groupBy("term").count().collect()}
    single = {t: engine.search({"anyOf": [t]}).count() for t in ("token", "oken", "zzz")}
    assert by == {k: v for k, v in single.items() if v} and single["zzz"] == 0
    assert {x.path for x in engine.search({"allOf": ["token", "check"]}).evidence.collect()} == {"src/auth.py"}
    assert [x.label for x in engine.search({"allOf": ["token", "check"], "allOfScope": "function"}).evidence.collect()] == ["login"]


def test_other_modes(engine):
    assert {x.change for x in engine.search({"changes": {"base": "base", "target": "head"}}).evidence.collect()} == {"removed", "modified"}
    lines = engine.search({"changes": {"base": "base", "target": "head", "scope": "lines"}}).evidence.collect()
    assert [(x.path, x.ranges.new) for x in lines] == [("src/auth.py", "5-5")]
    assert {x.path: x.status for x in engine.search({"mode": "validate"}).evidence.collect()} == {"src/auth.py": "stale", "src/util.py": "unknown", "docs/guide.md": "current", ".cache/x": "current"}
    assert engine.search({"mode": "files", "query": "auth"}).page()[0][0]["path"] == "src/auth.py"
    audit = {x.pattern: x.status for x in engine.search({"mode": "audit", "patterns": ["token", "nowhere"]}).evidence.collect()}
    assert audit == {"token": "present", "nowhere": "absent_with_complete_coverage"}
    assert engine.search({"mode": "concept", "query": "q"}).page()[0][0]["path"] == "src/auth.py"
    hybrid = engine.search({"mode": "hybrid", "query": "login"}).page()[0]
    assert hybrid[0]["tier"] == 0 and hybrid[-1]["tier"] == 1
    assert engine.search({"mode": "hybrid", "query": "auth guide", "ranking": "relevance"}).count() == 2
    assert [x["name"] for x in engine.search({"mode": "outline", "path": "src/auth.py"}).page()[0]] == ["Auth", "login"]
    assert engine.search({"mode": "inspect", "path": "src/util.py", "line": 1}).count() == 2
    assert engine.search({"mode": "source-search", "query": "token"}).count() == 1
    assert engine.search({"mode": "source-read", "recordId": "1", "revision": "r0"}).page()[0] == [{"id": "1", "status": "stale", "content": None}]
    assert engine.search({"mode": "capabilities"}).count() == 3
    with pytest.raises(RequestError) as e:
        engine.search({"mode": "structure", "pattern": "$A"})
    assert e.value.code == "E_STRUCTURE_SOURCES"


def test_redaction_is_last_and_changes_no_counts(engine):
    r = engine.search({"pattern": "secret", "literal": True, "mode": "matches"})
    assert r.count() == 1 and len(r.page()[0]) == 1


@pytest.mark.parametrize(
    ("request_", "code"),
    [
        ({"mode": "nope"}, "E_MODE_UNKNOWN"),
        ({"mode": "files", "pattern": "x"}, "E_FIELD_UNKNOWN"),
        ({"mode": "audit"}, "E_FIELD_MISSING"),
        ({}, "E_FIELD_MISSING"),
        ({"pattern": "a", "anyOf": ["b"]}, "E_FIELD_CONFLICT"),
        ({"pattern": "a", "context": 21}, "E_RANGE"),
        ({"anyOf": ["a"] * 65}, "E_RANGE"),
        ({"anyOf": ["a\nb"]}, "E_TERM"),
        ({"pattern": "(?=a)"}, "E_REGEX_INVALID"),
        ({"pattern": "(a"}, "E_REGEX_INVALID"),
        ({"pattern": r"(a)\1"}, "E_REGEX_INVALID"),
    ],
)
def test_bad_requests(request_, code):
    with pytest.raises(RequestError) as e:
        validated(request_)
    assert e.value.code == code


def test_aliases_and_cursors():
    assert normalized({"mode": "anyOf", "anyOf": ["a"]})[0] == {"anyOf": ["a"]}
    for n in (0, 35, 36, 12345):
        c = Cursor("id-1", "matches", n)
        assert parse_cursor(str(c)) == c
    with pytest.raises(RequestError):
        parse_cursor("x")
