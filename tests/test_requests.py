"""What each request field does to the engine's answers."""

import pytest
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.request import RequestError, validated

TS = "// License of the file\nimport { check } from './util';\nexport function run(token) {\n  const s = 'License';\n  return check(License(token));\n}\n"
FILES = [
    ("src/run.ts", TS),
    ("src/util.ts", "export const check = (x) => {\n  return x;\n};\n"),
    ("src/a.py", "# License\ndef outer():\n    alpha()\n    def inner():\n        beta()\n    return 1\ndef both():\n    alpha(); beta()\n"),
    ("src/run.test.ts", "import { run } from './run';\ntest('runs', () => { run(); });\n"),
    ("docs/guide.md", "one\ntwo License\nthree\nfour\nfive license\n"),
    ("home/.ssh/id", "License of a key"),
]


@pytest.fixture(scope="module")
def engine(spark):
    src = spark.createDataFrame(FILES, "path string, text string").withColumn("content_hash", F.sha2("text", 256))
    moved = src.withColumn("path", F.when(F.col("path") == "docs/guide.md", "docs/moved.md").otherwise(F.col("path")))
    vectors = spark.createDataFrame(
        [("docs/guide.md", 1, "one\ntwo License", [1.0, 0.0]), ("docs/guide.md", 2, "two License\nthree", [0.99, 0.1]), ("docs/guide.md", 4, "four", [0.9, 0.4]), ("src/run.ts", 5, "x", [0.1, 0.9]), (".h/x", 1, "y", [1.0, 0.0])],
        "path string, line_no int, text string, embedding array<float>",
    )
    return Engine(spark, src, versions={"a": src, "b": moved}, embedder=lambda q: [1.0, 0.0], vectors=vectors)


def found(engine, **request):
    return sorted((r.path, r.line_no) for r in engine.search({"mode": "matches", **request}).evidence.collect())


def test_all_matches_without_protected_paths(engine):
    assert found(engine, pattern="License", literal=True) == [("docs/guide.md", 2), ("src/a.py", 1), ("src/run.ts", 1), ("src/run.ts", 4), ("src/run.ts", 5)]


@pytest.mark.parametrize(
    ("roles", "want"),
    [(["comment"], [("src/a.py", 1), ("src/run.ts", 1)]), (["string"], [("src/run.ts", 4)]), (["call"], [("src/run.ts", 5)]), (["code", "comment"], [("src/a.py", 1), ("src/run.ts", 1), ("src/run.ts", 5)]), (["import"], [])],
)
def test_roles(engine, roles, want):
    assert found(engine, pattern="License", literal=True, roles=roles) == want
    assert engine.search({"mode": "matches", "pattern": "License", "literal": True, "roles": roles}).coverage["parser"] == "partial"


def test_paths(engine):
    assert found(engine, pattern="License", literal=True, paths=["src/a.py"]) == [("src/a.py", 1)]
    none = engine.search({"mode": "matches", "pattern": "License", "literal": True, "paths": ["nowhere.txt"]})
    assert none.count() == 0 and "nowhere.txt" in none.notes[0]


def test_context(engine):
    rows = engine.search({"mode": "matches", "pattern": "License", "literal": True, "path": "docs", "context": 1}).evidence.collect()
    assert [(r.line_no, r.context) for r in rows] == [(2, "one\ntwo License\nthree")]
    rows = engine.search({"mode": "matches", "pattern": "license", "path": "docs", "context": 20}).evidence.collect()
    assert [r.context for r in rows] == [FILES[4][1].rstrip("\n")] * len(rows)


def test_case_and_words_of_terms(engine):
    n = lambda **r: engine.search(r).count()
    assert n(anyOf=["LICENSE"]) == 0 and n(anyOf=["LICENSE"], ignoreCase=True) == 6
    assert n(anyOf=["Licens"], wholeWord=True) == 0 and n(anyOf=["Licens"]) == 5
    assert {r.path for r in engine.search({"allOf": ["LICENSE", "FOUR"], "ignoreCase": True}).evidence.collect()} == {"docs/guide.md"}
    assert n(allOf=["LICENSE", "FOUR"]) == 0 and n(allOf=["Licens", "four"], wholeWord=True) == 0
    counts = {r.term: (r.occurrences, r.files) for r in engine.term_counts({"anyOf": ["LICENSE", "zzz"], "ignoreCase": True}).collect()}
    assert counts == {"LICENSE": (6, 3), "zzz": (0, 0)}
    assert engine.search({"allOf": ["License", "four"]}).evidence.first().occurrences == [1, 1]


def test_own_code_of_functions(engine):
    assert [r.label for r in engine.search({"allOf": ["alpha", "beta"], "allOfScope": "function"}).evidence.collect()] == ["both"]


def test_filters_of_concept_and_hybrid(engine):
    paths = lambda **r: sorted({x.path for x in engine.search(r).evidence.collect()})
    assert paths(mode="concept", query="q") == [".h/x", "docs/guide.md", "src/run.ts"]
    assert paths(mode="concept", query="q", path="docs") == ["docs/guide.md"] == paths(mode="concept", query="q", glob=["*.md"])
    assert paths(mode="concept", query="q", exclude=["docs/"], hidden=False) == ["src/run.ts"]
    rows = engine.search({"mode": "hybrid", "query": "License", "path": "docs", "conceptLimit": 5}).page()[0]
    assert [(r["tier"], r["line_no"]) for r in rows] == [(0, 2), (1, 4)]  # passages with the literal's line are left out
    rows = engine.search({"mode": "hybrid", "query": "License", "path": "docs", "ranking": "relevance"}).evidence.collect()
    assert sorted(r.line_no for r in rows) == [1, 4]  # of overlapping passages the better one


def test_budget_bounds_a_page(engine):
    all_, _ = engine.search({"mode": "matches", "pattern": "License", "literal": True}).page()
    some, more = engine.search({"mode": "matches", "pattern": "License", "literal": True, "resultTokenBudget": 40}).page()
    assert 0 < len(some) < len(all_) and more
    assert engine.search({"pattern": "License", "literal": True, "resultTokenBudget": 40}).kind == "summary"


def test_imports_tests_and_renames(engine):
    traces = {(r.start_path, r.start_name): (r.end_path, r.status) for r in engine.search({"mode": "imports"}).evidence.collect()}
    assert traces == {("src/run.ts", "check"): ("src/util.ts", "resolved"), ("src/run.test.ts", "run"): ("src/run.ts", "resolved")}
    tests = {(r.test_path, r.path): (r.relation, [c.name for c in r.cases]) for r in engine.search({"mode": "tests"}).evidence.collect()}
    assert tests == {("src/run.test.ts", "src/run.ts"): ("direct", ["runs"])}  # a plain import of an import is no relation
    assert [r.path for r in engine.search({"mode": "tests", "path": "src/run.ts"}).evidence.collect()] == ["src/run.ts"]
    assert engine.search({"mode": "tests", "path": "src/util.ts"}).count() == 0
    changes = engine.search({"changes": {"base": "a", "target": "b", "renames": True}}).evidence.collect()
    assert [(r.path, r.change, r.old_path, r.similarity) for r in changes] == [("docs/moved.md", "renamed", "docs/guide.md", 100)]
    assert engine.search({"pattern": "License", "literal": True, "path": "docs", "changes": {"base": "a", "target": "b"}}).count() == 1


def test_inspect_targets(engine):
    import hashlib

    have = hashlib.sha256(FILES[4][1].encode()).hexdigest()
    targets = [{"path": "docs/guide.md", "line": 3, "content_hash": have}, {"path": "docs/guide.md", "line": 1, "content_hash": "old"}, {"path": "gone"}]
    r = engine.search({"mode": "inspect", "targets": targets, "context": 1})
    rows = sorted((x.target, x.status, x.line_no or 0) for x in r.evidence.collect())
    assert rows == [(0, "current", 2), (0, "current", 3), (0, "current", 4), (1, "stale", 0), (2, "unknown", 0)] and not r.complete


@pytest.mark.parametrize(
    ("request_", "code"),
    [
        ({"anyOf": ["a"], "roles": ["comment"]}, "E_FIELD_CONFLICT"),
        ({"anyOf": ["a"], "context": 2}, "E_FIELD_CONFLICT"),
        ({"pattern": "a", "roles": ["x"]}, "E_ROLE_UNKNOWN"),
        ({"pattern": "a", "resultTokenBudget": 0}, "E_RANGE"),
        ({"mode": "inspect"}, "E_FIELD_MISSING"),
        ({"mode": "validate", "cursor": "x"}, "E_FIELD_UNKNOWN"),
    ],
)
def test_refused(request_, code):
    with pytest.raises(RequestError) as e:
        validated(request_)
    assert e.value.code == code


def test_validate_without_versions(engine):
    with pytest.raises(RequestError) as e:
        engine.search({"mode": "validate"})
    assert e.value.code == "E_VERSION_UNKNOWN"


def test_cursors_are_checked(engine):
    first = engine.search({"mode": "matches", "pattern": "License", "literal": True, "limit": 2})
    rows, cursor = first.page()
    more = engine.search({"cursor": cursor})
    assert rows + more.page()[0] == first.page(0)[0] + first.page(2)[0] and len(more.page()[0]) == 2
    for bad, code in ((cursor.replace(first.id, "0" * 32), "E_CURSOR_NOT_FOUND"), (cursor.replace("matches", "summary"), "E_CURSOR_MISMATCH"), (cursor.replace(".all", "." + "0" * 16), "E_CURSOR_MISMATCH")):
        with pytest.raises(RequestError) as e:
            engine.search({"cursor": bad})
        assert e.value.code == code


def test_file_queries(engine):
    paths = lambda **r: sorted(x.path for x in engine.search({"mode": "files", **r}).evidence.collect())
    assert paths(query="*.md") == ["docs/guide.md"] and len(paths(query="**")) == 5
    assert "glob" in engine.search({"mode": "files", "query": "*.md"}).notes[0]
    for bad in ({"query": "^a.*b$"}, {"query": "a *"}, {"query": "*.md", "glob": ["docs/**"]}):
        with pytest.raises(RequestError) as e:
            engine.search({"mode": "files", **bad})
        assert e.value.code == "E_QUERY"


def test_records_missing(engine):
    with pytest.raises(RequestError) as e:
        engine.search({"mode": "source-search", "query": "x"})
    assert e.value.code == "E_SOURCES_UNAVAILABLE"


def test_binary_as_text_and_bulk_sink(spark, tmp_path):
    e = Engine(spark, spark.createDataFrame([("a.bin", "x\0License"), ("b.txt", "password = 'hunter2hunter2' License")], "path string, text string"))
    n = lambda **r: e.search({"mode": "audit", "patterns": ["License"], **r}).evidence.first().files
    assert n() == 1 and n(text=True) == 2
    found = e.search({"mode": "matches", "pattern": "License", "literal": True})
    found.save(str(tmp_path / "out"))
    saved = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.asDict() for r in saved] == found.page()[0] and "hunter2" not in str(saved)


def test_byte_pages(spark):
    from corpuslens.functions import text as tx

    texts = ["", "abc", "é" * 9, "a😀" * 7, "漢字" * 5 + "x", None]
    for most in (4, 5, 7):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tx.byte_pages(F.col("text"), most).alias("p"))
        for i, p in df.collect():
            if texts[i] is None:
                assert p is None
                continue
            raw, want, at = texts[i].encode(), [], 0
            while at < len(raw):
                end = min(len(raw), at + most)
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                want.append((at, end))
                at = end
            assert [tuple(x) for x in p] == want


def test_max_files(spark):
    from corpuslens.sources import corpus as co

    src = spark.createDataFrame([(f"f{i}", "x") for i in range(9)], "path string, text string")
    assert [r.path for r in co.enumerated(src, max_files=3).collect()] == ["f0", "f1", "f2"] and co.enumerated(src).count() == 9


def test_relations_by_traced_names_and_text(spark):
    files = [
        ("a.ts", "export const one = 1;\n"), ("b.ts", "export { one } from './a';\n"), ("c.ts", "export { one } from './b';\n"), ("d.ts", "import { one } from './a';\nexport const two = one;\n"),
        ("gone.ts", "export { x } from './missing';\n"), ("far/helper.ts", "export const h = 1;\n"), ("t/helper.test.ts", "// nothing\n"),
        ("c.test.ts", "import { one } from './c';\n// about helper things\ntest('x', () => one);\n"), ("d.test.ts", "import { two } from './d';\n"), ("g.test.ts", "import { x } from './gone';\n"),
    ]
    e = Engine(spark, spark.createDataFrame(files, "path string, text string"))
    got = {(r.test_path, r.path): r.relation for r in e.search({"mode": "tests"}).evidence.collect()}
    strong = {k: v for k, v in got.items() if v != "weak"}
    assert strong == {("c.test.ts", "c.ts"): "direct", ("c.test.ts", "b.ts"): "indirect", ("c.test.ts", "a.ts"): "indirect", ("d.test.ts", "d.ts"): "direct", ("g.test.ts", "gone.ts"): "direct"}
    assert got["c.test.ts", "far/helper.ts"] == "weak" and got["t/helper.test.ts", "far/helper.ts"] == "weak" and ("d.test.ts", "far/helper.ts") not in got


def test_mentions_by_parts(spark):
    from corpuslens.operators import graph as gr

    texts = spark.createDataFrame([("t1", "alpha beta"), ("t2", "gammabeta"), ("t3", None)], "path string, text string")
    stems = spark.createDataFrame([(x,) for x in ("alpha", "beta", "gamma", "delta", "", "a")], "stem string")
    want = {("t1", "alpha"), ("t1", "beta"), ("t1", "a"), ("t2", "gamma"), ("t2", "beta"), ("t2", "a")}
    for most in (1, 2, 100):
        assert {tuple(r) for r in gr.mentioned(texts, stems, most).collect()} == want


def test_summary_parts(spark):
    files = [(f"d{i % 2}/f{i}.txt", "\n".join("needle" if n % (i + 2) == 0 else f"line {n}" for n in range(1, 31))) for i in range(7)]
    e = Engine(spark, spark.createDataFrame(files, "path string, text string"))
    r = e.search({"mode": "summary", "pattern": "needle"})
    counts = {x.path: x.matches for x in r.evidence.collect()}
    stats = {(x.kind, x.key): x.matches for x in r.part("statistics").collect()}
    assert stats["extension", ".txt"] == sum(counts.values()) and stats["directory", "d1"] == sum(v for k, v in counts.items() if k.startswith("d1"))
    windows = sorted((x.path, x.first_line, x.last_line, x.excerpt) for x in r.part("windows").collect())
    assert [w[:3] for w in windows if w[0] == "d0/f0.txt"] == [("d0/f0.txt", 1, 5), ("d0/f0.txt", 7, 13)] and len({w[0] for w in windows}) == 5
    assert all(t.split("\n") == dict(files)[p].split("\n")[a - 1 : b] for p, a, b, t in windows)
    with pytest.raises(RequestError) as x:
        e.search({"mode": "matches", "pattern": "needle"}).part("statistics")
    assert x.value.code == "E_PART_UNKNOWN"


def test_inspect_serves_five_and_names_the_rest(engine):
    targets = [{"path": "docs/guide.md", "line": n} for n in range(1, 6)] + [{"path": "src/a.py", "line": 1}, {"path": "gone"}]
    first = engine.search({"mode": "inspect", "targets": targets, "context": 0})
    assert {x.target for x in first.evidence.collect()} == {0, 1, 2, 3, 4} and len(first.next["targets"]) == 2
    rest = engine.search(first.next)
    assert sorted((x.path, x.status) for x in rest.evidence.collect()) == [("gone", "unknown"), ("src/a.py", "current")] and rest.next is None


def test_audit_is_closed_by_inventories(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([("a.txt", "x"), ("b.txt", "y")], "path string, text string").write.parquet(at)
    e = Engine(spark, spark.read.parquet(at))
    r = e.search({"mode": "audit", "patterns": ["zzz"]})
    assert r.coverage["inventory"] == "complete" and r.evidence.first().status == "absent_with_complete_coverage"
    noise = spark.read.parquet(at).withColumn("text", F.concat("text", F.current_timestamp().cast("string")))  # other contents each time it is read
    r = Engine(spark, noise).search({"mode": "audit", "patterns": ["zzz"]})
    assert r.coverage["inventory"] == "partial" and r.evidence.first().status == "unknown" and "a.txt" in r.notes[0]
