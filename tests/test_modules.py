import hashlib

import pytest

from corpuslens.functions import modules as md
from corpuslens.operators import ranking as rk
from corpuslens.sources import embedding as em


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("import a from 'x'", [("import", "x", "default", "a")]),
        ("import a, { b as c, type D, default as e } from \"./y\"", [("import", "./y", "default", "a"), ("import", "./y", "b", "c"), ("import", "./y", "D", "D"), ("import", "./y", "default", "e")]),
        ("import * as n from 'x'\nimport 'side'\nimport type { T } from './t'", [("import", "x", "*", "n"), ("side-effect", "side", "", ""), ("import", "./t", "T", "T")]),
        ("export * from './a'; export * as ns from './b'; export { x as y } from './c'", [("re-export", "./a", "*", "*"), ("re-export", "./b", "*", "ns"), ("re-export", "./c", "x", "y")]),
        ("const z = require('fs'); await import('./lazy'); a.import('no')", [("require", "fs", "", ""), ("dynamic", "./lazy", "", "")]),
        ("export default class K {}\nexport async function* g() {}\nexport const q = 1\nexport default 3\nexport { h }", [("export", "", "K", "default"), ("export", "", "g", "g"), ("export", "", "q", "q"), ("export", "", "default", "default"), ("export", "", "h", "h")]),
        ("// import a from 'x'\n/* import b from 'y' */ 'import c from z'; `import d`", []),
        ("import 'a\\u0062\\x63\\n\\''", [("side-effect", "abc\n'", "", "")]),
        ("import { a", []),
    ],
)
def test_module_facts(text, want):
    assert [f[:4] for f in md.module_facts(text)] == want


def test_declarations():
    text = "class A extends B {\n  constructor(x) { super(x); }\n  async m(a, b = f(1)): Promise<{x: 1}> {\n    if (a) { g(a); }\n  }\n}\nfunction f(x) {\n  const h = (y) => {\n    return y;\n  };\n}\ninterface I {\n  p: string;\n}\nconst one = x => {\n}\n// function no() {}\n"
    assert md.declarations(text, "script") == [("A", "class", 1, 6, ""), ("constructor", "method", 2, 2, "A"), ("m", "method", 3, 5, "A"), ("f", "function", 7, 11, ""), ("h", "function", 8, 10, "f"), ("I", "interface", 12, 14, ""), ("one", "function", 15, 16, "")]
    go = "package p\ntype T struct {\n\tx int\n}\nfunc (t *T) Get(a int) (int, error) {\n\treturn t.x, nil\n}\nfunc Top() {\n}\n"
    assert md.declarations(go, "go") == [("T", "struct", 2, 4, ""), ("Get", "method", 5, 7, ""), ("Top", "function", 8, 9, "")]


def test_tests_are_recognised():
    assert md.test_cases("a.test.js", "describe('d', () => {\n it.skip('x', f)\n test(`y`, f); x.it('no'); it(name) })") == [("describe", "d", 1), ("test", "x", 2), ("test", "y", 3)]
    assert md.test_cases("test_a.py", "def test_one():\n    pass\ndef other(): pass\n") == [("test", "test_one", 1)]
    assert md.test_cases("a_test.go", "func TestX(t *testing.T) {\n}\nfunc helper() {\n}\n") == [("test", "TestX", 1)]


@pytest.mark.parametrize("part", ["{", "function f() {", "import {", "'", "/*", "class A { m(", "export ", "(" * 3 + "=> {", "const a = ("])
def test_any_text_takes_linear_time(part):
    import time

    t = time.time()
    text = part * 3000
    md.module_facts(text), md.declarations(text, "script"), md.lexical_roles(text), md.test_cases("a.ts", text)
    assert time.time() - t < 6


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None], list(map(float, range(101)))])
def test_median(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    real = [v for v in values if v is not None]
    assert rk.median(df, "x").first().median == (statistics.median(real) if real else None)


def test_numbers_and_running_sums_within_groups(spark):
    rows = [(g, i, i % 7) for g in ("a", "b", None) for i in range(50 if g else 3)] + [("big", i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    numbered = rk.numbered_within(df, df.g, ["i"], "n")
    both = rk.numbered_within(numbered, numbered.g, ["i"], "s", "v").collect()
    assert len(both) == len(rows)
    for r in both:
        assert r.n == r.i + 1 and r.s == sum(v for g, i, v in rows if g == r.g and i <= r.i)


def test_embedding_on_executors(spark):
    texts = ["a b", "c", "a b", "", None, " ".join("w" * 300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    def load():
        return str.split, lambda windows: [[float(len(w)), 0.0 if w else 0.0] for w in windows]

    first = em.embedded(df, load)
    got = {r.key: r.embedding for r in first.collect()}
    assert len(got) == 4 and sorted(len(v) for v in got.values()) == [1, 1, 1, 2] and [[1.0, 0.0]] in got.values() and [[0.0, 0.0]] in got.values()

    def none():
        return str.split, lambda windows: 1 / 0

    again = em.embedded(df, none, cache=first)
    assert {r.key: r.embedding for r in again.collect()} == got
    assert [len(w) for w in em.windows(list(range(449)))] == [256, 256, 65] and em.windows([]) == [[]]


def test_assets(tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    good = (3, hashlib.sha256(b"abc").hexdigest())
    assert em.checked_assets(str(tmp_path), {"a": good, "b": good}) == {"a": "ok", "b": "missing"}
    assert em.checked_assets(str(tmp_path), {"a": (4, good[1])}) == {"a": "wrong-size"} and em.checked_assets(str(tmp_path), {"a": (3, "x")}) == {"a": "wrong-hash"}
