"""Structural patterns: what matches, what doesn't, how it is withheld, and the request."""

import time

import pytest

from corpuslens.engine import Engine
from corpuslens.functions import structure as st
from corpuslens.request import RequestError

CALLS = 'foo(1, bar(2));\nx.foo(3);\n// foo(4)\n"foo(5)";\nfoo()\nif (a === a) { foo(a.b(c), d + 1) }\n'
GO = 'func F(a int) error { return nil }\nfunc G() error {\n\tx := T{1, 2}\n\tif err != nil {\n\t\treturn f("x: %w", err)\n\t}\n\ty := g(a)\n\t*p = 3\n}\n'


def found(pattern, text, path="a.ts"):
    return [text[a:b] for _, a, b, _ in st.structural_matches(st.parts(pattern), path, text)]


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("foo($A)", CALLS, []),
        ("foo( $A,$B ) /* any layout */", CALLS, ["foo(1, bar(2))", "foo(a.b(c), d + 1)"]),
        ("foo($$$ARGS)", CALLS, ["foo(1, bar(2))", "foo()", "foo(a.b(c), d + 1)"]),
        ("$X.foo($A)", CALLS, ["x.foo(3)"]),
        ("$A === $A", CALLS, ["a === a"]),
        ("$A === $A", "a === b", []),
        ("$_ === $_", "a === b", ["a === b"]),
        ("if ($C) { $$$BODY }", CALLS, ["if (a === a) { foo(a.b(c), d + 1) }"]),
        ("f(y) + $A", "f( y /* c */ )\n  + 2 * 3;", ["f( y /* c */ )\n  + 2 * 3"]),
        ("let $A = $B", "let a = b.c(d)[1] ? {x: 1} : y => y + 1;\nq == r", ["let a = b.c(d)[1] ? {x: 1} : y => y + 1"]),
        ("$A = $B", "q == r; z = function (a) { return 1 }", ["z = function (a) { return 1 }"]),
        ("const $A = $$$B;", "const a = 1, b = 2; const c = f(x);", ["const a = 1, b = 2;", "const c = f(x);"]),
        ("$A.push($A)", "a.b.push(a.b); a.push(b); q(a.push(a))", ["a.b.push(a.b)", "a.push(a)"]),
        ("f($$$A, $$$A)", "f(1, 2, 1, 2); f(1, 2)", ["f(1, 2, 1, 2)"]),
        ("new $C($$$)", "x = new A.B(1, 2); new C", ["new A.B(1, 2)"]),
        ("f($A)", "", []),
        ("f(😀, $A)", "f(😀, b)", ["f(😀, b)"]),
    ],
)
def test_scripts(pattern, text, want):
    assert found(pattern, text) == want


def test_go_ends_expressions_at_lines():
    assert found("func $F($$$P) error { $$$BODY }", GO, "m.go") == [GO.split("\n")[0], GO[GO.index("func G") :].rstrip("\n")]
    assert found("$A := $B", GO, "m.go") == ["x := T{1, 2}", "y := g(a)"]
    assert found("if err != nil { return $E }", GO, "m.go") == ['if err != nil {\n\t\treturn f("x: %w", err)\n\t}']


def test_withheld_and_other_languages():
    f = st.parts("f($A)")
    assert st.structural_matches(f, "a.js", "f(1") == [(None, None, None, "unbalanced")]
    assert st.structural_matches(f, "a.py", "f(1)") == st.structural_matches(f, "", "f(1)") == []
    assert st.structural_matches(st.parts("$A = $B"), "a.js", "a+" * 20_000 + "b") == [(None, None, None, "work limit")]


@pytest.mark.parametrize("pattern", ["", " ", "$$$A", "x" * 5000, "\ud800", "// c"])
def test_what_is_no_pattern(pattern):
    with pytest.raises(ValueError):
        st.parts(pattern)


@pytest.mark.parametrize(("pattern", "text"), [("$A($B)", "(" * 20_000 + ")" * 20_000), ("f($$$A, $B)", "f(" + "a," * 20_000 + "a)"), ("f(" * 900 + ")" * 900, "f(" * 900 + ")" * 900), ("$A.x($A)", "a." * 20_000 + "x(1)")])
def test_deep_and_long_sources(pattern, text):
    began = time.time()
    st.structural_matches(st.parts(pattern), "a.js", text)
    assert time.time() - began < 20


def test_request(spark):
    sources = spark.createDataFrame([("a.ts", "f(1);\n  f(g(2), 3)"), ("b/b.GO", "f(x)"), ("c.py", "f(9)"), ("d.js", "f(((")], "path string, text string")
    engine = Engine(spark, sources)
    rows, _ = engine.search({"mode": "structure", "pattern": "f($$$A)"}).page()
    assert [(r["path"], r["line_no"], r["excerpt"], r["status"]) for r in rows] == [("a.ts", 1, "f(1)", "ok"), ("a.ts", 2, "f(g(2), 3)", "ok"), ("b/b.GO", 1, "f(x)", "ok"), ("d.js", None, None, "unbalanced")]
    assert engine.search({"mode": "structure", "pattern": "f($A)", "path": "b"}).count() == 1
    assert Engine(spark, sources.limit(0)).search({"mode": "structure", "pattern": "f($A)"}).count() == 0
    for request, code in (({"pattern": "$$$"}, "E_STRUCTURE_PATTERN"), ({"pattern": "f", "path": "c.py"}, "E_STRUCTURE_SOURCES")):
        with pytest.raises(RequestError) as e:
            engine.search({"mode": "structure", **request})
        assert e.value.code == code
