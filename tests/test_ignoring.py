"""Ignore rules: examples, a brute-force walk over random trees, and what the engine shows of them."""

import random

import pytest

from corpuslens.engine import Engine
from corpuslens.operators import ignoring as ig


@pytest.mark.parametrize(
    ("rules", "path", "left_out"),
    [
        ("*.log", "a/b.log", True), ("*.log\n!b.log", "a/b.log", False), ("!b.log\n*.log", "a/b.log", True), ("/b.log", "a/b.log", False), ("/b.log", "b.log", True),
        ("a/b.log", "x/a/b.log", False), ("a/", "a/b.log", True), ("a/", "x/a", False), ("a/\n!a/b.log", "a/b.log", True), ("a/*\n!a/b.log", "a/b.log", False),
        ("**/c", "a/b/c", True), ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("a/**", "a/x/y", True), ("a/**", "a", False), ("# x\n\n", "# x", False), ("\\#x", "#x", True),
        ("\\!x", "!x", True), ("x  ", "x", True), ("x\\ ", "x ", True), ("[ab].t", "a.t", True), ("[!ab].t", "a.t", False), ("[!ab].t", "c.t", True), ("a?c", "a/c", False),
        ("*", "x/y", True), ("*\n!*/\n!*.py", "x/y.py", False), ("*\n!*/\n!*.py", "x/y.txt", True), ("foo*bar", "foo/bar", False), ("[", "[", False), ("a\r", "a", True),
    ],
)
def test_rules(rules, path, left_out):
    assert (ig.ignored_by(path, [("", ".gitignore", rules)]) is not None) == left_out


def test_kinds_and_depth():
    deep = [("", ".gitignore", "*.txt"), ("a", ".gitignore", "!*.txt")]
    assert ig.ignored_by("a/x.txt", deep) is None and ig.ignored_by("b/x.txt", deep) == ".gitignore:*.txt"
    assert ig.ignored_by("a/x.txt", [*deep, ("", ".ignore", "x.*")]) == ".ignore:x.*"
    assert ig.ignored_by("a/x.txt", [("", ".ignore", "!x.txt"), ("a", ".gitignore", "x.txt")]) is None


def walked(files, texts):
    """By definition: from the root down, each folder with the rules of its folder and those above; nothing below a folder that is left out."""
    out = {}

    def visit(folder, chain):
        chain = chain + [(folder, k, texts[p]) for k in ig.KINDS for p in [f"{folder}/{k}".lstrip("/")] if p in texts]
        prefix = folder + "/" if folder else ""
        below = {f[len(prefix) :] for f in files if f.startswith(prefix)}
        for name in sorted({b.split("/")[0] for b in below}):
            path = prefix + name
            if name in below:
                said = ig.decision(path, False, chain)
                out[path] = bool(said and said[0])
            else:
                said = ig.decision(path, True, chain)
                if said and said[0]:
                    out.update({f: True for f in files if f.startswith(path + "/")})
                else:
                    visit(path, chain)

    visit("", [])
    return out


def test_random_trees(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for tree in range(60):
        folders = [""] + ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(5)]
        files = {f"{rng.choice(folders)}/{rng.choice(['d.py', 'e.log', 'f.txt'])}".lstrip("/") for _ in range(12)}
        texts = {}
        for f in rng.sample(folders, 3):
            lines = [rng.choice(["", "!"]) + rng.choice(["*.py", "*.log", "a/", "/b", "a/*", "c/**", "**/e.log", "b/c/", "*", "f.txt"]) for _ in range(rng.randint(1, 4))]
            texts[f"{f}/{rng.choice(ig.KINDS)}".lstrip("/")] = "\n".join(lines)
        names = files | set(texts)
        top = f"t{tree}"
        rows += [(f"{top}/{n}", texts.get(n, "x")) for n in names]
        want |= {f"{top}/{n}": v for n, v in walked(names, texts).items()}
    got = {r.path: r.ignored_by is not None for r in ig.with_rule(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want and 100 < sum(want.values()) < len(want) - 100


def test_engine_shows_what_was_left_out(spark):
    files = [(".gitignore", "build/\n*.log\n"), ("a.log", "needle"), ("build/x.txt", "needle"), ("src/a.txt", "needle"), ("src/.gitignore", "!keep.log\n"), ("src/keep.log", "needle")]
    e = Engine(spark, spark.createDataFrame(files, "path string, text string"))
    r = e.search({"mode": "matches", "pattern": "needle"})
    assert sorted(x.path for x in r.evidence.collect()) == ["src/a.txt", "src/keep.log"] and r.coverage["ignored"] == "policy-filtered"
    assert any("2 sources" in n and "a.log (.gitignore:*.log)" in n for n in r.notes)
    r = e.search({"mode": "matches", "pattern": "needle", "ignorePolicy": "include"})
    assert r.count() == 4 and "ignored" not in r.coverage
    assert sorted(x.path for x in e.ignored({}).collect()) == ["a.log", "build/x.txt"]


def test_none_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("x/.gitignore", None), ("x/b", "t"), (None, "t")], "path string, text string")
    assert [r.ignored_by for r in ig.with_rule(df).collect()] == [None] * 4
    assert ig.with_rule(df.filter("false")).collect() == []
