import difflib
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import scanners as sc
from corpuslens.functions import text as tx
from corpuslens.operators import changes as ch
from corpuslens.operators import intervals as iv
from corpuslens.operators import ranking as rk
from corpuslens.sources import corpus as co


def test_occurrences_of_odd_texts(spark):
    rows = [("é日本, x 😀 x", "x"), ("aaaa", "aa"), ("", "a"), ("a\r\nb\na", "a"), ("😀a😀a", "a"), ("E.*E", ".*"), ("\\E\\E", "\\E")]
    for text, literal in rows:
        got = spark.createDataFrame([(text,)], "text string").select(F.inline(tx.occurrences(F.col("text"), tx.escaped(literal)))).collect()
        raw, want, at = text.encode(), [], 0
        while (at := raw.find(literal.encode(), at)) >= 0:
            want.append((at, at + len(literal.encode())))
            at += len(literal.encode())
        assert [tuple(r) for r in got] == want


def test_many_occurrences_in_one_text(spark):
    n = spark.createDataFrame([("ab" * 20_000,)], "text string").select(F.inline(tx.occurrences(F.col("text"), "a"))).agg(F.count("*"), F.max("byte_start")).first()
    assert tuple(n) == (20_000, 39_998)


@pytest.mark.parametrize("ending", ["\n", "\r\n", ""])
def test_lines_with_unicode_and_any_ending(spark, ending):
    text = f"一行{ending or ' '}\n二😀, x{ending}"
    rows = co.lines(spark.createDataFrame([("p", text)], "path string, text string")).orderBy("line_no").collect()
    want, at = [], 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        want.append((line, at))
        at += len(line.encode()) + 1
    assert [(r.line, r.byte_start) for r in rows] == want


def test_case_and_word_policies(spark):
    df = spark.createDataFrame([(x,) for x in ("The end", "the", "ÉTÉ", "été", "bathe", "the_x", "a the-b", "foo\r", "K")], "line string")
    hit = lambda **k: {r.line for r in df.filter(tx.line_matches(F.col("line"), **k)).collect()}
    assert hit(pattern="the", literal=True, ignore_case=None) >= {"The end", "the", "bathe"}
    assert hit(pattern="The", literal=True, ignore_case=None) == {"The end"}
    assert hit(pattern="été", literal=True, ignore_case=True) == {"ÉTÉ", "été"}
    assert hit(pattern="the", literal=True, whole_word=True) == {"the", "a the-b"}
    assert hit(pattern=r"foo$") == set() and hit(pattern="foo\\r$") == {"foo\r"}
    assert not tx.has_upper_literal(r"\S\pL\p{Lu}x") and tx.has_upper_literal(r"\SX")


def test_excerpts(spark):
    df = spark.createDataFrame([("a" * 300 + "FOCUS" + "b" * 700, 300, 305), ("short", 0, 2), ("x" * 600, 0, 0), ("y" * 600, 599, 600), ("z" * 900, 100, 800)], "t string, a int, b int")
    out = [r[0] for r in df.select(tx.excerpt(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert out[0].startswith("…") and "FOCUS" in out[0] and len(out[0]) == 502
    assert out[1] == "short" and out[2] == "x" * 500 + "…" and out[3] == "…" + "y" * 500 and len(out[4]) == 502


def test_paths_and_globs(spark):
    df = spark.createDataFrame([("a/b/c.TXT",), (".hidden",), ("x/.git/y",), ("src/a.test.ts",), ("README",)], "path string")
    got = {r[0]: tuple(r[1:]) for r in df.select("path", tx.extension(F.col("path")), tx.directory(F.col("path")), tx.in_git(F.col("path")), tx.is_hidden(F.col("path"))).collect()}
    assert got["a/b/c.TXT"] == (".txt", "a/b", False, False) and got[".hidden"] == ("", ".", False, True) and got["x/.git/y"][2]
    admitted = lambda inc, exc: {r.path for r in df.filter(tx.globs_admit(F.col("path"), inc, exc)).collect()}
    assert admitted(["*.ts"], []) == {"src/a.test.ts"} and admitted([], ["*.ts", "!*.test.ts"]) == {"a/b/c.TXT", ".hidden", "x/.git/y", "README"}
    assert admitted(["src/**"], ["*.test.*"]) == set() and admitted(["{README,*.TXT}"], []) == {"README", "a/b/c.TXT"}


def test_file_scores(spark):
    df = spark.createDataFrame([("src/Auth.ts",), ("src/auth/x.ts",), ("a/u/t/h",), ("lib/myauth.js",), ("zzz",)], "path string")
    assert {r[0]: r[1] for r in df.select("path", tx.file_score(F.col("path"), "auth")).collect()} == {"src/Auth.ts": 95, "src/auth/x.ts": 70, "a/u/t/h": 23, "lib/myauth.js": 85, "zzz": None}
    assert {r[1] for r in df.select("path", tx.file_score(F.col("path"), "src ts")).collect()} == {60, None}


def test_greedy_choice_is_sequential(spark):
    df = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate([(0, 10), (8, 18), (16, 26), (30, 40)])], "path string, rank long, start long, end long")
    assert {r["rank"] for r in iv.kept_greedily(df, "path", "rank").collect()} == {0, 2, 3}


def test_interval_algebra_by_points(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), s := rng.randint(0, 60), s + rng.randint(1, 15)) for _ in range(n)]
    a, b = make(12), make(9)
    frame = lambda rows: spark.createDataFrame(rows, "k string, start long, end long")
    points = lambda rows: {(k, x) for k, s, e in rows for x in range(s, e)}
    took = lambda df: [(r.k, r.start, r.end) for r in df.collect()]
    ma, mb = iv.merged(frame(a), "k"), iv.merged(frame(b), "k")
    assert points(took(ma)) == points(a) and len(took(ma)) == len({(k, x) for k, x in points(a) if (k, x - 1) not in points(a)})
    assert points(took(iv.intersected(ma, mb, "k", cell=7))) == points(a) & points(b)
    assert points(took(iv.subtracted(ma, mb, "k"))) == points(a) - points(b)
    inside = took(iv.contained(frame(a), frame(b), "k", cell=5))
    assert sorted(inside) == sorted(x for x in a if any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in b))
    free = took(iv.without_overlap(frame(a), frame(b), "k", cell=5))
    assert sorted(free) == sorted(x for x in a if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b))


def test_ranks_without_one_big_task(spark):
    df = spark.range(1000).select(F.hash("id").alias("x"), "id").repartition(7)
    out = {r.id: r.rank for r in rk.ranked(df, ["x", "id"], "rank").collect()}
    want = sorted((r.x, r.id) for r in df.collect())
    assert out == {i: k for k, (_, i) in enumerate(want, 1)}


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([("a", "cat cat dog"), ("b", "dog"), ("c", "bird bird")], "path string, text string")
    got = {r.path: r.bm25 for r in rk.bm25(docs, ["cat"]).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got["a"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))) and got["b"] == got["c"] == 0


@pytest.mark.parametrize("seed", range(30))
def test_line_ranges_make_a_shortest_script(seed):
    rng = random.Random(seed)
    old = [rng.choice("abcd\r") + "\n" for _ in range(rng.randint(0, 14))]
    new = [x for x in old if rng.random() < 0.7]
    for _ in range(rng.randint(0, 5)):
        new.insert(rng.randint(0, len(new)), rng.choice("abcdx") + "\n")
    o, n = sc.changed_ranges("".join(old), "".join(new))
    gone, come = {i for a, b in o for i in range(a - 1, b)}, {i for a, b in n for i in range(a - 1, b)}
    assert [x for i, x in enumerate(old) if i not in gone] == [x for i, x in enumerate(new) if i not in come]
    table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert len(gone) + len(come) == len(old) + len(new) - 2 * table[-1][-1]
    assert difflib is not None


def test_line_ranges_stop_at_their_limit():
    with pytest.raises(sc.WorkLimit):
        sc.changed_ranges("\n".join(map(str, range(900))), "\n".join(map(str, range(1000, 1900))), work=5_000)


@pytest.mark.parametrize("kept", [2, 3, 128])
def test_the_script_by_bits_is_the_greedy_one(monkeypatch, kept):
    monkeypatch.setattr(sc, "KEPT_ROWS", kept)
    rng = random.Random(kept)
    for _ in range(1000):
        k = rng.choice((2, 4, 20))
        x = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        y = [rng.choice((t, t, t, rng.randrange(k + 3))) for t in x if rng.random() < 0.8] if rng.random() < 0.5 else [rng.randrange(k + 3) for _ in range(rng.randint(0, 30))]
        want = sc.edits(x, y, 1_000_000)
        assert sc.edits_by_bits(x, y) == want
        for steps in (-100, 1_000_000):  # by bits, by the greedy search
            monkeypatch.setattr(sc, "GREEDY_WORK", steps)
            assert sc.unlimited_edits(x, y) == want


def test_line_ranges_have_no_limit_by_default():
    head, rest = [f"a{i}\n" for i in range(2500)], [f"b{i}\n" for i in range(3000)]
    old, new = "".join(head + rest), "".join(rest + head)
    with pytest.raises(sc.WorkLimit):
        sc.changed_ranges(old, new, sc.MYERS_WORK)
    assert sc.changed_ranges(old, new) == ([(1, 2500)], [(3001, 5500)])
    assert sc.changed_ranges("a\n" * 9000 + "b\n" * 9000, "c\n" + "b\n" * 9000 + "a\n" * 8000 + "d") == ([(1, 9000)], [(1, 1), (9002, 17002)])
    assert sc.changed_ranges("\n".join(map(str, range(9000))), "\n".join(map(str, range(10_000, 19_000)))) == ([(1, 9000)], [(1, 9000)])


def test_redaction_rule():
    keep = ["token: string", "const password = process.env.get('X')", "api_key = os.environ['K']", "monkey = banana"]
    assert all(sc.redacted(t) == (t, 0) for t in keep)
    assert sc.redacted('DB_PASSWORD="hunter2!" x') == ('DB_PASSWORD="[REDACTED]" x', 1)
    assert sc.redacted("secret: abc, y") == ("secret: [REDACTED], y", 1)
    assert sc.redacted("use ghp_abcdefgh123 now")[1] == 1
    key = "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----"
    assert sc.redacted(key) == ("-----BEGIN RSA PRIVATE KEY-----\n[REDACTED]\n-----END RSA PRIVATE KEY-----", 1)


def test_passages_cover_the_text():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice("ab \n😀" if rng.random() < 0.3 else "abc") for _ in range(rng.randint(0, 4000)))
        p = sc.snapped_passages(text)
        assert p[0][0] == 0 and p[-1][1] == len(text) and all(a[1] >= b[0] > a[0] for a, b in zip(p, p[1:]))
        assert all(len(text[a:b].encode("utf-16-le")) // 2 <= 1001 for a, b in p)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in {"a/x.txt": b"hello\n", "a/bin.dat": b"a\0b", "bad.txt": b"\xff\xfe\x00", "utf.txt": b"\xc3\x28", "blank.txt": b" \n"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path: r.status for r in co.file_sources(spark, str(tmp_path)).collect()}
    assert got == {"a/x.txt": "ok", "a/bin.dat": "binary", "bad.txt": "unavailable", "utf.txt": "unavailable", "blank.txt": "empty"}
    media = spark.createDataFrame([("a.png", 10), ("b.pdf", 30 << 20), ("c.txt", 1), ("d.jpg", 5)], "path string, size long")
    assert {r.path: r.status for r in co.media_inventory(media, most_total=12).collect()} == {"a.png": "admitted", "b.pdf": "too-large", "d.jpg": "total-limit"}


def test_cache(spark):
    cache = spark.sql("SELECT * FROM VALUES ('a', 10, timestamp '2024-01-01 10:00:00'), ('b', 10, timestamp '2024-01-02 10:00:00'), ('c', 10, timestamp '2024-01-02 11:00:00') AS t(key, bytes, mtime)")
    assert {r.key for r in co.evicted(cache, 20).collect()} == {"a"} and {r.key for r in co.evicted(cache, 10).collect()} == {"a", "b"}
    wanted = spark.createDataFrame([("a",), ("z",), ("z",)], "key string")
    assert [r.key for r in co.cache_misses(wanted, cache).collect()] == ["z"]


def test_python_batches_are_bounded(spark):
    """What a worker holds doesn't grow with a task's rows: batches of few rows, and of few bytes if texts are long."""
    kept = {k: spark.conf.get(k) for k in sc.BATCH}
    x = F.col("text")
    columns = [sc.passages, sc.python_outline, sc.python_roles, lambda t: md.own(F.lit("a.py"), t), lambda t: ch.changed_ranges(t, t, "old"), lambda t: sc.changed_line_ranges(t, t)]
    try:
        for make in columns:
            for k in sc.BATCH:
                spark.conf.set(k, "100000000")
            make(x)
            assert {k: int(spark.conf.get(k)) for k in sc.BATCH} == sc.BATCH

        def size(texts: pd.Series) -> pd.Series:
            return pd.Series([len(texts)] * len(texts))

        seen = sc.batched_udf("int")(size)
        rows = spark.range(0, 3000, 1, 1)
        assert rows.select(F.max(seen(F.col("id").cast("string")))).first()[0] == 256
        assert rows.limit(200).select(F.max(seen(F.repeat(F.lit("x"), 1 << 18)))).first()[0] <= 17
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        sc.passages(x)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_calls_inside_of_random_sources():
    """The smallest declaration around each line with a call, against all declarations; long sources in linear time."""
    rng = random.Random(4)
    lines = ["def f():", "class C:", "x = g(1)", "h(i(2), j(3))", "# k(1)", "", "'l(1)'", "m(", ")", "async def n(a=o(1)):", "import p"]
    for _ in range(300):
        text = "\n".join(" " * rng.randint(0, 4) + rng.choice(lines) for _ in range(rng.randint(0, 25)))
        spans, want = sc.outline(text), []
        for n in sorted({text.count("\n", 0, start) + 1 for start, _, role in sc.roles(text) if role == "call"}):
            around = [(b - a, a, name) for name, _, a, b, _ in spans if a <= n <= b]
            want += [(n, min(around)[2])] if around else []
        assert sc.calls_inside(text) == want
    began = time.process_time()
    assert len(sc.calls_inside("def f():\n    return g(1)\n" * 40_000)) == 40_000 and time.process_time() - began < 20
