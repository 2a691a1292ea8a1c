"""Stored results: pages by seeking, cursors after a restart, idle and least recently used results."""

import pytest
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.request import RequestError
from corpuslens.sources import results as rs


def test_pages_seek(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rs, "FILE_ROWS", 20_000)
    n = 1_200_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), (F.col("id") % 3).alias("x"), F.lit("t").alias("text"))
    rs.StoredResult.write(rows, [F.desc("k")], str(tmp_path / "r"), {"kind": "matches"})
    r = rs.StoredResult(spark, str(tmp_path / "r"))
    assert r.count == n and r.about == {"kind": "matches"} and len(r.fences) >= 60
    for offset in (0, 99, 19_990, 1_000_000, n - 5, n, n + 7):
        files = r.files_of(offset, 101)
        assert len(files) <= 2 and sum(f.rows for f in files) <= 40_000
        assert [x.k for x in r.page(offset, 101)] == [n - 1 - k for k in range(offset, min(n, offset + 101))]


def engine(spark, n=450):
    return Engine(spark, spark.createDataFrame([(f"f{i % 9}/{i}.txt", "needle\nneedle\n") for i in range(n // 2)], "path string, text string"))


def test_all_pages_once_and_ties(spark):
    e = engine(spark)
    first = e.search({"mode": "matches", "pattern": "needle"})
    first.order = ["path"]  # the two lines of a file tie
    rows, cursor = first.page()
    seen, pages = [(r["path"], r["line_no"]) for r in rows], 1
    while cursor:
        rows, cursor = e.next_page(cursor)
        seen, pages = seen + [(r["path"], r["line_no"]) for r in rows], pages + 1
    assert pages == 5 and len(seen) == len(set(seen)) == 450 and [p for p, _ in seen] == sorted(p for p, _ in seen)


def test_cursors_outlive_the_engine(spark):
    e = engine(spark)
    _, cursor = e.search({"mode": "matches", "pattern": "needle"}).page()
    second, third = e.next_page(cursor)
    other = engine(spark)
    assert other.next_page(cursor) == (second, third)
    again = other.search({"cursor": third})
    assert again.page()[0] == e.next_page(third)[0] and again.coverage == {"filesystem": "complete"} and again.count() == 450
    for gone in (cursor.replace(cursor.split(".")[0], "0" * 32), cursor.replace(cursor.split(".")[0], "../../x")):
        with pytest.raises(RequestError) as x:
            engine(spark).next_page(gone)
        assert x.value.code in ("E_CURSOR_NOT_FOUND", "E_CURSOR_MALFORMED")


def test_idle_and_least_recently_used(spark):
    now = [0.0]
    store = rs.ResultStore(spark, most=2, idle=100, clock=lambda: now[0])
    rows = spark.range(3)
    for id_ in "abc":
        store.put(f"{id_}-{id(store)}", rows, ["id"], {})
        now[0] += 1
        if id_ == "b":
            store.get(f"a-{id(store)}")
    assert [k[0] for k in store.used] == ["a", "c"] and store.get(f"b-{id(store)}") is None
    now[0] += 200
    assert store.get(f"a-{id(store)}") is None and not store.used


def test_empty_and_maps(spark):
    store = rs.ResultStore(spark)
    df = spark.sql("SELECT 1 AS a, map('x', 2) AS m, named_struct('y', array(3)) AS s")
    assert store.put("maps", df, ["a"], {}).page(0, 5) == df.collect()
    empty = store.put("empty", df.filter("false"), ["a"], {})
    assert empty.count == 0 and empty.page(0, 5) == [] and empty.all().count() == 0


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark):
    from corpuslens.sources.shared import on_cluster

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        on_cluster(spark)  # the tests' warehouse is a file: folder
