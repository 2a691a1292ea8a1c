"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        return
    r = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


def test_no_python_where_sql_says_it_too():
    """The scanned module alone uses Python functions."""
    from corpuslens.plans import scanned

    assert set(scanned.QUERIES) >= {"changed_line_ranges", "python_outline", "python_roles", "passages_snapped", "redact_full"}
