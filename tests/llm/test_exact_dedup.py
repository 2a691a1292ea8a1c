import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import common
from corpuslens.llm import exact_dedup as ed


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5_000, 70_000])
def test_filter_holds_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    f = ed.build_fuse(keys)
    assert ed.may_hold(keys, *f).all()
    others = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert ed.may_hold(others, *f).mean() < (0.01 if n > 3 else 0.6)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return groups


def test_groups_match_brute_force(spark):
    rows = [(i, f"text {i % 40}" + ("  x" if i % 3 else "\tx")) for i in range(200)] + [(500, None), (501, ""), (3, "once"), (700, "a\x0bb"), (701, "a b"), (None, "a b"), (None, "alone"), (9, "rep"), (9, "rep"), (900, "l" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("digest", F.lit(1))
    for snapshot in (F.lit(True), F.lit(False), F.col("doc_id") <= 100):
        out = ed.exact_dedup(df, snapshot).collect()
        assert len(out) == len(rows)
        groups = brute(rows)
        want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == want
        assert sum(r.kept for r in out) == len(groups)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_dedup(df, ed.older_half(df)).collect() == []


def test_keep_rows_keeps_columns_and_one_of_repeated_rows(spark):
    rows = [(1, "a", 5), (1, "a", 5), (2, "a", 6), (3, "b", 7), (None, None, 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Drop_ID int")
    judged = ed.exact_dedup(df, F.lit(False)).select("doc_id", "text_key", "kept")
    out = common.keep_rows(df, judged)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("1", "a"), ("3", "b"), ("None", "")]
