import __spark_entry__


def test_queries_and_sql_agree(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 80


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.schema == __spark_entry__.entry(spark).schema
