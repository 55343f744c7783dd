import __spark_entry__ as entry


def test_queries_and_twins():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "rank", "flag", "total"] and df.count() > 0
