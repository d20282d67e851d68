import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["article_id", "heat", "base", "delta"] and got.count() > 0
