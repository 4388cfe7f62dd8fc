import __spark_entry__ as entry


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "p1_found" in q and "claim_tiers" in q


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "tier" in df.columns
