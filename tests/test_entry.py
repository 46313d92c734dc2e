import __spark_entry__


def test_entry_runs_and_sql_belongs_to_queries(spark, small):
    from siteledger.plans import oracle, queries

    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_pruning_reaches_the_scan(spark, small):
    from siteledger.plans import queries

    plan = queries.content_declining(spark, small)._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "event_id" not in scan
