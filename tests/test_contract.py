import __spark_entry__ as contract


def test_registry_is_consistent():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert all(callable(query) for query in queries.values())


def test_entry_runs(spark):
    found = contract.entry(spark)
    assert "pmi" in found.columns and found.limit(5).count() == 5
