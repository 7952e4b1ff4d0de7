import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_texture_query_has_sql():
    from blockloom.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) and set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
