import __spark_entry__ as contract


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["orden", "categoria", "valor", "total_categorias", "truncado"] and df.count() == 3


def test_every_query_has_an_oracle():
    from suite import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 95
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
