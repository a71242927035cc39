import pytest

from overlook.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, small, duck, same, name):
    same(queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.SQL[name]).df())


def test_rest_run(spark, small):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["rank", "obs_id", "gy", "gx", "score"]
