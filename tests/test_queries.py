import pytest

from lonja import queries as core
from lonja import reference
from tests.oracle import compare

SQL = {**reference.SQL, **core.SQL}
QUERIES = {**reference.QUERIES, **core.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, root, name):
    compare(QUERIES[name](spark, root), SQL[name], root)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"ml_evaluacion"}))
def test_query_without_sql_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    assert len(df.take(1)) == 1 and len(set(df.columns)) == len(df.columns)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["entidad", "dia"]
