"""Every query of the catalogue operators gives the rows of its SQL, on the smallest tables."""

import pytest
from helpers import SMALL, rows_of
from starweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["pca_align", "pipeline_probabilities", "pipeline_groups"])
def test_queries_without_sql_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry.__doc__
    assert "web_probabilities" in __spark_entry__.queries()
