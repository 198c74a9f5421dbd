"""Each core query with SQL gives the rows of its SQL on the smallest tables."""

import pytest
from lodeweave import payload_queries, queries  # noqa: F401 - the first adds to the second
from oracle import connect, rows


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, small, con, name):
    ours = queries.QUERIES[name](spark, small).toPandas()
    theirs = con.execute(queries.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
