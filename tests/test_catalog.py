"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from fieldspark.catalog.compare import canonical, connect, duck_frame

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        theirs, types = duck_frame(con, ORACLE[name])
        assert sorted(mine.columns) == sorted(types)
        assert canonical(mine) == canonical(theirs)
    else:
        assert len(mine)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
