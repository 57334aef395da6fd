"""Every query of the library against its SQL; those without SQL must give rows."""

import pytest

from conftest import DATA, assert_same
from lodestar import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLE_SQL:
        assert_same(df, catalogue.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["recall_1", "recall_3", "recall_10"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
