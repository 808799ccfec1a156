"""Every query against its SQL, on the smallest tables."""

import pytest
from support import SF, same_rows

from tesselar.catalog import ORACLES, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ours, theirs = same_rows(df, duck, ORACLES[name])
        assert ours == theirs
    else:
        assert df.count() >= 0


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
