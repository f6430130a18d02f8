import pytest

from schemaweave.plans import oracles
from schemaweave.plans import queries as registry

from .parity import assert_same, duck

ORACLES = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, smallest, name):
    got = registry.queries()[name](spark, smallest).toPandas()
    if name in ORACLES:
        assert_same(got, duck(smallest, ORACLES[name]))
    else:
        assert len(got)


def test_entry(spark, smallest):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 5
    assert set(e.oracle_sql()) <= set(e.queries())
