import pytest

import __spark_entry__ as entry
from palimpsest.plans import registry

from .conftest import DATA

SMALL = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, equal, name):
    equal(registry.QUERIES[name](spark, SMALL), duck(registry.ORACLES[name], SMALL))


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
