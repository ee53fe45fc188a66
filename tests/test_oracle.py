"""Every query with a SQL oracle gives the oracle's rows."""

import pytest

import oracle
from trackspark.plans import catalog
from trackspark.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(spark, duck, name):
    ok, note, _ = oracle.compare(REGISTRY[name], spark, SF, duck)
    assert ok, note


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
