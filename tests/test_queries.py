"""Every registered query against its cross-check, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    ok, note = oracle.compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
