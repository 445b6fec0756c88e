"""Every registered library query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tallyforge.plans import catalogue
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"
WIDE = "/root/testdata/sf0.01"
THIN = {"gar_value", "replacement_pool", "knn_comps", "knn_term_stats"}  # too few rows on the smallest tables


@pytest.fixture(scope="module")
def con():
    return {sf: duck(sf) for sf in (SF, WIDE)}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    sf = WIDE if name in THIN else SF
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    assert_same(got, con[sf].sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
