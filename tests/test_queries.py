"""Every registered query against its SQL twin, on the smallest scale."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from conftest import SMALL
from shelfwise.operators import models
from shelfwise.plans.reports import REPORTS

QUERIES = {k: v for k, v in contract.queries().items() if k in REPORTS}
TWINS = {k: v for k, v in contract.oracle_sql().items() if k in REPORTS}
WITHOUT_TWIN = {"gbt_forecast", "linear_forecast", "train_and_compare"}


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


def test_names_match():
    assert set(QUERIES) - set(TWINS) == WITHOUT_TWIN
    assert set(TWINS) <= set(QUERIES)


def test_models_are_registered_in_full_size(spark):
    """The tests fit small ones (see test_boosting)."""
    size = models.default_candidates()[0].size
    assert (size.trees, size.depth, size.rate, size.rows, size.columns) == (300, 6, 0.05, 0.9, 0.9)
    settings = models.boosted_trees()
    assert (settings.getMaxIter(), settings.getMaxDepth(), settings.getStepSize()) == (300, 6, 0.05)


@pytest.mark.parametrize("key", sorted(TWINS))
def test_same_result(spark, duck, key):
    assert difference(QUERIES[key](spark, SMALL), duck, TWINS[key]) is None


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == [
        "store_id", "recent_average", "forecast_average", "trend_pct", "trend_label", "insight"
    ]
    assert found.count() == 5
