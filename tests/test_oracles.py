"""Every registered query against its SQL twin at the smallest scale."""

import pytest

from oracles import all_sql
from placelens.plans import all_queries
from tests.oracle_check import ROOT, differences, duck

SF = f"{ROOT}/sf0.001"
ROWS_ONLY = {"fit_ols", "fit_lasso", "fit_ridge", "fit_svr_rff", "cross_validation", "soos_validation",
             "feature_ranking", "feature_sweep", "selection_chain"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin_or_is_listed():
    assert set(all_queries()) - set(all_sql()) == ROWS_ONLY
    assert set(all_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    got = all_queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in all_sql():
        assert differences(got, con.execute(all_sql()[name]).df()) is None


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0 and e.queries().keys() >= e.oracle_sql().keys()
