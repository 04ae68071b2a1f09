"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import difference, oracle_connection

import __spark_entry__ as entry_module
import catalog.registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.registry.QUERIES, catalog.registry.ORACLES
# Results of fitted models and random draws: no SQL equivalent.
FITTED = {"fit_reducer", "reduce_corpus"}


@pytest.fixture(scope="module")
def oracle():
    con = oracle_connection(SF)
    yield con
    con.close()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["shard", "row_index", "caption"] and df.count() > 0


def test_the_entry_lists_the_catalogue():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())


def test_only_fitted_models_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == FITTED
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert slow not in plan
    assert difference(df.toPandas(), oracle.sql(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(FITTED))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
