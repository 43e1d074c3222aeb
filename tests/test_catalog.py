import pytest

from spanforge.plans import catalog

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert name in catalog.oracle_sql()
    same(df, con, catalog.oracle_sql()[name])


def test_filters_reach_the_scan(spark, sf_dir):
    df = catalog.queries()["where_predicate"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan
    assert "Exchange" not in plan


def test_top_k_does_not_sort_everything(spark, sf_dir):
    plan = catalog.queries()["facts_demo_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
