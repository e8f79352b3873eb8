import os

import pytest

from moraine import plans

from .compare import DATA, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_sql(spark, con, name):
    same(plans.QUERIES[name](spark, DATA), plans.ORACLES[name], con)


def test_keyset_filters_reach_the_scan(spark):
    from moraine.plans.tables import doc_keyset_after

    plan = doc_keyset_after(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,100)" in plan and "EqualTo(event_type,error)" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["sk", "k"]
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_whole_queries_take_every_event(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    n = events.count()
    assert sum(len(r["items"]) for r in plans.QUERIES["group_to_lists_whole"](spark, DATA).collect()) == n
    assert plans.QUERIES["stream_queue_deliver_whole"](spark, DATA).count() == n
    texts = {r.stream_id: r.text for r in plans.QUERIES["stream_consumers_whole"](spark, DATA).collect()}
    assert sum(map(len, texts.values())) == sum(len(r.props or "") for r in events.select("props").collect())
