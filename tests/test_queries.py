"""Every registered query against its SQL on the smallest driver tables."""

import os
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_point
from check_queries import connect, key

SF = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, fn in entry_point.queries().items() if name in entry_point.QUERIES}
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def results(spark):
    def collect(name):
        try:
            df = QUERIES[name](spark, SF)
            return df.columns, [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(collect, QUERIES)))


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    got = results[name]
    if isinstance(got, Exception):
        raise got
    columns, rows = got
    cur = duck.execute(SQL[name])
    want_columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(want_columns)
    assert key(rows, columns) == key(cur.fetchall(), want_columns)


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() == 10


def test_stored_bars_are_dealt_once(spark):
    """Lines go to the buckets in one shuffle; nothing is summed before it."""
    from tidegauge.plans.tables import Tables

    for build in (Tables(spark, "/root/testdata/sf0.001")._bars, Tables(spark, "/root/testdata/sf0.001")._raw_bars):
        plan = build()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan.partition("Exchange")[2]
