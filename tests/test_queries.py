"""Every registered query against its SQL statement."""

import os

import pytest

import oracle
from millrace.queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problems, count = oracle.compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert not problems
    assert count > 0 or name in ("join_interval_events", "stream_interval_join")


def test_sum_of_changes_is_the_sum_of_last_values(spark):
    from pyspark.sql import functions as F

    from millrace.operators.changelog import latest_by_key
    from millrace.queries import views as v

    changed = QUERIES["delta_last_value"](spark, SF).agg(F.sum("order_amount")).first()[0]
    last = latest_by_key(v.lines(spark, SF), ["id"], ["ts", "seq"])
    assert changed == last.agg(F.sum(F.col("price") - F.col("activity"))).first()[0]
