"""Revisions of one second: the columns that order revisions decide, as the SQL states."""

import datetime as dt
import os

import oracle
import pytest
from test_queries import SF

from millrace.queries import ORACLE, QUERIES

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, " \
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The given tables with order lines whose revisions share their second; text order and number order differ."""
    folder = tmp_path_factory.mktemp("tied")
    for name in oracle.TABLES:
        if name != "lineitem":
            os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    keys = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus = 'P'").orderBy("o_orderkey").limit(2).collect()]
    at = dt.datetime(1998, 7, 2)
    lines = [(key, part, supplier, 1, 3.0, 50.25, 0.05, 0.04, "R", "F", at) for key in keys for part, supplier in [(9, 701), (13, 576), (8, 8)]]
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = oracle.duckdb.connect()
    for name in oracle.TABLES:
        files = f"{folder}/lineitem.parquet/*.parquet" if name == "lineitem" else f"{folder}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{files}')")
    return str(folder), con


@pytest.mark.parametrize("name", ["fact_refund_two_lookups", "fact_refund_pay_composite"])
def test_the_last_revision_of_a_second(spark, tied, name):
    folder, con = tied
    problems, count = oracle.compare(QUERIES[name](spark, folder), con, ORACLE[name])
    assert not problems and count > 0
