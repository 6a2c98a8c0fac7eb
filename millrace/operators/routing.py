"""Sending changed rows where a routing table says, with the columns it says."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import keep_columns
from millrace.operators.changelog import latest_by_key, with_op_type
from millrace.session import staged

ROUTE_KEY = ["source_table", "source_type"]
# Fixed value: the source type of a route that takes every kind of change.
EVERY_CHANGE = "ALL"
# Fixed value: the name under which a routed row carries its operation.
OPERATION = "op_type"
# Fixed value: up to this many source tables are named in a filter of the log.
MOST_TABLES = 1000


def live_routes(changes: DataFrame, order=("ts_ms",), preload: DataFrame | None = None) -> DataFrame:
    """The routes in force: last change per (table, type), deletions gone.

    ``preload`` holds routes known at the start; any change of the same key overrides them.
    """
    steps = changes.withColumn("_round", F.lit(1))
    if preload is not None:
        first = preload.withColumn("op", F.lit("r")).withColumn("_round", F.lit(0))
        steps = steps.unionByName(first, allowMissingColumns=True)
    live = latest_by_key(steps, ROUTE_KEY, ["_round", *order], op="op", deleted="d")
    return live.drop("_round", "op", *order)


def route(changes: DataFrame, routes: DataFrame, sink_type: str, by_type: bool = False, stored: bool = False) -> DataFrame:
    """Changes joined with their route: ``op_type``, pruned ``row`` and the sink of each.

    With ``by_type`` a route is found by table and operation, else by table with source type
    ``ALL``. The routes are written out first, so Spark knows how small they are: by its own size
    check it sends them to the log, which is not moved. The tables they name, up to ``MOST_TABLES``, filter the log, so
    changes of others are neither read nor built where the log is stored or put together by ``table``. Routes beyond its threshold meet the log in a shuffle whose busy tables are split.
    ``stored`` tells that the routes are read from files already.
    """
    wanted = (routes if stored else staged(routes, "routes")).where(F.col("sink_type") == sink_type)
    if not by_type:
        wanted = wanted.where(F.col("source_type") == EVERY_CHANGE)
    sinks = wanted.select(
        F.col("source_table").alias("table"), F.col("source_type").alias("op_type"),
        "sink_table", "sink_family", "sink_columns", "sink_row_key",
        F.array_remove(F.split("sink_columns", ","), OPERATION).alias("_kept"),
    )
    on = ["table", "op_type"] if by_type else ["table"]
    sinks = sinks if by_type else sinks.drop("op_type")
    tables = [r["table"] for r in sinks.select("table").distinct().limit(MOST_TABLES + 1).collect()]
    if len(tables) <= MOST_TABLES:
        changes = changes.where(F.col("table").isin(tables))
    joined = with_op_type(changes).join(sinks, on)
    return joined.withColumns({
        "row_key": F.col("data")[F.col("sink_row_key")],
        "row": keep_columns(F.col("data"), F.col("_kept")),
    }).drop("data", "old", "_kept")


def tagged_row(routed: DataFrame) -> DataFrame:
    """The pruned row with its operation as one more entry, ready to be written as JSON."""
    return routed.withColumn("row", F.map_concat("row", F.create_map(F.lit(OPERATION), F.col("op_type"))))
