"""Dimension maintenance and config-routed facts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.changelog import clean, merge_cells
from millrace.operators.routing import live_routes, route, tagged_row

DIMENSION_KEY = ["sink_table", "row_key"]


def dimension_changes(changes: DataFrame, routes: DataFrame, database: str) -> DataFrame:
    """Changes that belong to a dimension, pruned to its columns."""
    return route(clean(changes, database), routes, "dim")


def dimension_rows(changes: DataFrame, routes: DataFrame, database: str, order=("ts",)) -> DataFrame:
    """Current state of every dimension: (sink_table, row_key, row as a string map)."""
    routed = dimension_changes(changes, routes, database)
    return merge_cells(routed, DIMENSION_KEY, list(order), "op_type", "row")


def dimension(rows: DataFrame, sink_table: str, columns) -> DataFrame:
    """One dimension out of all of them, with typed columns."""
    return rows.where(F.col("sink_table") == sink_table).select(
        *[F.col("row")[c].alias(c) for c in columns])


def routed_facts(changes: DataFrame, routes: DataFrame, database: str) -> DataFrame:
    """Changes routed by table and operation to the topic in ``sink_table``, with ``op_type`` in the row."""
    return tagged_row(route(clean(changes, database), routes, "dwd", by_type=True))


def routes_in_force(changes: DataFrame, preload: DataFrame | None = None) -> DataFrame:
    return live_routes(changes, preload=preload)
