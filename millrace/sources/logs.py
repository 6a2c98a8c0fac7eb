"""Change logs, routing changes and page logs parsed from text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.columns import from_millis, from_seconds
from millrace.sources.topics import json_topic, parse_json

LATENESS = "3 seconds"


def change_log(raw: DataFrame, keep=(), lateness: str = LATENESS, count=None) -> DataFrame:
    """Row changes with event time ``et``; a stream also gets its watermark here. ``count`` as in ``topics.counted``."""
    return event_seconds(parse_json(raw, schemas.CHANGE_ENVELOPE, keep, count), lateness)


def page_log(raw: DataFrame, keep=(), lateness: str = LATENESS, count=None) -> DataFrame:
    """App log records with event time ``et`` from milliseconds. ``count`` as in ``topics.counted``."""
    rows = parse_json(raw, schemas.APP_LOG, keep, count).withColumn("et", from_millis("ts"))
    return _watermark(rows, lateness)


def event_seconds(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Event time ``et`` from a ``ts`` in seconds."""
    return _watermark(rows.withColumn("et", from_seconds("ts")), lateness)


def _watermark(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.withWatermark("et", lateness) if rows.isStreaming else rows


def order_detail_topic(spark: SparkSession, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Order-line facts as written by their job, with event time."""
    return event_seconds(json_topic(spark, topic, schemas.ORDER_DETAIL, streaming, **options))


def route_changes(raw: DataFrame, sink_type: str | None = None, keep=()) -> DataFrame:
    """Routing changes: the deleted row for op d, else the new one.

    An update that moves a route to another table or type also deletes the old route.
    """
    rows = parse_json(raw, schemas.ROUTE_CHANGE, keep)
    gone = F.struct(F.lit("d").alias("op"), F.col("before").alias("route"))
    new = F.struct(F.col("op"), F.col("after").alias("route"))
    moved = (F.col("op") == "u") & (
        ~F.col("before.source_table").eqNullSafe(F.col("after.source_table"))
        | ~F.col("before.source_type").eqNullSafe(F.col("after.source_type"))
    ) & F.col("before").isNotNull()
    steps = (F.when(F.col("op") == "d", F.array(gone))
             .when(moved, F.array(gone, new))
             .otherwise(F.array(new)))
    changes = (rows.select(*keep, "ts_ms", F.explode(steps).alias("_step"))
               .select(*keep, "ts_ms", "_step.op", "_step.route.*"))
    return changes if sink_type is None else changes.where(F.col("sink_type") == sink_type)
