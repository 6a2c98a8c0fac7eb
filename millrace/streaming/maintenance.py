"""Jobs that run the table operators on each micro-batch.

What a batch must know of the past comes with it out of the engine's keyed state, or is written down per batch
beside its output. So a retried batch gives the same result, and joins split hot keys as in a table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.changelog import clean
from millrace.operators.enrich import enrich, lookup_as_of
from millrace.operators.logs import repair_visitors, split_log
from millrace.operators.routing import live_routes, route, tagged_row
from millrace.schemas import ROUTE
from millrace.session import made, written
from millrace.streaming.sinks import append_batches, put_cells
from millrace.streaming.stateful import stream_first_visits


def with_visits(log: DataFrame, order=("ts",), seen: DataFrame | None = None) -> DataFrame:
    """A stream of records and, for each of its batches, the first visits of the devices in it, for :func:`split_logs`.

    First visits are keyed state of the engine: no batch reads what earlier ones wrote. ``seen`` is a
    table of first visits to begin with.
    """
    visits = stream_first_visits(log, order, seen)
    first = F.struct("mid", F.struct(*order, "is_new").alias("first")).alias("visit")
    records = log.select(F.struct(*log.columns).alias("record"))
    return records.unionByName(visits.select(first), allowMissingColumns=True)


def split_logs(path: str, order=("ts",)):
    """Repair new-visitor marks of the batches of :func:`with_visits` and write the five parts of the log, each
    below its own folder.

    The batch is read three times and the repaired one feeds five writes, so both are kept for their duration: a batch
    that is not kept runs through the keyed state anew each time it is read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        records = batch.where(F.col("record").isNotNull()).select("record.*")
        visits = batch.where(F.col("visit").isNotNull()).select("visit.*")
        repaired = repair_visitors(records, list(order), visits).persist()
        try:
            for name, part in split_log(repaired).items():
                append_batches(f"{path}/{name}")(part, batch_id)
        finally:
            repaired.unpersist()
            batch.unpersist()

    return write


def log_routes(path: str):
    """Keep a stream of routing changes (see ``sources.logs.route_changes``) for :func:`logged_routes`."""
    return append_batches(path)


def logged_routes(path: str, preload: DataFrame | None = None):
    """A function that reads the routes in force out of the changes logged so far; later batches win within a time."""
    shape = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("op", T.StringType()), *ROUTE.fields,
                          T.StructField("batch_id", T.IntegerType())])

    def read(spark: SparkSession) -> DataFrame:
        return live_routes(spark.read.schema(shape).parquet(made(spark, path)), ["ts_ms", "batch_id"], preload)

    return read


def pinned(spark: SparkSession, routes, path: str, batch_id: int) -> DataFrame:
    """The routes of one batch: those in force when it first ran, written down, so that a retry takes the same."""
    own = f"{path}/batch_id={batch_id}"
    if not written(spark, own):
        routes(spark).select(*ROUTE.fieldNames()).coalesce(1).write.mode("overwrite").parquet(own)
    return spark.read.schema(ROUTE).parquet(own)


def routed_dimensions(changes: DataFrame, routes: DataFrame, database: str, stored: bool = False) -> DataFrame:
    """The puts and deletes of dimensions that changes mean under the routes given."""
    return route(clean(changes, database), routes, "dim", stored=stored).drop("et")


def maintain_dimensions(path: str, routes, database: str):
    """Route each batch to its dimensions and log the puts and deletes.

    ``routes`` is a function that reads the routes in force, called once for every batch; they may change
    while the stream runs. What a batch used is kept beside ``path``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        own = pinned(batch.sparkSession, routes, f"{path}-routes", batch_id)
        put_cells(path)(routed_dimensions(batch, own, database, stored=True), batch_id)

    return write


def route_facts(path: str, routes, database: str):
    """Write each batch to the topics its routes name; ``routes`` as in :func:`maintain_dimensions`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own = pinned(batch.sparkSession, routes, f"{path}-routes", batch_id)
        routed = tagged_row(route(clean(batch, database), own, "dwd", by_type=True, stored=True))
        lines = routed.select("sink_table", F.to_json("row").alias("value"))
        append_batches(path, ["sink_table"], "json")(lines, batch_id)

    return write


def enrich_batches(write, load, steps):
    """Look each batch up in the dimensions as they are at that time, then hand it to ``write``.

    ``load`` reads the dimensions, anew for every batch, and ``steps`` makes the lookups from them
    (see ``operators.enrich``). A plain join of a stream with a table keeps the files it started with.
    """
    def enriched(batch: DataFrame, batch_id: int) -> None:
        write(enrich(batch, *steps(load(batch.sparkSession))), batch_id)

    return enriched


def enrich_batches_as_of(write, load, *lookups: tuple):
    """Look each batch up in dimensions as they were at the time of each row, then hand it to ``write``.

    ``load`` reads the change logs of the dimensions by name, anew for every batch. A lookup is (name, key,
    dimension key, columns to take, further arguments of ``operators.enrich.lookup_as_of`` by name); a later one
    may use a key that an earlier one brought in.
    """
    def enriched(batch: DataFrame, batch_id: int) -> None:
        logs = load(batch.sparkSession)
        for name, key, dimension_key, take, more in lookups:
            batch = lookup_as_of(batch, logs[name], key, dimension_key, take, **more)
        write(batch, batch_id)

    return enriched
