"""Writers for micro-batches and the tables read back from what they wrote.

Every batch goes to its own ``batch_id=`` folder, which a retry completes or leaves. So each batch counts
once however often it is run.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.changelog import last_cells, latest_by_key, merge_cells
from millrace.session import folders, made, written

DIMENSION_KEY = ["sink_table", "row_key"]


def append_batches(path: str, partition_by=(), format: str = "parquet"):
    """Append whole batches, for example partitioned by ``sink_table`` or ``cur_date``.

    A batch that was written to its end is left as it is, so a stream that reads the folder takes no row twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if written(batch.sparkSession, f"{path}/batch_id={batch_id}"):
            return
        writer = batch.write.mode("overwrite").format(format)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{path}/batch_id={batch_id}")

    return write


def load_json_lines(path: str, drop=()):
    """Window results as one JSON object per line, by day; null fields are left out."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fields = [c for c in batch.columns if c not in drop]
        rows = batch.select(F.to_json(F.struct(*fields)).alias("value"), "cur_date")
        rows.write.mode("overwrite").partitionBy("cur_date").text(f"{path}/batch_id={batch_id}")

    return write


def upserts(path: str, key, order):
    """Keyed writes: the last row per key of each batch, deletions included."""
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, list(key), list(order)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_upserts(spark: SparkSession, path: str, key, order, op: str | None = None, schema=None) -> DataFrame:
    """The last row per key over all batches, deleted keys left out; of rows equal in ``order`` the later batch's."""
    reader = spark.read if schema is None else spark.read.schema(_with_batch(schema))
    return latest_by_key(reader.parquet(path), list(key), [*order, "batch_id"], op).drop("batch_id")


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])


def put_cells(path: str):
    """Log routed dimension changes for :func:`read_dimensions`."""
    return append_batches(path, ["sink_table"])


def read_dimensions(spark: SparkSession, path: str, order=("ts",), live: DataFrame | None = None) -> DataFrame:
    """All dimension rows out of the logged puts and deletes; of changes equal in ``order`` the later batch's counts.

    ``live`` holds the routes in force: rows of sinks without one are gone, as the sink is.
    """
    changes = spark.read.parquet(path)
    if live is not None:
        changes = changes.join(live.select("sink_table").distinct(), "sink_table", "left_semi")
    return merge_cells(changes, DIMENSION_KEY, [*order, "batch_id"], "op_type", "row")


def fold_upserts(spark: SparkSession, path: str, folded: str, key, order, op: str | None = None) -> None:
    """Rewrite a grown keyed log as one batch that holds the current rows only."""
    rows = read_upserts(spark, path, key, order, op)
    rows.write.mode("overwrite").parquet(f"{folded}/batch_id=0")


class KeyedLog:
    """A log of batches that folds itself: every so many batches only what still counts is kept.

    A catalog table tells where the log is. A fold writes the folded rows to a fresh folder and then moves
    the table there in one statement, so a reader sees the log before or after it. Later batches go
    to the new folder. A batch that runs again after its fold finds itself in it and writes nothing;
    one that runs again before the table has moved writes and folds anew. So reads stay within one
    fold and ``every`` batches. ``fold`` takes the rows with their ``batch_id`` and gives those to keep. Without
    a lasting catalog the newest complete fold below ``path`` is taken up.
    """

    def __init__(self, table: str, path: str, schema: T.StructType, fold, every: int = 20, partition_by=()):
        self.table, self.path, self.schema = table, path.rstrip("/"), schema
        self.fold, self.every, self.partition_by = fold, every, list(partition_by)

    def _folder(self, number: int) -> str:
        return f"{self.path}/fold={number}"

    def _complete(self, spark: SparkSession, number: int) -> bool:
        return number < 0 or written(spark, f"{self._folder(number)}/batch_id={number}")

    def location(self, spark: SparkSession) -> str:
        """The folder the log is in now."""
        if not spark.catalog.tableExists(self.table):
            folds = [n for n in folders(spark, self.path, "fold=") if self._complete(spark, n)]
            where = made(spark, self._folder(max(folds, default=-1)))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            spark.sql(f"create table {self.table} ({columns}) using parquet location '{where}'")
        details = spark.sql(f"describe table extended {self.table}")
        return details.where(F.col("col_name") == "Location").first()["data_type"]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        where = self.location(spark)
        if where.rstrip("/").endswith(f"fold={batch_id}"):
            return
        append_batches(where, self.partition_by)(batch.select(*self.schema.fieldNames()), batch_id)
        if batch_id % self.every == self.every - 1:
            kept = self.fold(self.read(spark)).select(*self.schema.fieldNames())
            append_batches(self._folder(batch_id), self.partition_by)(kept, batch_id)
            spark.sql(f"alter table {self.table} set location '{self._folder(batch_id)}'")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows of the log as it is now, with their ``batch_id``."""
        return spark.read.schema(_with_batch(self.schema)).parquet(self.location(spark))


def folded_dimensions(changes: DataFrame, order=("ts",)) -> DataFrame:
    """Dimension rows after all the puts and deletes of a table."""
    return merge_cells(changes, DIMENSION_KEY, list(order), "op_type", "row")


def upsert_log(table: str, path: str, schema: T.StructType, key, order, every: int = 20) -> KeyedLog:
    """A folding log of keyed rows; deletions stay, so that an older row that comes later does not undo them."""
    return KeyedLog(table, path, schema, lambda rows: latest_by_key(rows, list(key), [*order, "batch_id"]), every)


def current_rows(log: KeyedLog, spark: SparkSession, key, order, op: str | None = None) -> DataFrame:
    """The last row per key of an :func:`upsert_log`, deleted keys left out."""
    return latest_by_key(log.read(spark), list(key), [*order, "batch_id"], op).drop("batch_id")


# The batch a dimension change came with; a fold keeps it, as it decides between changes of one time.
BATCH = "batch"


def dimension_log(table: str, path: str, schema: T.StructType, order=("ts",), every: int = 20) -> KeyedLog:
    """A folding log of routed puts and deletes; a fold keeps of each change the cells that no later one holds, and the last deletion."""
    with_batch = T.StructType([*schema.fields, T.StructField(BATCH, T.IntegerType())])
    return KeyedLog(table, path, with_batch, lambda rows: last_cells(rows, DIMENSION_KEY, [*order, BATCH], "op_type", "row"),
                    every, ["sink_table"])


def log_dimensions(log: KeyedLog):
    """Write routed changes to a :func:`dimension_log`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(batch.withColumn(BATCH, F.lit(batch_id)), batch_id)

    return write


def logged_dimensions(log: KeyedLog, spark: SparkSession, order=("ts",)) -> DataFrame:
    """All dimension rows of a :func:`dimension_log`, as :func:`read_dimensions` gives them."""
    return merge_cells(log.read(spark), DIMENSION_KEY, [*order, BATCH], "op_type", "row")


def sync_sinks(spark: SparkSession, changes: DataFrame, database: str) -> None:
    """Create and drop dimension tables as routing changes say: c and r create, d drops, u does both.

    Only the last change of a sink counts. Table statements run on the driver, one per sink.
    """
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    spark.sql(f"create database if not exists {quoted(database)}")
    last = latest_by_key(changes.select("sink_table", "op", "sink_columns", "ts_ms"), ["sink_table"], ["ts_ms"])
    for change in last.toLocalIterator():
        name = f"{quoted(database)}.{quoted(change.sink_table)}"
        if change.op in ("d", "u"):
            spark.sql(f"drop table if exists {name}")
        if change.op in ("c", "r", "u"):
            columns = ", ".join(f"{quoted(c)} string" for c in change.sink_columns.split(","))
            spark.sql(f"create table if not exists {name} ({columns}) using parquet")
