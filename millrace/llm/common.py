"""Helpers shared by the operators: exact column choice, folds, bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from millrace.session import prepare, staged


#: Rows of an Arrow batch. Texts are long, and a batch is held in the executor and in its Python worker.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and Arrow batches fit for long texts unless it says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return prepare(spark)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone. Names match exactly, so columns that differ in case only do no harm."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall into no fold."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wrapped(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others as one struct _row: no column added beside them clashes with the caller's."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    rest = [F.col(f"_{i}") for i, c in enumerate(df.columns) if c not in names] or [F.lit(None).cast("int").alias("_")]
    return plain.select(F.struct(*rest).alias("_row"), *[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def unwrapped(rows: DataFrame, like: DataFrame, *names: str, more: tuple = ()) -> DataFrame:
    """The columns of `like` again, in their order, after :func:`wrapped` with the same names; then those of `more`."""
    return rows.select(*[F.col(c) if c in names else F.col(f"_row._{i}").alias(c) for i, c in enumerate(like.columns)], *more)


def drawn_texts(docs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """At most `most` of rows (doc_id and labels) with their texts, one row per id, the same in every run.

    rows are chosen by the hash of their id. A null text counts as empty; of several documents or
    label rows with one id, the smallest counts. The texts stay with the executors.
    """
    names = [c for c in rows.columns if c != "doc_id"]
    each = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"), *[F.min(n).alias(n) for n in names])
    wanted = each.drop("rows").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(wanted), "doc_id")  # at most `most` ids are broadcast
    return staged(found.groupBy("doc_id", *names).agg(F.min("text").alias("text")), "drawn")


def per_text(rows: DataFrame, make: Callable[[list], list], fields: str, batch: int = 256, keep_text: bool = False) -> DataFrame:
    """rows (with a column text), by default without their texts, with the columns that make gives for a list of texts.

    make gets at most `batch` texts (None for null) and returns one list or array per field.
    Other columns pass unchanged. No shuffle; one Arrow batch is held at a time.
    """
    keep = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    made = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in made.fields]
    names = [f.name for f in keep] + made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                columns = make(part.column("text").to_pylist())
                arrays = [part.column(f.name) for f in keep]
                arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, StructType(keep + made.fields))
