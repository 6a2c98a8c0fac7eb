"""Arrow batches to rows and back, for operators that stream over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def shape(fields: str) -> T.StructType:
    """A schema from 'name kind, name kind[]'; needs no session, so modules can state it at their top."""
    made = []
    for field in fields.split(","):
        name, kind = field.split()
        plain = KINDS[kind.removesuffix("[]")]
        made.append(T.StructField(name, T.ArrayType(plain) if kind.endswith("[]") else plain))
    return T.StructType(made)


def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches, made one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def batches_of(rows: Iterator[tuple], schema: T.StructType, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows."""
    kinds = to_arrow_schema(schema)
    while part := list(islice(rows, size)):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def streaming(make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: T.StructType, size: int):
    """The function for mapInArrow that hands on what make yields, `size` rows at a time."""
    return lambda batches: batches_of(make(batches), schema, size)
