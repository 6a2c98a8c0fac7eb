"""Exact top-k search by inner product: tiles of queries times shards of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, tasks

#: Rows of a shard and of a query tile; their product bounds the scores a task holds at once.
SHARD_ROWS, TILE_ROWS = 2048, 512
#: Partial lists of a query that one merge takes in.
FAN_IN = 64

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    made = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return F.when(vector.isNotNull() & ~bad, made)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; sums beyond 64 bits are held at the end of the range."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (queries, vectors)]
    if most[0] * most[1] * queries.shape[1] < 2**53:  # every partial sum is exact in doubles
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    wide = queries.astype(object) @ vectors.astype(object).T
    return np.clip(wide, LONG_MIN, LONG_MAX).astype(np.int64)


def best_of_tile(k: int):
    """The k best candidates of each query in each pair of tile and shard; ties go to the smaller id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, q, c in zip(frame["part"], frame["queries"], frame["rows"], strict=True):
                q_ids = np.array([r["vec_id"] for r in q], np.int64)
                c_ids = np.array([r["vec_id"] for r in c], np.int64)
                order = np.argsort(c_ids)
                c_ids = c_ids[order]
                score = products(np.array([r["v"] for r in q], np.int64), np.array([r["v"] for r in c], np.int64)[order])
                out = []
                for i, own in enumerate(q_ids):
                    line, ids = score[i], c_ids
                    other = ids != own
                    if not other.all():
                        line, ids = line[other], ids[other]
                    if len(line) > k:
                        least = np.partition(line, len(line) - k)[len(line) - k]  # the k-th best score
                        above, tied = np.flatnonzero(line > least), np.flatnonzero(line == least)
                        at = np.concatenate([above, tied[: k - len(above)]])
                        line, ids = line[at], ids[at]
                    out.append(pd.DataFrame({"query_id": own, "part": part, "vec_id": ids, "score": line}))
                if out:
                    yield pd.concat(out)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the largest inner product for each query row.

    queries is a condition on vec_id. Components become floor(scale * x) and scores are exact
    integers. A query is never its own candidate; ties go to the smaller vec_id; fewer candidates
    give fewer rows. Rows with a null id, a null vector or null or non-finite components take no
    part. Only vectors of one length are compared. Rows that repeat an id count once, with the
    smallest vector. An empty table gives no rows.

    Tiles of queries meet shards of rows as packed blocks. Both sides are dealt out by
    (slice of shards, tile), so neither is broadcast, and no task holds more than a tile and a
    shard. Each pair yields k rows a query; these are merged in a tree of FAN_IN lists a step.
    """
    spark = vectors.sparkSession
    rows = (
        pick(vectors, "vec_id", "embedding")
        .select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .groupBy("vec_id").agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )
    wanted = rows.where(queries)
    n = rows.agg(F.count("*")).first()[0]
    m = wanted.agg(F.count("*")).first()[0]
    shards, tiles = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // TILE_ROWS))
    slices = min(shards, max(1, -(-2 * tasks(spark) // tiles)))
    packed = F.collect_list(F.struct("vec_id", "v"))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    shard = rows.groupBy("dim", place.alias("shard")).agg(packed.alias("rows"))
    tile = wanted.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile")).agg(packed.alias("queries"))
    key = ["dim", "slice", "tile"]
    left = shard.select(
        "dim", (F.col("shard") % slices).alias("slice"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("tile"),
        F.col("shard").alias("part"), "rows",
    )
    right = tile.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("slice"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "part", "vec_id", "score")])
    found = (
        left.join(right, key).select("part", "queries", "rows")
        .mapInPandas(best_of_tile(k), schema)
    )
    merged = lambda by: F.slice(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "score"))), 1, k
    )
    parts = shards
    while True:
        parts = -(-parts // FAN_IN)
        by = ["query_id", F.floor(F.col("part") / FAN_IN).cast("bigint").alias("part")] if parts > 1 else ["query_id"]
        best = found.groupBy(*by).agg(merged(by).alias("best"))
        if parts == 1:
            break
        found = best.select("query_id", "part", F.explode("best").alias("b")).select(
            "query_id", "part", F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"),
    )
