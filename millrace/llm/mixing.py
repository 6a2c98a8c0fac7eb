"""Mixing to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

from .common import per_text, pick, unwrapped, wrapped

#: Margins that the weights are raked to.
MARGINS = ("source", "lang", "topic")
#: A margin's default target: its share of tokens to this power. 1 keeps the shares, 0 makes them equal.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Topics, the size of their word profiles, and passes over all profiles to find them.
TOPICS, DIMENSIONS, PASSES = 8, 64, 4
#: Sweeps over the margins at most, and the largest relative error at which they end.
SWEEPS, TOLERANCE = 30, 1e-4
#: Cells of source, language and topic that may be broadcast.
BROADCAST_CELLS = 100_000
#: Share of all tokens that the sample shall have.
RATE = 0.6


def profile(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words, and a unit vector of hashed counts of the words of five letters and more."""
    words = (text or "").lower().split()
    long_words = [zlib.crc32(w.encode("utf-8", "replace")) % DIMENSIONS for w in words if len(w) >= 5]
    counts = np.log1p(np.bincount(np.array(long_words, np.int64), minlength=DIMENSIONS)).astype(np.float32)
    length = float(np.linalg.norm(counts))
    return len(words), counts / length if length else counts


def profiles(rows: DataFrame) -> DataFrame:
    """rows without their text, with n_tokens and the profile as bytes."""

    def run(texts: list) -> list:
        made = [profile(t) for t in texts]
        return [[n for n, _ in made], [v.tobytes() for _, v in made]]

    return per_text(rows, run, "n_tokens bigint, profile binary")


def vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMENSIONS)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The topic of each profile by its difference from the mean, row 0 of centres; -1 for empty profiles."""
    if len(centres) < 2:
        return np.full(len(x), -1)
    return np.where(x.any(1), ((x - centres[0]) @ centres[1:].T).argmax(1), -1)


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def topic_centres(profiled: DataFrame) -> np.ndarray:
    """The mean of all profiles, then unit-length topic centres, found by PASSES of spherical k-means over all profiles.

    Topics start at the profiles with the smallest hashes. A task returns one sum per topic.
    """
    seeds = profiled.select("profile").distinct().orderBy(F.xxhash64("profile"), "profile").limit(4 * TOPICS).collect()
    found = [v for r in seeds if (v := np.frombuffer(bytes(r["profile"]), np.float32)).any()][:TOPICS]
    if not found:
        return np.zeros((0, DIMENSIONS))
    start = np.array(found, np.float64)

    def summed(centres: np.ndarray | None) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 if centres is None else len(start), DIMENSIONS))
            for b in batches:
                if b.num_rows:
                    x = vectors(b.column("profile"))
                    x = x[x.any(1)].astype(np.float64)
                    topic = np.zeros(len(x), np.int64) if centres is None else nearest(x, centres)
                    away = unit(x if centres is None else x - centres[0])
                    for k in np.unique(topic):
                        total[k] += away[topic == k].sum(0)
            yield pa.RecordBatch.from_pydict({"v": [total.ravel().tolist()]})

        parts = profiled.select("profile").mapInArrow(sums, "v array<double>").select(F.posexplode("v").alias("i", "x"))
        # Decimals add up to the same sum in any order, so every run finds the same topics.
        added = parts.groupBy("i").agg(F.sum(F.col("x").cast("decimal(30,9)")).alias("x")).collect()
        out = np.zeros((1 if centres is None else len(start)) * DIMENSIONS)
        for r in added:
            out[r["i"]] = float(r["x"])
        return out.reshape(-1, DIMENSIONS)

    rows = profiled.where(F.col("profile") != F.lit(bytes(4 * DIMENSIONS))).count()
    mean = summed(None) / max(1, rows)
    centres = np.concatenate([mean, unit(start - mean)])
    for _ in range(PASSES):
        total = summed(centres)
        centres = np.concatenate([mean, np.where(np.any(total, axis=1, keepdims=True), unit(total), centres[1:])])
    return centres


def with_topic(profiled: DataFrame, centres: np.ndarray) -> DataFrame:
    """Profiles replaced by the topic's name; none for texts without long words."""
    keep = [f.name for f in profiled.schema.fields if f.name != "profile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                topic = nearest(vectors(b.column("profile")), centres)
                names = pa.array([f"topic{k}" if k >= 0 else "none" for k in topic], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], names], [*keep, "topic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profiled.schema.fields if f.name != "profile")
    return profiled.mapInArrow(run, schema + ", topic string")


def cell(column: Column) -> Column:
    """A margin's value as text that tells null from all values."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def raked(cells: DataFrame, flatten: dict[str, float], targets: dict[str, dict[str, float]]) -> DataFrame:
    """cells (the margins, tokens) with weight: tokens scaled until every margin has its target share.

    A margin's targets are shares by value, or else its own shares flattened. Values without a
    target get none of the weight. Each sweep scales to one margin after the other, and the cells are written out after
    each, so that no plan holds more than one scaling. The sum of weights stays that of the tokens. Targets that contradict each other end
    after SWEEPS with the last margin met.
    """
    spark = cells.sparkSession
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    goals = {}
    for m in MARGINS:
        if m in targets:
            rows = [(f"={k}" if k is not None else "", float(v)) for k, v in targets[m].items()]
            goal = spark.createDataFrame(rows, f"{m} string, power double")
        else:
            goal = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(flatten[m])).alias("power")).where("power > 0")
        whole = goal.agg(F.sum("power")).first()[0] or 1.0
        goals[m] = goal.select(m, (F.col("power") / whole * total).alias(f"_{m}"))
    given = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        given = given.join(goals[m], m, "left")
    now = staged(given.withColumn("before", F.col("weight")), "cells")
    for _ in range(SWEEPS if total else 0):
        now = now.withColumn("before", F.col("weight"))
        for m in MARGINS:
            factor = F.when(F.sum("weight") > 0, F.coalesce(F.max(f"_{m}"), F.lit(0.0)) / F.sum("weight")).otherwise(0.0)
            scaled = now.join(now.groupBy(m).agg(factor.alias("_factor")), m).withColumn("weight", F.col("weight") * F.col("_factor"))
            now = staged(scaled.select(*now.columns), "cells")
        moved = now.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest("weight", F.lit(1.0)))).first()[0]
        if moved is None or moved < TOLERANCE:
            break
    return now.select(*cells.columns, "weight")


def calibrated(cells: DataFrame, rate: float) -> DataFrame:
    """cells with weight per token and probability: the factor times one scale, at most 1.

    The scale makes the expected tokens of the sample rate times all tokens, as far as cells that
    have a weight allow. It is found by two sums over the cells, each at 64 scales.
    """
    rated = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    least, most, total = rated.where("factor > 0").agg(F.min("factor"), F.max("factor"), F.sum("tokens")).first()
    if not total:
        return rated.withColumn("probability", F.lit(0.0))
    wanted = rate * (cells.agg(F.sum("tokens")).first()[0])
    low, high = rate / most * 1e-3, 1.0 / least
    for _ in range(2):
        scales = np.geomspace(low, high, 64)
        got = rated.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * float(s))).alias(f"s{i}")
                          for i, s in enumerate(scales)]).first()
        at = next((i for i, x in enumerate(got) if x >= wanted), len(scales) - 1)
        low, high = scales[max(0, at - 1)], scales[at]
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * float(high)))


def drawn(chance: Column, *identity: str) -> Column:
    """Whether a row is in the sample: its own fixed number from 0 to 1 lies below its probability."""
    return F.pmod(F.xxhash64(F.lit("mixing"), *identity), F.lit(2**53)) / 2.0**53 < chance


def plan(rows: DataFrame, rate: float, flatten: dict[str, float], targets: dict | None) -> tuple[np.ndarray, DataFrame, bool]:
    """The topics, the calibrated cells and whether these may be broadcast, from rows (source, lang, text)."""
    profiled = staged(profiles(rows.select(cell(F.col("source")).alias("source"), cell(F.col("lang")).alias("lang"), "text")), "profiles")
    centres = topic_centres(profiled)
    named = with_topic(profiled, centres).withColumn("topic", cell(F.col("topic")))
    cells = staged(named.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    done = staged(calibrated(raked(cells, flatten, targets or {}), rate).select(
        # Sums of doubles differ in their last places from run to run; the results don't.
        *[F.col(m).alias(f"_{m}") for m in MARGINS], F.round("factor", 9).alias("factor"), F.round("probability", 9).alias("probability")), "cells")
    return centres, done, done.count() <= BROADCAST_CELLS


NAMES = ("doc_id", "text", "lang", "source")


def placed(documents: DataFrame, rate: float, flatten: dict | None, targets: dict | None) -> DataFrame:
    """documents, wrapped, with n_tokens, topic, weight, probability and kept beside their own columns."""
    centres, cells, small = plan(pick(documents, *NAMES), rate, flatten or FLATTEN, targets)

    def run(texts: list) -> list:
        made = [profile(t) for t in texts]
        topic = nearest(np.array([v for _, v in made]).reshape(-1, DIMENSIONS), centres)
        return [[n for n, _ in made], [f"topic{k}" if k >= 0 else "none" for k in topic]]

    marked = per_text(wrapped(documents, *NAMES), run, "n_tokens bigint, topic string", keep_text=True)
    cells = cells.select(*[F.col(f"_{m}").alias(f"cell_{m}") for m in MARGINS], F.col("factor").alias("weight"), "probability")
    same = ((cell(F.col("source")) == F.col("cell_source")) & (cell(F.col("lang")) == F.col("cell_lang"))
            & (cell(F.col("topic")) == F.col("cell_topic")))
    joined = marked.join(F.broadcast(cells) if small else cells, same)
    return joined.withColumn("kept", drawn(F.col("probability"), "doc_id", "text"))


def mix(documents: DataFrame, rate: float = RATE, flatten: dict | None = None, targets: dict | None = None) -> DataFrame:
    """documents (doc_id, text, lang, source) with topic, n_tokens, weight, probability and kept, a row per input row.

    Token counts per source, language and topic are raked to the margins' targets; a cell's weight
    per token, times one scale, is the probability of its documents. Every document is drawn on
    its own by a hash of its id and text, so runs agree and repeated rows share their fate. Null
    sources and languages are values of their own; texts without words have no tokens, and cells
    without tokens probability 0. An empty table gives no rows. The cells are broadcast if there
    are at most BROADCAST_CELLS, and joined by shuffle beyond that.
    """
    found = placed(pick(documents, *NAMES), rate, flatten, targets)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def sample(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents drawn, with all their columns, whatever their names, and their weight per token as mix_weight.

    A column mix_weight of their own is replaced. Null and empty texts have no tokens, so their cell decides: one without any
    tokens gives probability 0. Repeated rows share their fate; an empty table gives no rows.
    """
    found = placed(documents, rate, None, None).where("kept")
    whole = unwrapped(found, documents, *NAMES, more=(F.col("weight").alias("mix_weight"),))
    if "mix_weight" not in documents.columns:
        return whole
    old = documents.columns.index("mix_weight")
    parts = whole.toDF(*[f"_{i}" for i in range(len(whole.columns))])
    return parts.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(whole.columns) if i != old])
