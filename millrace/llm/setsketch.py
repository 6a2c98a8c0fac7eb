"""Near-duplicate documents by SetSketch registers: banding, joint estimates, exact checks, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import staged

from .common import per_text, pick, unwrapped, wrapped

#: Words of a shingle; least similarity of a link in hundredths.
WORDS, SIMILAR = 5, 75
#: Bands and registers of a band. A pair at the least similarity shares no band with
#: probability (1 - 0.75 ** 4) ** 36, about one in a million.
BANDS, BAND_REGISTERS = 36, 4
REGISTERS = BANDS * BAND_REGISTERS
#: Base and rate of the registers: a register is 1 - log_BASE(minimum / RATE) rounded down, from 0 to TOP.
BASE, RATE, TOP = 1.02, 64.0, 32767
#: A pair is checked on its full sets unless its registers speak against the least similarity by this log likelihood.
AGAINST = 10.0
#: Shingles that the members and the outsiders of one tile of a band's bucket have, about.
TILE_MEMBERS, TILE_OUTSIDERS = 400_000, 100_000
#: Shingles hashed at once for a long text.
AT_ONCE = 1024


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors for the words of a shingle; a factor and a summand for each register."""
    rng = np.random.default_rng(20240229)
    words = rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    factors = rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return words, factors, rng.integers(0, 2**64, REGISTERS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a whole text; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(WORDS, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * multipliers()[0][i]
    return np.unique(mix(total))


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a set. Sketches merge by their maxima."""
    _, factors, summands = multipliers()
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[at : at + AT_ONCE, None] * factors + summands).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-12))
    return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, TOP).astype(np.int16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of sketches."""
    parts = sketch.reshape(len(sketch), BANDS, BAND_REGISTERS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(BAND_REGISTERS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def likely(up, down, n_a, n_b) -> np.ndarray:
    """Whether a similarity of SIMILAR or more is compatible with the registers of pairs.

    up and down count the registers in which the first or the second sketch is larger. The sizes
    being known, the similarity is the one unknown of the joint distribution; its likelihood at
    its best above the bound is held against its best overall.
    """
    up, down, n_a, n_b = (np.asarray(x, float)[:, None] for x in (up, down, n_a, n_b))
    same = REGISTERS - up - down
    share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0, 1, 81)[None, :] * np.minimum(n_a / n_b, n_b / n_a)

    def chance(x):
        return -np.log(np.clip(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE, 1e-300, 1)) / np.log(BASE)

    p_up = np.clip(chance(share_a - share_b * grid), 1e-9, 1)
    p_down = np.clip(chance(share_b - share_a * grid), 1e-9, 1)
    p_same = np.clip(1 - p_up - p_down, 1e-9, 1)
    score = up * np.log(p_up) + down * np.log(p_down) + same * np.log(p_same)
    # The grid point next below the bound counts as above it: the grid must not decide.
    above = np.where(grid >= SIMILAR / 100 - 1 / 80, score, -np.inf).max(1)
    return above >= score.max(1) - AGAINST


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test of a link on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def sketched(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text) with n, set_key and regs of each text."""

    def run(texts: list) -> list:
        found = [shingles(t) for t in texts]
        return [[len(s) for s in found], [xxhash.xxh3_128_digest(s.tobytes()) for s in found], [registers(s).tobytes() for s in found]]

    return per_text(docs, run, "n bigint, set_key binary, regs binary", keep_text=keep_text)


def banded(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, regs) as rows of node, n, band and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sketch = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.int16).reshape(-1, REGISTERS)
            keys = band_keys(sketch).ravel()
            offsets = pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("n"), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64()))], ["node", "n", "keys"])

    made = nodes.select("node", "n", "regs").mapInArrow(run, "node bigint, n bigint, keys array<bigint>")
    return made.select("node", "n", F.posexplode("keys").alias("band", "key"))


def two_sides(pairs: DataFrame, sketches: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with the named columns of both nodes."""
    a = sketches.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = sketches.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(a, "a").join(b, "b")


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose registers allow the least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            n_a, n_b = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            keep = likely((x > y).sum(1), (x < y).sum(1), n_a, n_b)
            keep &= 100 * np.minimum(n_a, n_b) >= SIMILAR * np.maximum(n_a, n_b)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return two_sides(pairs, sketches, "n", "regs").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that are similar by their full sets, made anew from their texts, which take less room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for b in batches:
            keep = []
            for x, y in zip(b.column("text_a"), b.column("text_b"), strict=True):
                if (text := y.as_py()) != last:  # the pairs of one hub come together
                    last, of_last = text, shingles(text)
                keep.append(similar(shingles(x.as_py()), of_last))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return two_sides(pairs, sketches, "text").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each linked node, as node and component; links are (a, b).

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the least
    of them, until every node points at the root of its tree. Each round is written out, so the
    lineage stays short. No round holds the neighbours of a node together.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        inner = edges.select(F.col("b").alias("a")).distinct()  # a node that points on and is pointed at
        rows, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if rows == nodes and edges.join(inner, "a", "left_semi").isEmpty():
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def tile_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar pairs of an outsider and a member of another component in each tile.

    Pairs that the registers allow are checked on their full sets, each in the first band it shares
    only, and not where one of both is the hub, which was checked with all members before.
    """
    for frame in frames:
        for band, hub, rows in zip(frame["band"], frame["hub"], frame["rows"], strict=True):
            node = np.array([r["node"] for r in rows], np.int64)
            comp = np.array([r["component"] for r in rows], np.int64)
            n = np.array([r["n"] for r in rows], np.int64)
            out = np.array([r["outside"] for r in rows], bool)
            first = np.array([r["first"] for r in rows], bool)  # here as an outsider of the tile
            regs = np.frombuffer(b"".join(bytes(r["regs"]) for r in rows), np.int16).reshape(-1, REGISTERS)
            members = np.flatnonzero(~first & (node != hub))
            found, sets = [], {}

            def full(i: int, rows=rows, sets=sets) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles(rows[i]["text"])
                return sets[i]

            for i in np.flatnonzero(first & (node != hub)):
                at = members[comp[members] != comp[i]]
                at = at[~out[at] | (node[at] > node[i])]  # two outsiders meet twice
                at = at[100 * np.minimum(n[at], n[i]) >= SIMILAR * np.maximum(n[at], n[i])]
                if not len(at):
                    continue
                shared = (regs[at] == regs[i]).reshape(len(at), BANDS, BAND_REGISTERS).all(2)
                at = at[shared.argmax(1) == band]
                up, down = (regs[at] > regs[i]).sum(1), (regs[at] < regs[i]).sum(1)
                at = at[likely(up, down, n[at], np.full(len(at), n[i]))] if len(at) else at
                found += [(node[i], node[j]) for j in at if similar(full(i), full(j))]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])


def left_over(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """The links (a, b) still missing in buckets that hold several components.

    In such a bucket the nodes outside its largest component are its outsiders; only they can be
    part of a missing link. Every outsider meets every member in a tile of bounded size.
    """
    known = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = staged(known, "members")
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    buckets = staged(sizes.groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"),
        F.sum("s").alias("shingles"), F.max_by("s", F.struct("c", "component")).alias("inside"),
    ).where("most < all and all > 2"), "buckets")
    known = known.join(buckets, "key").withColumn("outside", F.col("component") != F.col("main"))
    known = known.drop("n").join(sketches.select("node", "n", "regs", "text"), "node")
    mine = F.xxhash64("node")
    wide = F.ceil(F.col("shingles") / TILE_MEMBERS).cast("bigint")
    deep = F.ceil((F.col("shingles") - F.col("inside")) / TILE_OUTSIDERS).cast("bigint")
    zero = F.lit(0).cast("bigint")
    row = ["band", "key", "hub", "node", "component", "n", "regs", "text", "outside"]
    as_member = known.select(*row, F.lit(False).alias("first"), F.pmod(mine, wide).alias("x"),
                             F.explode(F.sequence(zero, deep - 1)).alias("y"))
    as_outsider = known.where("outside").select(*row, F.lit(True).alias("first"), F.explode(F.sequence(zero, wide - 1)).alias("x"),
                                                F.pmod(mine, deep).alias("y"))
    tiles = as_member.unionByName(as_outsider).groupBy("key", "x", "y").agg(
        F.first("band").alias("band"), F.first("hub").alias("hub"),
        F.collect_list(F.struct("node", "component", "n", "regs", "text", "outside", "first")).alias("rows"))
    return tiles.select("band", "hub", "rows").mapInPandas(tile_pairs, "a bigint, b bigint")


def link(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) with n_shingles, component_id and kept, one row per input row.

    Texts with one set of shingles are one node, named by its smallest doc_id, so copies are never
    compared. Nodes that share a band are candidates. In each bucket all members are first checked
    with its smallest node, the hub; where several components remain, the nodes outside the
    largest one are checked with all the others, in tiles. Every candidate pair is thus linked,
    joined through others, or refuted by its registers or its full sets; no bucket is cut.

    Null texts and texts without words have no shingles and are linked with nothing. Rows that
    repeat a doc_id are one document and share a component. A null doc_id has a null component and
    is kept. An empty table gives no rows.
    """
    docs = pick(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = staged(sketched(docs), "sketches")
    some = rows.where("n > 0 and doc_id is not null")
    nodes = staged(
        some.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes")
    bands = banded(nodes)
    # Stored, so that the join deals out both sides itself and Spark can split a large bucket.
    buckets = staged(bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"), "buckets")
    members = staged(bands.join(buckets, "key"), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sketches = staged(
        sketched(docs.join(wanted, "doc_id", "left_semi"), keep_text=True).select(F.col("doc_id").alias("node"), "n", "regs", "text")
        .where("n > 0"), "sets")
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = staged(confirmed(estimated(pairs, sketches), sketches), "links")
    second = staged(left_over(members, components(first), sketches), "links")
    node_of = nodes.select("set_key", "node")
    placed = rows.select("doc_id", "n", "set_key").join(node_of, "set_key", "left")
    repeated = placed.where("node is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    repeated = placed.join(repeated.select("doc_id", "b"), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    labels = components(first.unionByName(second).unionByName(repeated))
    found = placed.join(labels, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    same = F.col("doc_id") == F.col("component_id")
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).cast(kind).alias("component_id"),
        F.coalesce(same, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with one row of each group of near duplicates, that of the smallest doc_id; all columns stay, whatever
    their names.

    Of rows that repeat an id one with the smallest text stays. Rows without an id all stay, and so do null and empty
    texts, which are linked with nothing. An empty table gives no rows. Only rows of repeated ids are sorted.
    """
    rows = wrapped(documents, "doc_id", "text")
    kept = link(documents).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = staged(kept, "kept").withColumnRenamed("doc_id", "kept_id")
    named = rows.join(kept, F.col("doc_id") == F.col("kept_id"))
    once = named.where("copies = 1").select(*rows.columns)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    repeated = named.where("copies > 1").select(*rows.columns).withColumn("place", place).where("place = 1").drop("place")
    return unwrapped(once.unionByName(repeated).unionByName(rows.where(F.col("doc_id").isNull())), documents, "doc_id", "text")
