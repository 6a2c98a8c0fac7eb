"""Removal of long repeated byte strings by a distributed merge of front-coded suffix runs.

A window is a string of SPAN bytes. Each window has one anchor: the start of the least hashed
GRAM-byte string in it, the leftmost of equals. Equal windows have equal anchors, so only the
suffixes at anchors are sorted, about one in 70. An anchor stands for the windows that start
from `far` to `near` bytes before it, and its context, the bytes of all of them, decides which
of them occur again.

1. Anchors of all texts are counted by the hash of their gram; those that occur once have no
   equal window anywhere and go.
2. The others are joined with their texts. Each task sorts its contexts by what follows the
   anchor and cuts this run into one front-coded block per bucket.
3. A bucket merges its runs with a loser tree that compares strings from their known common
   prefix on. The merged order and its common prefixes, with those of the bytes before the
   anchors, tell for every window whether an equal one exists.

Anchors whose gram occurs more than HOT times don't meet in one bucket: their windows are dealt
out one by one, by 128-bit fingerprints, at most one of a kind from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

from .common import pick, tasks

SPAN, GRAM = 200, 50
WINDOW_GRAMS = SPAN - GRAM + 1
#: Anchors of one gram that may meet in a bucket; see the module's text for those beyond.
HOT = 4_000
#: Bytes of a text looked at in one go, and contexts that a task holds before it writes its run.
STRETCH, RUN_CONTEXTS = 1 << 22, 100_000

WORD = np.uint64
PLACE = WORD((1 << 24) - 1)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd


class Hashes:
    """Hashes of all strings of one length in a text, from sums of weighted bytes modulo 2 ** 64."""

    def __init__(self, which: int):
        self.table = np.random.default_rng(100 + which).integers(0, 2**64, 256, dtype=WORD)
        self.factor = FACTORS[which]
        self.up = self.down = np.ones(1, WORD)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, factor in (("up", self.factor), ("down", pow(self.factor, -1, 2**64))):
                steps = np.full(n, factor, WORD)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=WORD))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self.powers(len(raw) + 1)
        out = np.zeros(len(raw) + 1, WORD)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, starts, length: int) -> np.ndarray:
        z = (sums[starts + length] - sums[starts]) * self.down[starts]
        z = (z ^ (z >> WORD(30))) * WORD(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> WORD(27))) * WORD(0x94D049BB133111EB)
        return z ^ (z >> WORD(31))


GRAMS, SECOND = Hashes(0), Hashes(1)


def anchors_of(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, place, near and far of the anchors of a text's windows."""
    parts = []
    for at in range(0, max(0, len(raw) - SPAN + 1), STRETCH):
        part = raw[at : at + STRETCH + SPAN - 1]  # the windows that start in this stretch
        n = len(part) - GRAM + 1
        hashes = GRAMS.at(GRAMS.sums(part), np.arange(n), GRAM)
        ranked = (hashes & ~PLACE) | np.arange(n, dtype=WORD)
        rows = np.full(-(-n // WINDOW_GRAMS) * WINDOW_GRAMS, 2**64 - 1, WORD)
        rows[:n] = ranked
        rows = rows.reshape(-1, WINDOW_GRAMS)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - WINDOW_GRAMS + 1], ahead[WINDOW_GRAMS - 1 : n])
        place = (least & PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        s = place[first]
        parts.append((hashes[s].view(np.int64), s + at, s - last, s - first))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def anchored(docs: DataFrame) -> DataFrame:
    """docs (tid, raw) as one row per anchor: gram, tid and the anchor's place, near and far in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, owners, places = [], [], []
            size = 0
            for i, (tid, raw) in enumerate(zip(b.column("tid").to_pylist(), b.column("raw"), strict=True)):
                text = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else np.empty(0, np.uint8)
                if len(text) >= SPAN:
                    gram, s, near, far = anchors_of(text)
                    grams.append(gram)
                    owners.append(np.full(len(gram), tid))
                    places.append(s << 16 | near << 8 | far)
                    size += len(gram)
                if grams and (size > 200_000 or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, owners, places)], ["gram", "tid", "place"])
                    grams, owners, places, size = [], [], [], 0
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, owners, places)], ["gram", "tid", "place"])

    return docs.mapInArrow(run, "gram bigint, tid bigint, place bigint")


def common(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before; 0 for the first."""
    out = np.zeros(len(matrix), np.int64)
    if len(matrix) > 1:
        differ = matrix[1:] != matrix[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


def as_matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    joined = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(joined, np.uint8).reshape(len(strings), width), lengths


def spans_of(tids: np.ndarray, places: np.ndarray, far: np.ndarray, near: np.ndarray, repeated: np.ndarray) -> pd.DataFrame:
    """Runs of repeated windows as byte ranges; repeated[i, d] speaks of the window d bytes before anchor i."""
    edge = np.zeros((len(repeated), 1), np.int8)
    step = np.diff(np.concatenate([edge, repeated.astype(np.int8), edge], 1), axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return pd.DataFrame({"tid": tids[row], "low": places[row] - high + 1, "high": places[row] - low + SPAN})


BLOCK = ("shared", "lengths", "tails", "lefts", "left", "tids", "places", "known")
BLOCKS = "hot boolean, bucket bigint, " + ", ".join(f"{c} binary" for c in BLOCK)


def run_blocks(contexts: list[tuple], buckets: int) -> Iterator[dict]:
    """The sorted run of (right, left, tid, place, known), cut into a front-coded block per bucket."""
    dealt: dict[int, list[tuple]] = {}
    for c in sorted(contexts):
        dealt.setdefault(xxhash.xxh64_intdigest(c[0][:GRAM]) % buckets, []).append(c)
    for bucket, own in dealt.items():
        rights = [c[0] for c in own]
        shared = common(*as_matrix(rights, SPAN))
        yield {
            "hot": False, "bucket": bucket, "shared": shared.astype(np.uint8).tobytes(),
            "lengths": np.array([len(r) for r in rights], np.uint8).tobytes(),
            "tails": b"".join(r[k:] for r, k in zip(rights, shared, strict=True)),
            "lefts": np.array([len(c[1]) for c in own], np.uint8).tobytes(), "left": b"".join(c[1] for c in own),
            "tids": np.array([c[2] for c in own], np.int64).tobytes(), "places": np.array([c[3] for c in own], np.int64).tobytes(),
            "known": np.array([c[4] for c in own], bool).tobytes(),
        }


def hot_blocks(windows: list[tuple], buckets: int) -> Iterator[dict]:
    """One entry per window of (first, second, tids, places), dealt out by fingerprint; more than one of a kind is known."""
    first, second, tids, places = (np.concatenate(x) for x in zip(*windows, strict=True))
    order = np.lexsort((second, first))
    first, second, tids, places = first[order], second[order], tids[order], places[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
    at = np.flatnonzero(new)
    counts = np.diff(np.r_[at, len(first)])
    more = np.repeat(counts > 1, counts)
    yield from window_spans(tids[more], places[more])
    first, second, tids, places, known = first[at], second[at], tids[at], places[at], counts > 1
    bucket = (first % WORD(buckets)).astype(np.int64)
    for k in np.unique(bucket):
        m = bucket == k
        yield {"hot": True, "bucket": int(k), "tails": first[m].tobytes(), "left": second[m].tobytes(), "tids": tids[m].tobytes(),
               "places": places[m].tobytes(), "known": known[m].tobytes(), "shared": None, "lengths": None, "lefts": None}


def span_block(spans: pd.DataFrame) -> Iterator[dict]:
    """Byte ranges as a block without a bucket."""
    if len(spans):
        yield {"hot": None, "bucket": None, "tids": spans["tid"].to_numpy(np.int64).tobytes(),
               "places": spans["low"].to_numpy(np.int64).tobytes(), "left": spans["high"].to_numpy(np.int64).tobytes(),
               "shared": None, "lengths": None, "tails": None, "lefts": None, "known": None}


def merged_windows(tids: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """Ranges covered by windows that start at the places."""
    order = np.lexsort((places, tids))
    tids, places = tids[order], places[order]
    if not len(tids):
        return pd.DataFrame({"tid": tids, "low": places, "high": places})
    new = np.flatnonzero(np.r_[True, (tids[1:] != tids[:-1]) | (places[1:] > places[:-1] + SPAN)])
    last = np.r_[new[1:], len(tids)] - 1
    return pd.DataFrame({"tid": tids[new], "low": places[new], "high": places[last] + SPAN})


def window_spans(tids: np.ndarray, places: np.ndarray) -> Iterator[dict]:
    yield from span_block(merged_windows(tids, places))


def blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """texts (tid, raw, places, hots) as the blocks of each task's runs.

    A context that a task meets again has nothing but repeated windows: all its places are spans
    at once, and one entry that needs no answer stays in the run.
    """

    def flushed(cold: dict, hot: list) -> Iterator[dict]:
        held, low, high, owner = [], [], [], []
        for (right, left), found in cold.items():
            held.append((right, left, *found[0], len(found) > 1))
            if len(found) > 1:
                for tid, s in found:
                    owner.append(tid)
                    low.append(s - len(left))
                    high.append(s + len(right))
        yield from run_blocks(held, buckets)
        yield from span_block(pd.DataFrame({"tid": np.array(owner, np.int64), "low": low, "high": high}))
        if hot:
            yield from hot_blocks(hot, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold: dict[tuple, list] = {}
        hot: list[tuple] = []
        size = 0

        def out():
            for x in flushed(cold, hot):
                yield pa.RecordBatch.from_pylist([x], schema)

        for b in batches:
            for tid, raw, places, hots in zip(*(b.column(c) for c in ("tid", "raw", "places", "hots")), strict=True):
                tid, raw = tid.as_py(), raw.as_py()
                places, hots = places.values.to_numpy(), hots.values.to_numpy(zero_copy_only=False)
                s, near, far = places >> 16, places >> 8 & 255, places & 255
                cool = ~hots
                for at, n, f in zip(s[cool].tolist(), near[cool].tolist(), far[cool].tolist()):
                    cold.setdefault((raw[at : at + SPAN - n], raw[at - f : at][::-1]), []).append((tid, at))
                size += int(cool.sum())
                if hots.any():
                    text = np.frombuffer(raw, np.uint8)
                    width = (far - near + 1)[hots]
                    starts = np.unique(np.repeat((s - far)[hots], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
                    one, two = GRAMS.at(GRAMS.sums(text), starts, SPAN), SECOND.at(SECOND.sums(text), starts, SPAN)
                    hot.append((one, two, np.full(len(starts), tid), starts))
                    size += len(starts) // 8
                if size >= RUN_CONTEXTS:
                    yield from out()
                    cold, hot, size = {}, [], 0
        yield from out()

    schema = pa.schema([("hot", pa.bool_()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in BLOCK]])
    return texts.mapInArrow(run, BLOCKS)


class LoserTree:
    """Merges sorted runs of strings, each with its common prefix with the string before it in its run.

    A node keeps the loser of its match and the common prefix of that string with the last one
    given out. Of two strings the one with the longer such prefix is smaller, with no look at their
    bytes; equal prefixes are compared from there on.
    """

    def __init__(self, runs: list[tuple[list[bytes], np.ndarray]]):
        self.runs = [r for r, _ in runs]
        self.prefixes = [p.tolist() for _, p in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.next = [0] * self.size
        self.nodes: list[tuple[int, int]] = [(-1, 0)] * self.size
        self.top = self.play(1)

    def string(self, run: int) -> bytes | None:
        return self.runs[run][self.next[run]] if run < len(self.runs) and self.next[run] < len(self.runs[run]) else None

    def match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser of two entries (run, common prefix with the last string given out)."""
        (i, p), (j, q) = a, b
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return a, b
        x, y = self.string(i), self.string(j)
        most = min(len(x), len(y))
        if x[p:most] == y[p:most]:
            k = most
        else:
            k, width = p, 8
            while x[k : k + width] == y[k : k + width]:
                k += width
                width *= 2
            while width > 1:  # the first difference is within width bytes of k
                width //= 2
                if x[k : k + width] == y[k : k + width]:
                    k += width
        first = x[k : k + 1] < y[k : k + 1] or x[k : k + 1] == y[k : k + 1] and i < j
        return ((i, p), (j, k)) if first else ((j, p), (i, k))

    def play(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            run = node - self.size
            return (run, 0 if self.string(run) is not None else -1)
        winner, self.nodes[node] = self.match(self.play(2 * node), self.play(2 * node + 1))
        return winner

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in the run, common prefix with the string before) in sorted order."""
        while self.top[1] >= 0:
            run, prefix = self.top
            at = self.next[run]
            yield run, at, prefix
            self.next[run] = at = at + 1
            now = (run, self.prefixes[run][at] if at < len(self.runs[run]) else -1)
            node = (run + self.size) // 2
            while node:
                now, self.nodes[node] = self.match(now, self.nodes[node])
                node //= 2
            self.top = now


def decoded(block) -> dict:
    """A block's strings, rebuilt from their common prefixes, and its other columns as arrays."""
    shared = np.frombuffer(block.shared, np.uint8).astype(np.int64)
    lengths = np.frombuffer(block.lengths, np.uint8).astype(np.int64)
    rights, at, before = [], 0, b""
    for k, n in zip(shared.tolist(), lengths.tolist()):
        before = before[:k] + block.tails[at : at + n - k]
        at += n - k
        rights.append(before)
    sizes = np.frombuffer(block.lefts, np.uint8).astype(np.int64)
    ends = np.cumsum(sizes).tolist()
    lefts = [block.left[e - n : e] for e, n in zip(ends, sizes.tolist())]
    return {"rights": rights, "shared": shared, "lefts": lefts, "tids": np.frombuffer(block.tids, np.int64),
            "places": np.frombuffer(block.places, np.int64), "known": np.frombuffer(block.known, bool)}


def merged_spans(runs: list[dict]) -> pd.DataFrame:
    """Repeated windows of the unanswered entries of sorted runs."""
    tree = LoserTree([(r["rights"], r["shared"]) for r in runs])
    order = np.array(list(tree.merged()), np.int64).reshape(-1, 3)
    offsets = np.cumsum([0] + [len(r["rights"]) for r in runs])[:-1]
    at, prefix = offsets[order[:, 0]] + order[:, 1], order[:, 2]
    prefix[:1] = 0
    # Only strings that share a gram with a neighbour can share a window.
    near_next = np.r_[prefix[1:] >= GRAM, False]
    grouped = (prefix >= GRAM) | near_next
    prefix = np.where(prefix >= GRAM, prefix, 0)[grouped]
    at = at[grouped]
    lefts = [x for r in runs for x in r["lefts"]]
    rights = np.concatenate([[len(x) for x in r["rights"]] for r in runs]).astype(np.int64)[at]
    tids, places, known = (np.concatenate([r[c] for r in runs])[at] for c in ("tids", "places", "known"))
    lefts = [lefts[i] for i in at.tolist()]
    n = len(at)
    if not n:
        return pd.DataFrame({"tid": tids, "low": places, "high": places})
    by_left = np.array(sorted(range(n), key=lefts.__getitem__))
    matrix, sizes = as_matrix([lefts[i] for i in by_left], SPAN)
    shared_left = common(matrix, sizes)
    far, near = np.empty(n, np.int64), SPAN - rights
    far[by_left] = sizes
    repeated = np.zeros((n, WINDOW_GRAMS), bool)
    left_class = np.empty(n, np.int64)
    for d in range(WINDOW_GRAMS):
        here = np.flatnonzero((near <= d) & (d <= far))
        if len(here) < 2:
            continue
        right_class = np.cumsum(prefix < SPAN - d)
        left_class[by_left] = np.cumsum(shared_left < d)
        both = right_class[here] * (n + 1) + left_class[here]
        _, which, counts = np.unique(both, return_inverse=True, return_counts=True)
        repeated[here, d] = counts[which] > 1
    repeated &= ~known[:, None]
    return spans_of(tids, places, far, near, repeated)


def hot_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows among the dealt-out fingerprints of a bucket."""
    first, second = (np.concatenate([np.frombuffer(x, WORD) for x in rows[c]]) for c in ("tails", "left"))
    tids, places = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("tids", "places"))
    known = np.concatenate([np.frombuffer(x, bool) for x in rows["known"]])
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    at = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    counts = np.diff(np.r_[at, len(first)])
    repeated = np.zeros(len(first), bool)
    repeated[order] = np.repeat(counts > 1, counts)
    repeated &= ~known
    return merged_windows(tids[repeated], places[repeated])


def bucket_spans(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    if key[0]:
        return hot_spans(rows)
    return merged_spans([decoded(r) for r in rows.itertuples(index=False)])


def known_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, low, high in zip(*(b.column(c).to_pylist() for c in ("tids", "places", "left")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (t, low, high)], ["tid", "low", "high"])


def union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the ranges cover."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.r_[True, low[1:] > high[:-1]]
    at = np.flatnonzero(new)
    return low[at], high[np.r_[at[1:], len(low)] - 1]


def cut(raw: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip(np.r_[0, high].tolist(), np.r_[low, len(raw)].tolist(), strict=True))


def removed(texts: DataFrame, kept_text: bool) -> DataFrame:
    """texts (tid, raw, spans) with what the cut removes and the digest of what stays; the rest itself on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tid, raw, spans in zip(*(b.column(c).to_pylist() for c in ("tid", "raw", "spans")), strict=True):
                low, high = union(np.array([s["low"] for s in spans], np.int64), np.array([s["high"] for s in spans], np.int64))
                kept = cut(raw, low, high)
                row = {"tid": tid, "n_removed": len(raw) - len(kept), "n_spans": len(low), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                out.append(row | {"kept": kept} if kept_text else row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("tid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
                       + [("kept", pa.binary())] * kept_text)
    return texts.mapInArrow(run, "tid bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept_text)


def remove_repeats(documents: DataFrame, kept_text: bool = False) -> DataFrame:
    """documents (doc_id, text) with n_bytes, n_removed, n_spans and kept_sha256, one row per input row.

    Every byte covered by a SPAN-byte string that also starts anywhere else in the documents is
    removed; n_spans counts the maximal removed runs. A text that occurs in several rows is gone
    whole if it has SPAN bytes. With kept_text, a binary column kept holds the rest (null where
    nothing was removed). Null texts are empty. Ids play no part, so null and repeated ids do no
    harm. An empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = pick(documents, "doc_id", "text").withColumn("raw", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    docs = docs.select("doc_id", F.xxhash64("raw").alias("tid"), "raw")
    buckets = max(tasks(spark), 2 * documents.rdd.getNumPartitions())
    found = staged(anchored(docs.select("tid", "raw")), "anchors")
    # Stored, so that the join deals out both sides itself and Spark can split the anchors of a frequent gram.
    grams = staged(found.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram", (F.col("c") > HOT).alias("hot")), "grams")
    wanted = found.join(grams, "gram").groupBy("tid").agg(
        F.collect_set(F.struct("place", "hot")).alias("found"))
    base = staged(docs.select("doc_id", "tid", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("whole")), "base")
    # Of rows with one text, those with its smallest id bring it along.
    copies = staged(base.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "copies")
    wanted = wanted.join(copies, "tid").withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    texts = docs.withColumn("id", F.coalesce("doc_id", F.lit(0))).join(wanted, ["tid", "id"]).select(
        "tid", "raw", "rows", F.col("found.place").alias("places"), F.col("found.hot").alias("hots"))
    texts = staged(texts, "texts")
    made = staged(blocks(texts.select("tid", "raw", "places", "hots"), buckets), "blocks")
    spans = made.where("bucket is not null").groupBy("hot", "bucket").applyInPandas(bucket_spans, "tid bigint, low bigint, high bigint")
    spans = spans.unionByName(made.where("bucket is null").mapInArrow(known_spans, "tid bigint, low bigint, high bigint"))
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cuts = removed(texts.where("rows = 1").select("tid", "raw").join(spans, "tid"), kept_text)
    out = base.join(copies.select("tid", "rows"), "tid").join(cuts, "tid", "left")
    gone = (F.col("rows") > 1) & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("bigint")
    out = out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if kept_text else []),
    )
    return out
