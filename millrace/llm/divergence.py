"""Source divergence audit: how far the word frequencies of a language's sources lie apart.

The counts come from single-pass in-memory indexing. A task reads its documents once and gathers
postings (language, term, source) in memory. When BLOCK of them are held it spills them as one run,
sorted by term and cut by the hash of the term into shards. Each shard merges its runs a stretch of terms at a time,
and what leaves the merge are whole posting lists with their frequencies.

The distance of two sources is a sum over all terms the language keeps, most of which neither of
them uses. That common part has a closed form; a second pass streams over the posting lists and adds
what the terms in use change about it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.session import staged

from .common import pick, tasks
from .rows import by_row, shape, streaming

#: Postings that a task holds before it spills a run, postings in one row of a run, and those a merge takes on at a time.
BLOCK, ROW, STRETCH = 250_000, 2048, 200_000
#: Terms whose part of the distances a task sums up.
TERMS = 5000
#: Sources whose distances to all others are summed at a time.
TILE = 1024
#: Texts above so many bytes hand over their terms in lists of WORDS.
LONG, WORDS = 1 << 20, 100_000
#: The smoothing added to each count, and the sum of all probabilities.
ADDED, UNIT = 5, 1_000_000_000

#: Of lower-cased UTF-8: letters, and all bytes of what is not ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Stands in the runs for "a document of this group"; no text has it as a term.
GROUP = b""

RUNS = shape("shard int, lang string, first binary, terms binary[], sources string[], counts bigint[], docs bigint[]")
POSTINGS = shape("lang string, term string, sources string[], counts bigint[]")
SUMS = shape("lang string, source string, part string, item string, value bigint")


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size if it is long."""
    lower = text.lower()  # of bytes: only A-Z
    if len(lower) < LONG:
        yield TERM.findall(lower)
        return
    found = TERM.finditer(lower)
    while part := [m[0] for m in islice(found, WORDS)]:
        yield part


class Block:
    """Postings in memory: for each group its documents, and by term the occurrences and documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before = len(docs)
        seen: set[bytes] = {GROUP}
        for terms in term_lists(text):
            counts.update(terms)
            seen.update(terms)
        docs.update(seen)
        self.size += len(docs) - before

    def run(self, shards: int) -> pa.RecordBatch:
        """The sorted run, in rows that hold terms of one shard and language."""
        groups = list(self.groups)
        terms, counts, docs, sizes = [], [], [], []
        for group in groups:
            occurrences, found = self.groups[group]
            terms += found
            counts += map(occurrences.__getitem__, found)
            docs += found.values()
            sizes.append(len(found))
        of = np.repeat(np.arange(len(groups)), sizes)
        langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        postings = pa.table({
            "shard": pa.array(np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards, pa.int32()),
            "lang": langs.take(pa.array(of)), "terms": pa.array(terms, pa.binary()), "sources": sources.take(pa.array(of)),
            "counts": pa.array(counts, pa.int64()), "docs": pa.array(docs, pa.int64())})
        postings = postings.take(pc.sort_indices(postings, [(c, "ascending") for c in ("shard", "lang", "terms", "sources")])).combine_chunks()
        flat = {c: postings[c].chunk(0) if len(terms) else postings[c].combine_chunks() for c in postings.column_names}
        place = flat["lang"].dictionary_encode().indices.to_numpy() + len(groups) * flat["shard"].to_numpy().astype(np.int64)
        begins = np.flatnonzero(np.diff(place, prepend=-1)) if len(terms) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(terms))
        starts = np.concatenate([np.arange(b, e, ROW) for b, e in zip(begins, ends, strict=False)] or [np.zeros(0, np.int64)])
        offsets = pa.array(np.append(starts, len(terms)), pa.int32())
        at = pa.array(starts)
        kinds = to_arrow_schema(RUNS)
        columns = [flat["shard"].take(at), flat["lang"].take(at), flat["terms"].take(at)]
        columns += [pa.ListArray.from_arrays(offsets, flat[c]).cast(kinds.field(c).type) for c in ("terms", "sources", "counts", "docs")]
        return pa.RecordBatch.from_arrays(columns, schema=kinds)


def index(shards: int, block: int = BLOCK):
    """Documents (lang, source, text) to sorted runs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                held.add(lang, source, text.encode())
                if held.size >= block:
                    yield held.run(shards)
                    held = Block()
        if held.size:
            yield held.run(shards)

    return runs


def summed(postings: pa.Table) -> pa.Table:
    """One row for each term and source."""
    sums = postings.group_by(["term", "source"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
    return sums.select(["term", "source", "count_sum", "docs_sum"]).rename_columns(["term", "source", "count", "docs"])


class Merge:
    """Rows of runs of one shard and language, merged a stretch of terms at a time.

    Rows come by their first terms, so all terms before the latest first one are complete and leave. What stays is summed up
    by term and source, and looked through again when as much has come on top of it: however many rows reach over the
    same terms, each is gone through a few times only.
    """

    def __init__(self):
        self.held: list[pa.Table] = []
        self.size, self.full = 0, STRETCH

    def add(self, postings: pa.Table) -> None:
        self.size += len(postings)
        self.held.append(postings)

    def before(self, term: bytes | None) -> pa.Table | None:
        """The postings of all terms before this one (None: of all), which leave the merge."""
        if not self.size:
            return None
        done, rest = pa.concat_tables(self.held), []
        if term is not None:
            below = pc.less(done["term"], pa.scalar(term, pa.binary()))
            done, rest = done.filter(below), [summed(done.filter(pc.invert(below)))]
        self.held, self.size = rest, sum(map(len, rest))
        self.full = max(STRETCH, 2 * self.size)
        return done if len(done) else None


def posting_lists(least_docs: int):
    """Merge the runs of a shard; terms in too few documents of their language end here."""

    def lists(lang: str, postings: pa.Table | None) -> Iterator[tuple]:
        if postings is None:
            return
        sums = summed(postings)
        docs = sums.group_by("term", use_threads=False).aggregate([("docs", "sum")])
        enough = pc.or_(pc.greater_equal(docs["docs_sum"], least_docs), pc.equal(docs["term"], pa.scalar(GROUP, pa.binary())))
        kept = sums.filter(pc.is_in(sums["term"], value_set=docs["term"].filter(enough).combine_chunks()))
        kept = kept.sort_by([("term", "ascending"), ("source", "ascending")])
        rows = zip(*(kept[c].to_pylist() for c in ("term", "source", "count")), strict=True)
        for term, found in groupby(rows, key=lambda r: r[0]):
            _, sources, counts = zip(*found, strict=True)
            yield lang, term.decode(), sources, counts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place, merge = None, Merge()
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True))
            ends = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
            flat = pa.table([batch.column(c).flatten() for c in range(3, 7)], ["term", "source", "count", "docs"])
            begun = 0
            for i, at in enumerate(places):
                if at != place or merge.size + ends[i] - ends[begun] >= merge.full:
                    merge.add(flat.slice(ends[begun], ends[i] - ends[begun]))
                    begun = i
                    if at == place:
                        yield from lists(place[1], merge.before(batch.column(2)[i].as_py()))
                    else:
                        if place:
                            yield from lists(place[1], merge.before(None))
                        place, merge = at, Merge()
            merge.add(flat.slice(ends[begun]))
        if place:
            yield from lists(place[1], merge.before(None))

    return streaming(rows, POSTINGS, 256)


class Distances:
    """Sums over the terms of one language in one shard, for the sources of one tile against all."""

    def __init__(self, lang: str, lead: bool, top: int):
        self.lang, self.lead, self.top = lang, lead, top
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.kept, self.own = 0, []

    def group(self, source: str, total: int, kept: int, in_tile: bool) -> None:
        if in_tile:
            self.own.append(len(self.names))
        self.names.append(source)
        self.sizes.append(total)
        self.kept = kept

    def probability(self, count: int, total: int) -> int:
        return 1 + UNIT * (count + ADDED) // (total + ADDED * self.kept)

    def begin(self) -> None:
        """All groups are known."""
        self.place = {s: i for i, s in enumerate(self.names)}
        self.line = {g: i for i, g in enumerate(self.own)}
        self.unused = np.array([self.probability(0, n) if self.kept else 0 for n in self.sizes], np.int64)
        self.total = sum(self.sizes)
        self.apart = np.abs(self.unused[self.own][:, None] - self.unused[None, :])
        self.direct = self.apart * (self.kept if self.lead else 0)
        self.mirror = np.zeros_like(self.direct)
        self.best: dict[int, list[tuple[int, bytes, str]]] = {g: [] for g in self.own}

    def term(self, term: str, sources: list[str], counts: list[int]) -> None:
        at = [self.place[s] for s in sources]
        p = [self.probability(c, self.sizes[g]) for c, g in zip(counts, at, strict=True)]
        whole = self.probability(sum(counts), self.total)
        used = self.unused.copy()
        used[at] = p
        own = [(g, x) for g, x in zip(at, p, strict=True) if g in self.line]
        lines = [self.line[g] for g, _ in own]
        change = np.abs(np.array([x for _, x in own], np.int64)[:, None] - used[None, :]) - self.apart[lines]
        self.direct[lines] += change
        change[:, at] = 0  # the others do not have the term, so this side counts for both
        self.mirror[lines] += change
        for g, x in own:
            if x > whole:
                best = self.best[g]
                best.append((whole - x, term.encode(), term))
                if len(best) > 8 * self.top:
                    best.sort()
                    del best[self.top :]

    def rows(self) -> Iterator[tuple]:
        for g, line in self.line.items():
            for h, other in enumerate(self.names):
                if h != g:
                    if self.lead or self.direct[line, h]:
                        yield self.lang, self.names[g], "pair", other, int(self.direct[line, h])
                    if self.mirror[line, h]:
                        yield self.lang, other, "pair", self.names[g], int(self.mirror[line, h])
            for value, _, term in sorted(self.best[g])[: self.top]:
                yield self.lang, self.names[g], "term", term, -value


def distances(top: int):
    """Stream over groups, then posting lists, of each shard, tile and language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place, held, begun = None, None, False
        for shard, tile, lang, kind, name, total, kept, in_tile, sources, counts in by_row(batches):
            if (shard, tile, lang) != place:
                if held:
                    if not begun:
                        held.begin()
                    yield from held.rows()
                place, held, begun = (shard, tile, lang), Distances(lang, shard == 0, top), False
            if kind == 0:
                held.group(name, total, kept, in_tile)
            else:
                if not begun:
                    held.begin()
                    begun = True
                held.term(name, sources, counts)
        if held:
            if not begun:
                held.begin()
            yield from held.rows()

    return streaming(rows, SUMS, 4096)


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """For each (lang, source) its distance to the language's other sources and the terms it overuses.

    docs has text, lang and source; a null in any of them counts as ''. A language keeps the terms
    found in at least least_docs of its rows (repeated rows count each). Over them a group's
    probability of a term is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), all in whole numbers. Part
    `pair` lists all other sources of the language with the summed absolute differences, part `term`
    the `top` terms that a group uses more than its language does, by the difference. Ties go to the
    smaller item by its UTF-8 bytes. A group without terms is still a source, and a language without
    kept terms has pairs of value 0. An empty table gives no rows. Other columns play no part.

    Each text is read once. Runs hold one posting per term, source and task, so a hot source is
    counted before the shuffle; a term's list is no longer than its language has sources.
    Distances are summed for TILE sources at a time, so what a task holds grows with the number of
    sources only.
    """
    spark = docs.sparkSession
    shards = tasks(spark)
    texts = pick(docs, "lang", "source", "text").na.fill("")
    runs = texts.mapInArrow(index(shards), RUNS)
    lists = staged(
        runs.repartitionById(shards, "shard").sortWithinPartitions("shard", "lang", "first")
        .mapInArrow(posting_lists(least_docs), POSTINGS), "postings")
    terms = lists.where(F.col("term") != "")
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p")).groupBy(
        "lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("total"))
    groups = (
        lists.where(F.col("term") == "").select("lang", F.explode("sources").alias("source"))
        .join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0))
    n_terms, most = lists.agg(F.count("*"), F.max(F.when(F.col("term") == "", F.size("sources")))).first()
    tiles, parts = -(-(most or 1) // TILE), max(1, min(shards, n_terms // TERMS))
    tile_of = lambda source: F.pmod(F.xxhash64(source), F.lit(tiles)).cast("int")
    none = F.lit(None)
    told = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard"), "lang", "source", "total", "kept",
    ).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "lang", F.lit(0).alias("kind"), F.col("source").alias("name"),
        "total", "kept", tile_of("source").alias("own"), none.cast("array<string>").alias("sources"), none.cast("array<bigint>").alias("counts"),
    ).withColumn("own", F.col("own") == F.col("tile"))
    used = terms.select(
        F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("shard"),
        F.explode(F.array_distinct(F.transform("sources", tile_of))).alias("tile"),
        "lang", F.lit(1).alias("kind"), F.col("term").alias("name"), none.cast("bigint").alias("total"),
        none.cast("bigint").alias("kept"), none.cast("boolean").alias("own"), "sources", "counts")
    found = (
        told.unionByName(used).repartitionById(parts * tiles, F.col("shard") * tiles + F.col("tile"))
        .sortWithinPartitions("shard", "tile", "lang", "kind").mapInArrow(distances(top), SUMS))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return (
        found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
        .where((F.col("part") == "pair") | (F.col("rank") <= top)))
