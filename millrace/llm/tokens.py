"""Token ids of documents in wavelet matrix files, one file per shard of consecutive documents."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import shared_folder, staged

from .common import pick, tasks
from .rows import by_row, shape, streaming
from .wavelet import Wavelet, pack

#: Ids after which a shard ends, and parts of texts whose ids a worker remembers.
SHARD, REMEMBERED = 1 << 20, 1_000_000
#: Fixed value: the id that ends a document.
END = 0
SUFFIX = ".wavelet"
WRITTEN = shape("part int, piece int, n_docs bigint, n_ids bigint")
READ = shape("part int, piece int, at int, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
FOUND = shape("token int, doc_id bigint, part int, piece int, at int, place bigint")


#: Letters in every version of Unicode that a tokenizer may use; ASCII signs but letters, white space and the apostrophe;
#: and all ASCII but letters and the apostrophe.
LETTERS, SIGNS, OTHERS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-@\[-`{-~", r"\x00-&(-@\[-`{-\x7f"
PARTS = re.compile("|".join([
    f" ?[{LETTERS}]+(?=[{OTHERS}])",  # a word
    f" ?[{SIGNS}]+(?= ?[{LETTERS}])",  # signs and digits between words
    f" ?[{SIGNS}]+\n(?=[{LETTERS}])",  # the end of a line
    f"(?s:.)+?(?:(?<=[{LETTERS}])(?=[{OTHERS}])|\\Z)",  # whatever else, up to the end of a word
]))
WORD = re.compile(f" ?[{LETTERS}]+")


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: the byte's own if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Ids of whole texts by a public byte-level vocabulary.

    Such a tokenizer never joins a letter with a sign, digit or space after it, nor a sign with a space and
    letter after it, whatever surrounds them: there a text is cut into PARTS, and the ids of a part
    depend on that part alone. Parts repeat, so their ids are remembered, up to REMEMBERED of them. New words, which
    the tokenizer would not cut further, go to its model at once; other parts go through all of it. Words with an
    apostrophe, other scripts and runs of white space are never cut inside.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are text
        self.pairs = self.model.model
        self.signs = byte_signs()

    def __missing__(self, part: str) -> bytes:
        if WORD.fullmatch(part):
            ids = [t.id for t in self.pairs.tokenize(part.encode().decode("latin-1").translate(self.signs))]
        else:
            ids = self.model.encode_batch_fast([part], add_special_tokens=False)[0].ids
        self[part] = made = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, PARTS.findall(text)))


ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker, which later tasks find with what it remembers."""
    if path not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def store(folder: str) -> tuple[stores.FileSystem, str]:
    """The store of a folder and the folder's path in it."""
    return stores.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


def save(folder: str, name: str, content: bytes) -> None:
    """Write a whole file under a name of its own, then give it its name; a second try replaces it by the same."""
    where, root = store(folder)
    own = f"{root}/_{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(content)
    where.move(own, f"{root}/{name}")


def shards(folder: str, vocabulary: str, size: int):
    """Sorted documents (doc_id, text) to files; yields what each holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = encoder_of(vocabulary)
        part, piece = TaskContext.get().partitionId(), 0
        held, documents, total = [], [], 0

        def full():
            save(folder, f"{part:06d}-{piece:06d}{SUFFIX}", pack(np.concatenate(held), documents, part=part, piece=piece))
            return part, piece, len(documents), total

        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                tokens = np.frombuffer(encoder.encode(text.as_py()) + end, "<u4")
                if held and total + len(tokens) > size:
                    yield full()
                    held, documents, total, piece = [], [], 0, piece + 1
                held.append(tokens)
                documents.append((doc_id, len(tokens)))
                total += len(tokens)
        if held:
            yield full()

    return streaming(rows, WRITTEN, 16)


def write(docs: DataFrame, folder: str, vocabulary: str, size: int = SHARD) -> DataFrame:
    """Write the ids of all documents below a folder; returns what each file holds (part, piece, n_docs, n_ids).

    docs has doc_id and text; other columns play no part. Documents come in ascending doc_id (null ids
    first); rows of one id by a hash of their texts, equal rows in any order. A null text is empty, and
    each document ends with id END. Strings of special tokens in a text are text.

    Tasks get ranges of ids, also of a single id with very many rows. A task holds one Arrow batch and
    one shard of about `size` ids; a longer document is a shard of its own. No document is divided.
    Task and shard numbers name a file, so a task that runs again replaces its files by equal ones.
    """
    spark = docs.sparkSession
    where, root = store(folder)
    where.create_dir(root)
    texts = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "hash", "row"]
    sorted_rows = (
        texts.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select("doc_id", "text"))
    return staged(sorted_rows.mapInArrow(shards(folder, vocabulary, size), WRITTEN), "token-shards")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: its place, its start in its file, its number of ids and their checksum."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (content,) in by_row(batches):
            matrix = Wavelet(content)
            ids = matrix.tokens().astype("<u4")
            for at, (doc_id, n) in enumerate(matrix.documents):
                begin = int(matrix.starts[at])
                yield matrix.index["part"], matrix.index["piece"], at, doc_id, begin, n, zlib.crc32(ids[begin : begin + n].tobytes())

    return files(spark, folder).mapInArrow(streaming(rows, READ, 4096), READ)


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Every occurrence of the tokens: document and place in it. Only the blocks on their way are unpacked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (content,) in by_row(batches):
            matrix = Wavelet(content)
            for token in tokens:
                for i in matrix.occurrences(token).tolist():
                    at, place = matrix.place(i)
                    yield token, matrix.documents[at][0], matrix.index["part"], matrix.index["piece"], at, place

    return files(spark, folder).mapInArrow(streaming(rows, FOUND, 4096), FOUND)


def counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """How often each token occurs in all files, by rank alone."""
    kinds = shape("token int, n bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (content,) in by_row(batches):
            matrix = Wavelet(content)
            for token in tokens:
                yield token, matrix.count(token)

    return files(spark, folder).mapInArrow(streaming(rows, kinds, 4096), kinds).groupBy("token").agg(F.sum("n").alias("n"))


def placed(written: DataFrame) -> DataFrame:
    """The number of ids before each file, from the sums of tasks first and of the files of one task then."""
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("all"))
    # One row per task.
    parts = parts.withColumn("ahead", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    within = written.select("part", "piece", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return within.join(parts, "part").select(
        "part", "piece", (F.coalesce("ahead", F.lit(0)) + F.col("inside")).alias("ahead"))


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, size: int = SHARD) -> DataFrame:
    """Write the files (see :func:`write`), read them back, and place each document among all ids.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32
    (of the ids as little-endian 32-bit integers), one row for every row of docs. An empty table
    gives no files and no rows.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    before = placed(write(docs, folder, vocabulary, size))
    return read(spark, folder).join(before, ["part", "piece"]).select(
        "doc_id", (F.col("ahead") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
