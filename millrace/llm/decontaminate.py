"""Benchmark decontamination by exact token windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, unwrapped, wrapped

#: Words of a window.
WINDOW = 10
#: Windows of the benchmark that may be broadcast; with at most about 600 bytes each they stay below 150 MB.
BROADCAST_WINDOWS = 200_000
BROADCAST_CHARS = 60_000_000
#: Words of one piece of a text. Windows are made piece by piece, so a long text needs no long array of them.
PIECE = 128

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The lower-case words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, BETWEEN), "")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """One row per distinct window: its words joined by spaces, its length, and the sorted ids of its items."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    made = own.select("item_id", length.cast("int").alias("len"), F.explode(
        F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.least(F.size("w"), F.lit(window))), " "))).alias("window"))
    return made.groupBy("window", "len").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def hash_of(gram: list[Column]) -> Column:
    return F.xxhash64(*gram)


def hashes_of(length: int) -> Column:
    """(low, len, hash) of the windows of a length that begin in a piece w."""
    count = F.least(F.lit(PIECE), F.size("w") - (length - 1))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("low"), F.lit(length).alias("len"), hash_of([F.get("w", i + (k - 1)) for k in range(length)]).alias("hash")))


def hits(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents (doc_id, text) reduced to one row per distinct (doc_id, text) and hit, and one for the text itself.

    Columns: doc_id, body (a hash of the text), n_words, low and len (the first word hit, from 1,
    and their number; 0 on the text's own row), rows (how often the row occurs) and items.
    """
    grams = windows_of(items, window)
    known = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("size"),
                      F.collect_set("len").alias("lengths")).first()  # at most `window` lengths
    small = known["n"] <= BROADCAST_WINDOWS and known["size"] <= BROADCAST_CHARS
    lengths = sorted(known["lengths"])
    parts = F.split("window", " ")
    hashed = F.coalesce(*[F.when(F.col("len") == n, hash_of([F.get(parts, F.lit(k)) for k in range(n)])) for n in lengths], F.lit(0))
    grams = grams.select("window", "items", F.col("len").alias("known_len"), hashed.cast("bigint").alias("known_hash"))
    docs = pick(documents, "doc_id", "text").select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), words(F.col("text")).alias("w"))
    docs = docs.select("doc_id", "body", "w", F.size("w").alias("n_words"))
    last = F.greatest(F.lit(0), F.floor((F.col("n_words") - 1) / PIECE).cast("int"))
    pieces = docs.select("doc_id", "body", "n_words", F.posexplode(F.transform(
        F.sequence(F.lit(0), last), lambda c: F.slice("w", c * PIECE + 1, PIECE + window - 1))).alias("piece", "w"))
    own = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("hash")))
    own = F.when(F.col("piece") == 0, own).otherwise(F.slice(own, 1, 0))
    seen = pieces.select("doc_id", "body", "n_words", "piece", "w", F.inline(F.concat(own, *map(hashes_of, lengths))))
    # The hash finds, the words decide; they are put together for windows whose hash is known only.
    same = (F.col("hash") == F.col("known_hash")) & (F.col("len") == F.col("known_len")) & (
        F.array_join(F.slice("w", F.greatest("low", F.lit(1)), F.col("len")), " ") == F.col("window"))
    met = seen.join(F.broadcast(grams) if small else grams, same, "left")
    met = met.where("len = 0 or items is not null").select(
        "doc_id", "body", "n_words", (F.col("piece") * PIECE + F.col("low")).alias("low"), "len", "items")
    # Copies of a text give the same hits; one of each is enough.
    return met.groupBy("doc_id", "body", "n_words", "low", "len").agg(F.count("*").alias("rows"), F.first("items").alias("items"))


def scan(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents (doc_id, text) with the share of words that occurrences of benchmark windows cover.

    items is (item_id, text). Columns: doc_id, body, n_words, n_hit, n_items, items_sha256 and
    contaminated. An item with fewer words than a window is one window; one without words is none.
    Texts that are null or empty have no words. Items with a null id cover words but aren't listed;
    items that repeat an id count once. Repeated rows each get their row, null ids too. Empty
    tables give no rows, or no hits.

    The windows of the benchmark are broadcast if there are at most BROADCAST_WINDOWS of
    BROADCAST_CHARS bytes in all, and joined by shuffle beyond that. Hashes find the
    windows and their words verify them. Only hits and one short row per text are shuffled.
    """
    found = hits(documents, items, window)
    key = ["doc_id", "body", "n_words"]
    before = Window.partitionBy(*key).orderBy("low", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("low") + F.col("len")  # the word after the hit
    covered = F.greatest(F.lit(0), end - F.greatest("low", F.coalesce(F.max(end).over(before), F.lit(0))))
    counted = found.withColumn("new", F.when(F.col("len") > 0, covered).otherwise(0))
    per_text = counted.groupBy(*key).agg(
        F.max(F.when(F.col("len") == 0, F.col("rows"))).alias("rows"), F.sum("new").alias("n_hit"), F.collect_set("items").alias("lists"))
    ids = F.array_sort(F.array_distinct(F.flatten("lists")))
    out = per_text.withColumn("ids", ids).select(*key, "n_hit", "ids", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        "doc_id", "body", F.col("n_words").cast("bigint").alias("n_words"), F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window; all columns stay, whatever their names.

    Null and empty texts have no window and stay, as do rows with a null id and a clean text; repeated rows share their
    fate. An empty benchmark keeps all rows, an empty table gives none.
    """
    dirty = scan(documents, items, window).where("contaminated").select(
        F.col("doc_id").alias("dirty_id"), F.col("body").alias("dirty_body")).distinct()
    rows = wrapped(documents, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("dirty_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("dirty_body"))
    return unwrapped(rows.join(dirty, same, "left_anti"), documents, "doc_id", "text")
