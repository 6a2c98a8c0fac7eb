"""Language identification by hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, held_out, per_text, pick

#: Dimensions of a letter vector. Chance cosines are about 1 / sqrt(DIMENSIONS).
DIMENSIONS = 512
#: Documents of one language that its prototype is bundled from, as expected by the sampling rate.
SAMPLE_PER_LANGUAGE = 2_000
#: Letters of texts that are bundled in one matrix product.
LETTERS_AT_ONCE = 1_000_000
UNKNOWN = "und"


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each code point."""
    words = DIMENSIONS // 64
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
        z = (z + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.unpackbits(z.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    """Letter vectors permuted by their place in the trigram and bound by multiplication."""
    letters = [(grams >> np.uint64(21 * i)) & np.uint64(0x1FFFFF) for i in (2, 1, 0)]
    known, at = np.unique(np.concatenate(letters), return_inverse=True)
    vectors = letter_vectors(known)
    first, second, third = np.split(at, 3)
    return np.roll(vectors, 2, 1)[first] * np.roll(vectors, 1, 1)[second] * vectors[third]


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text; any run of other characters, and either end, is one space."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter()[raw]
    if not letter.any():
        return np.empty(0, np.uint64)
    codes = np.zeros(len(raw) + 2, np.uint64)
    codes[1:-1] = np.where(letter, raw, 32)
    codes[0] = codes[-1] = 32
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


def bundles(texts: list[str]) -> np.ndarray:
    """The sum of the trigram vectors of each text, whole texts, counted with repetition."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    held, first, size = [], 0, 0
    for i, text in enumerate([*texts, None]):
        if text is None or size >= LETTERS_AT_ONCE:
            if size:
                own = np.repeat(np.arange(len(held)), [len(g) for g in held])
                known, at = np.unique(np.concatenate(held), return_inverse=True)
                counts = np.bincount(own * len(known) + at, minlength=len(held) * len(known))
                counts = counts.reshape(len(held), len(known)).astype(np.float32)
                out[first : first + len(held)] = counts @ trigram_vectors(known)
            held, first, size = [], i, 0
        if text is not None:
            held.append(trigrams(text))
            size += len(held[-1])
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def prototypes(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages learned, and the unit-length bundle of the sampled documents of each.

    Learns from documents with a language whose id is not in the held-out fold, about `sample` of
    each language: the counts cover all documents and set a rate by the hash of the id. A task
    sends one partial sum per language, so the driver gets no more rows than documents sampled.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != fold))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = usable.where(draw < F.element_at(rate, F.col("lang"))).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                vectors = unit(bundles(part.column("text").to_pylist()))
                for lang, v in zip(part.column("lang").to_pylist(), vectors, strict=True):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    summed: dict[str, np.ndarray] = {}
    for r in chosen.mapInArrow(sums, "lang string, v array<double>").collect():
        summed[r["lang"]] = summed.get(r["lang"], 0) + np.array(r["v"])
    langs = sorted(lang for lang, v in summed.items() if np.any(v))
    if not langs:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    return langs, unit(np.array([summed[lang] for lang in langs])).astype(np.float32)


def identify(documents: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """documents (doc_id, text, lang) with held_out, lang_pred and score, one row per input row.

    Each text is the bundle of all its trigram vectors; the prediction is the prototype with the
    largest cosine, the score that cosine, not below 0. `und` with score 0 for texts that are
    null or have no letter, and when nothing could be learned. Ties go to the first language by
    name. Null ids are held out of nothing and learned from in no case; repeated rows each get
    their row; an empty table gives no rows. Only doc_id, text and lang are read, and lang only
    to learn. The map of rates and the prototypes grow with the number of languages only.
    """
    docs = pick(documents, "doc_id", "text", "lang")
    langs, known = prototypes(docs, folds, fold)

    def predict(texts: list) -> list:
        texts = ["" if t is None else t for t in texts]
        vectors = unit(bundles(texts))
        some = np.array([any(c.isalpha() for c in t) for t in texts], bool) if langs else np.zeros(len(texts), bool)
        cosine = vectors @ known.T if langs else np.zeros((len(texts), 1))
        best = cosine.argmax(1) if len(texts) else []
        score = np.clip(cosine.max(1), 0, 1) if len(texts) else np.zeros(0)
        return [[langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0).astype(float)]

    out = per_text(docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text"), predict,
                   "lang_pred string, score double")
    return out.select("doc_id", "held_out", "lang_pred", "score")
