"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

from .common import per_text, pick, unwrapped, wrapped

KINDS = ("email", "ip", "card", "phone")
#: Documents with base spans that the weights are fitted on, at most.
TRAINING_ROWS = 400
#: Of each training text: regions that are fitted on at most, chosen by hash, and pieces of such a region at most.
TRAINING_REGIONS = 4
TRAINING_PIECES = 120
#: Characters of a training text, at most.
TRAINING_CHARS = 200_000
#: Pieces of a span, at most.
MOST_PIECES = 19
#: A span is added if it raises the score of its region by at least this much.
MARGIN = 1.0

# Fixed patterns of the base spans. A run of digits is entered at its start only.
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: For Spark: what every text with a base span holds.
MAY_HOLD = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9][ ().0-9-]+[0-9]"


def luhn(digits: str) -> bool:
    doubled = [(2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in EMAIL_LEFT:
            left -= 1
        if left < at and (m := EMAIL_RIGHT.match(text, at + 1)):
            out.append((left, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


# --- the random field -------------------------------------------------------------------------

#: A bracketed at or dot is one piece with its spaces.
PIECE = re.compile(r"\s?[(\[{]\s?(?:at|dot)\s?[)\]}]\s?|[^\W\d_]+|[0-9]+|\s+|.", re.S | re.I)
#: Where a region may hold a span that the base patterns miss.
TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot)\s?[)\]}]", re.I)
REACH = 48
#: Pieces of a region; longer ones are cut into regions that overlap by a longest span.
REGION_PIECES = 400
# Fixed cue words before a span.
CUES = {
    "email": frozenset("email mail e-mail contact correo courriel write".split()),
    "ip": frozenset("ip host server address addr adresse".split()),
    "card": frozenset("card visa mastercard credit debit carte tarjeta karte kreditkarte amex".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon téléphone teléfono appelez llame ruf".split()),
}
AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]", re.I)
ADDRESS = re.compile(
    r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]|\s?[(\[{]\s?dot\s?[)\]}]\s?)*\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?"
    r"[A-Za-z0-9-]+(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.|\s\.\s)[A-Za-z0-9-]+)+", re.I)
MORE_ADDRESS = re.compile(r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.|-)[A-Za-z0-9]", re.I)
QUAD = re.compile(r"[0-9]{1,3}(?:\s?[.\[\]()]{1,3}\s?[0-9]{1,3}){3}")
GROUPED = re.compile(r"\(?[0-9]{1,4}\)?(?:[\s./-]{1,2}\(?[0-9]{2,5}\)?)+")


def span_features(text: str, kind: str, a: int, b: int, before: frozenset) -> list[str]:
    """What the whole candidate span looks like to one kind."""
    span = text[a:b]
    digits = only_digits(span)
    out = ["any"]
    if kind == "email":
        out.append("address" if ADDRESS.fullmatch(span) else "no address")
        if not AT.search(span):
            out.append("no at")
    elif kind == "ip":
        parts = re.findall("[0-9]+", span)
        out.append("quad" if QUAD.fullmatch(span) else "no quad")
        out.append("bytes" if len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts) else "no bytes")
    elif kind == "card":
        out.append("length" if 13 <= len(digits) <= 19 else "no length")
        out.append("luhn" if luhn(digits) else "no luhn")
        if re.search(r"[^0-9\s./-]", span):
            out.append("odd signs")
    else:
        out.append("length" if 9 <= len(digits) <= 15 else "short" if 7 <= len(digits) < 9 else "no length")
        out.append("plus" if span[0] == "+" else "zeros" if span.startswith("00") else "no plus")
        out.append("grouped" if GROUPED.fullmatch(span.lstrip("+")) else "no groups")
        if luhn(digits) and len(digits) >= 13:
            out.append("luhn")
        if re.search(r"[^0-9\s+()./-]", span):
            out.append("odd signs")
    if kind != "email":
        if a and (text[a - 1].isalnum() or text[a - 1] == "+"):
            out.append("cut left")
        if b < len(text) and (text[b].isalnum() or text[b] in ".-" and text[b + 1 : b + 2].isdigit()):
            out.append("cut right")
        rest = text[b : b + 3].lstrip(" -.")
        if rest[:1].isdigit():
            out.append("more digits")
        lead = text[max(0, a - 3) : a].rstrip(" -.")
        if lead[-1:].isdigit():
            out.append("digits before")
    else:
        if a and text[a - 1] in EMAIL_LEFT or b < len(text) and text[b].isalnum():
            out.append("cut")
        if MORE_ADDRESS.match(text, b):
            out.append("more names")
    if before & CUES[kind]:
        out.append("cue")
    return [f"{kind}:{x}" for x in out]


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Pieces (start, end) around the places where spans may be."""
    if not TRIGGER.search(text):
        return []
    windows: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    out = []
    for a, b in windows:
        part = text[a:b]
        if len(DIGIT.findall(part)) < 4 and not AT.search(part):
            continue
        pieces = [(a + m.start(), a + m.end()) for m in PIECE.finditer(part)]
        step = REGION_PIECES - MOST_PIECES
        out += [pieces[i : i + REGION_PIECES] for i in range(0, max(1, len(pieces) - MOST_PIECES), step)]
    return out


def candidates(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """Segments (first piece, piece after the last, kind, features) that are worth a look."""
    out = []
    n = len(pieces)
    digits = np.cumsum([0] + [len(DIGIT.findall(text[a:b])) for a, b in pieces])
    signs = np.cumsum([0] + [text[a:b].lstrip()[:1] in ("@", "(", "[", "{") for a, b in pieces])
    words: list[str] = []
    for i, (a, _) in enumerate(pieces):
        if i:
            last = text[pieces[i - 1][0] : pieces[i - 1][1]]
            words += [last.lower()] if last.isalpha() else []
        first = text[a]
        if not (first.isalnum() or first in "+("):
            continue
        before = frozenset(words[-3:])
        for j in range(i + 1, min(n, i + MOST_PIECES) + 1):
            b = pieces[j - 1][1]
            if not text[b - 1].isalnum():
                continue
            count = digits[j] - digits[i]
            if signs[j] > signs[i] and AT.search(text, a, b):
                out.append((i, j, "email", span_features(text, "email", a, b, before)))
            if first.isalpha() or not text[b - 1].isdigit():
                continue
            if 4 <= count <= 12 and not (first in "+("):
                out.append((i, j, "ip", span_features(text, "ip", a, b, before)))
            if 13 <= count <= 19 and first.isdigit():
                out.append((i, j, "card", span_features(text, "card", a, b, before)))
            if 7 <= count <= 15:
                out.append((i, j, "phone", span_features(text, "phone", a, b, before)))
    return out


def best_segments(n: int, segments: list, weights: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """The best labelling of a region by dynamic programming: boundaries and kinds together."""
    ending: dict[int, list] = {}
    for i, j, kind, feats in segments:
        s = sum(weights.get(f, 0.0) for f in feats)
        if s > 0:  # a piece outside all spans scores 0, so a span below never helps
            ending.setdefault(j, []).append((i, kind, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind, s)
    out, j = [], n
    while j > 0:
        if back[j] and best[j] != best[j - 1]:
            i, kind, s = back[j]
            out.append((i, j, kind, s))
            j = i
        else:
            j -= 1
    return out[::-1]


def expectations(n: int, segments: list, weights: dict[str, float]) -> list[float]:
    """The probability of each candidate segment under the field (forward and backward sums)."""
    score = [sum(weights.get(f, 0.0) for f in x[3]) for x in segments]
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, x in enumerate(segments):
        ending.setdefault(x[1], []).append(k)
        starting.setdefault(x[0], []).append(k)
    fore, aft = [0.0] * (n + 1), [0.0] * (n + 1)

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    for j in range(1, n + 1):
        fore[j] = total([fore[j - 1], *(fore[segments[k][0]] + score[k] for k in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        aft[i] = total([aft[i + 1], *(aft[segments[k][1]] + score[k] for k in starting.get(i, ()))])
    return [math.exp(fore[x[0]] + score[k] + aft[x[1]] - fore[n]) for k, x in enumerate(segments)]


def disguised(text: str, spans: list[tuple[str, int, int]], way: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans written as people write them to escape plain patterns."""
    out, at, moved = [], 0, []
    shift = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        span = text[a:b]
        new = span
        if kind == "email":
            new = [span, span.replace("@", " (at) ").replace(".", " (dot) "), span.replace("@", "[at]")][way % 3]
        elif kind == "phone":
            new = [span, span[1:], "00" + span[1:]][way % 3]
        elif kind == "card":
            digits = only_digits(span)
            new = [span, ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits][way % 3]
        elif kind == "ip":
            new = [span, span.replace(".", "[.]"), span][way % 3]
        out += [text[at:a], new]
        moved.append((kind, a + shift, a + shift + len(new)))
        shift += len(new) - len(span)
        at = b
    return "".join(out) + text[at:], moved


def drawn_regions(text: str, most: int, most_pieces: int) -> list[list[tuple[int, int]]]:
    """At most `most` regions of at most `most_pieces` pieces, those with the smallest hashes, in text order."""
    short = [r for r in regions(text) if len(r) <= most_pieces]
    if len(short) <= most:
        return short
    by_hash = sorted(short, key=lambda r: hashlib.sha256(text[r[0][0] : r[-1][1]].encode("utf-8", "replace")).digest())
    return sorted(by_hash[:most])


def fit(texts: list[str], rounds: int = 12, most_regions: int = TRAINING_REGIONS,
        most_pieces: int = TRAINING_PIECES) -> dict[str, float]:
    """Weights of the field by stochastic gradient of its likelihood; the base spans, also disguised, are the truth.

    Of each text, in each of its three ways of writing, at most `most_regions` regions of at most
    `most_pieces` pieces count, chosen by the hash of their characters.
    """
    cases = []
    for text in texts:
        spans = base_spans(text)
        for way in range(3):
            changed, truth = disguised(text, spans, way)
            wanted = {(a, b): kind for kind, a, b in truth}
            for pieces in drawn_regions(changed, most_regions, most_pieces):
                segments = candidates(changed, pieces)
                gold = [wanted.get((pieces[i][0], pieces[j - 1][1])) == kind for i, j, kind, _ in segments]
                if segments:
                    cases.append((len(pieces), segments, gold))
    weights: dict[str, float] = {f"{k}:any": -2.0 for k in KINDS}
    squares: dict[str, float] = {}
    order = np.random.default_rng(5)
    for _ in range(rounds):
        for c in order.permutation(len(cases)):
            n, segments, gold = cases[c]
            slope: dict[str, float] = {}
            for p, y, x in zip(expectations(n, segments, weights), gold, segments, strict=True):
                if abs(y - p) > 1e-3:
                    for f in x[3]:
                        slope[f] = slope.get(f, 0.0) + y - p
            for f, g in slope.items():
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(1e-2 + squares[f])
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans that the field finds where no base span lies."""
    taken = sorted((a, b) for _, a, b in base)
    found: set[tuple[str, int, int]] = set()
    for pieces in regions(text):
        for i, j, kind, s in best_segments(len(pieces), candidates(text, pieces), weights):
            a, b = pieces[i][0], pieces[j - 1][1]
            if s >= MARGIN and all(b <= x or y <= a for x, y in taken):
                found.add((kind, a, b))
                taken.append((a, b))
    return sorted(found)


def all_spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    base = base_spans(text)
    extra = added_spans(text, base, weights) if weights else []
    return base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))


def kinds_of(documents: DataFrame) -> DataFrame:
    """doc_id and the kinds (a bit each) of its base spans, for the documents that hold any; null ids are left out."""

    def run(texts: list) -> list:
        found = [{s[0] for s in base_spans(text)} for text in texts]
        return [[sum(1 << i for i, kind in enumerate(KINDS) if kind in f) for f in found]]

    docs = pick(documents, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(MAY_HOLD))
    held = per_text(docs, run, "kinds int").where("kinds > 0")
    return held.groupBy("doc_id").agg(F.bit_or("kinds").alias("kinds"))


def trained(documents: DataFrame, rows: int = TRAINING_ROWS, most_chars: int = TRAINING_CHARS) -> dict[str, float]:
    """Weights fitted on at most `rows` documents with base spans, the same in every run.

    Texts of over `most_chars` characters are not drawn.
    Documents are drawn by the hash of their id: for each kind as many as its even share of `rows`
    that hold a span of it, then any with base spans until there are `rows`.
    """
    docs = pick(documents, "doc_id", "text").where(F.char_length("text") <= most_chars)
    held = staged(kinds_of(docs), "pii_kinds")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    shares = [(held.where(F.col("kinds").bitwiseAND(1 << i) > 0), rows // len(KINDS)) for i in range(len(KINDS))]
    drawn: dict = {}
    for some, most in [*shares, (held, rows)]:
        for r in some.select("doc_id").orderBy(*by_hash).limit(most).collect():
            if len(drawn) < rows:
                drawn.setdefault(r["doc_id"], r)
    ids = documents.sparkSession.createDataFrame(list(drawn.values()), held.select("doc_id").schema)
    got = docs.join(F.broadcast(ids), "doc_id").collect()  # at most `rows` ids are broadcast
    texts = sorted({r["text"] for r in got if r["text"]})
    return fit([t for t in texts if base_spans(t)])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """documents (doc_id, text) with counts of the base spans, their digest and all spans.

    Base spans come from the fixed patterns and always stay. The field adds spans that overlap no
    base span; its weights are fitted on a bounded sample of the documents unless given. Spans are
    kind:start:end in code points, by kind, then start. Null texts are empty: counts 0, spans
    empty. Repeated rows each get their row, null ids too; an empty table gives no rows. Whole
    texts are read; no shuffle of texts.
    """
    weights = trained(documents) if weights is None else weights

    def run(texts: list) -> list:
        columns: list[list] = [[] for _ in range(6)]
        for text in texts:
            base, every = all_spans(text or "", weights)
            for i, kind in enumerate(KINDS):
                columns[i].append(sum(s[0] == kind for s in base))
            columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            columns[5].append(joined(every))
        return columns

    return per_text(pick(documents, "doc_id", "text"), run,
                    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, weights: dict[str, float]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are masked as one, of the longest one's kind."""
    _, spans = all_spans(text, weights)
    if not spans:
        return text
    parts: list[list] = []  # start, end, length of the longest span, its kind
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not parts or a >= parts[-1][1]:
            parts.append([a, b, b - a, kind])
            continue
        last = parts[-1]
        last[1] = max(last[1], b)
        if b - a > last[2]:
            last[2:] = b - a, kind
    out, at = [], 0
    for a, b, _, kind in parts:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def mask(documents: DataFrame) -> DataFrame:
    """The documents with all spans masked in text, and n_chars, where there is one, brought up to date.

    Rows and other columns stay, whatever their names; so do null texts and the n_chars beside them. Repeated rows are
    masked alike, an empty table gives no rows.
    """
    weights = trained(documents)

    def run(texts: list) -> list:
        return [[None if t is None else masked(t, weights) for t in texts]]

    made = per_text(wrapped(documents, "text"), run, "masked string").withColumnRenamed("masked", "text")
    whole = unwrapped(made, documents, "text")
    if "n_chars" not in documents.columns:
        return whole
    at, n_chars = documents.columns.index("n_chars"), documents.schema["n_chars"]
    parts = whole.toDF(*[f"_{i}" for i in range(len(whole.columns))])
    text = F.col(f"_{documents.columns.index('text')}")
    counted = F.when(text.isNull(), F.col(f"_{at}")).otherwise(F.char_length(text)).cast(n_chars.dataType)
    return parts.select(*[(counted if i == at else F.col(f"_{i}")).alias(c) for i, c in enumerate(documents.columns)])
