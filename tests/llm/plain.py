"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, **more):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def roots(parent):
    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    return {a: find(a) for a in parent}


def near(rows):
    """doc_id -> (set size, component) for rows of (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = roots(parent)[a], roots(parent)[b]
                parent[max(x, y)] = min(x, y)
    found = roots(parent)
    return {i: (len(sets[i]), found[i]) for i in sets}


def repeats(texts, span=200):
    """(bytes, removed, spans, digest) for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        end = 0
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                for j in range(max(i, end), i + span):
                    gone[j] = True
                end = i + span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contaminated(texts, items, window=10):
    """(words, words hit, ids of items) for each text; items are (id, text)."""
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for at in range(len(w) - n + 1) if n else ():
            grams[tuple(w[at : at + n])].add(i)
    lengths = {len(g) for g in grams}
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (g := tuple(w[at : at + n])) in grams:
                    hit.update(range(at, at + n))
                    ids |= grams[g]
        out.append((len(w), len(hit), ids))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out
