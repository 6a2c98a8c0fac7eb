"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_texts, fold_of, held_out, per_text, pick, unwrapped, wrapped

#: Labelled rows that the lexicon and the final weights are learned from, at most.
TRAINING_ROWS = 20_000
#: A word or word beginning enters the lexicon if this many toxic training texts hold it ...
LEAST_TOXIC_TEXTS = 6
#: ... and if at least this share of the training texts with it are toxic.
LEAST_TOXIC_SHARE = 0.6
#: Lengths of word beginnings in the lexicon, for inflected and compounded forms.
STEMS = (6, 5, 4)
#: Words whose class a task remembers before it starts anew.
REMEMBERED_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+")
PIECES = re.compile(r"[^\W\d_]+|[.!?;:,|()\n]")
BREAKS = frozenset(".!?;:,|()\n")

# Fixed function words of the grammar.
TARGETS = frozenset(
    "you your yours yourself you're u ya they them their he she him her tu te toi vous votre vos ton ta du dich dir dein "
    "deine euch euer ihr sie usted ustedes vosotros tú ti vuestro".split()
)
NEGATIONS = frozenset(
    "not no never neither nor without isn't aren't don't ne pas jamais aucun sans ni nicht kein keine keinen nie niemals "
    "ohne nunca jamás sin tampoco ningún ninguna".split()
)
REPORTS = frozenset(
    "said says say claimed claims wrote called reported quoted alleged allegedly told stated dit disait selon écrit "
    "affirme sagte sagt behauptet schrieb nannte laut dijo dice según escribió llamó afirma".split()
)
THREATS = frozenset(
    "kill murder hurt destroy strangle stab shoot burn beat crush tuer frapper détruire brûler écraser töten umbringen "
    "schlagen vernichten verbrennen matar golpear destruir quemar aplastar".split()
)
#: Input symbols of the transducers.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = range(6)
#: Numbers that a text is scored by.
FEATURES = 6
#: Weight of a threat before the transducers act on it.
THREAT_WEIGHT = 3.0


class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (next state, factor); state 0 starts.

    The factor weighs what the symbol itself is worth.
    """

    def __init__(self, arcs: list[list[tuple[int, float]]]):
        self.arcs = arcs

    def composed(self, other: Transducer) -> Transducer:
        """Both at once: states are the pairs that can be reached, factors multiply."""
        pairs, arcs = {(0, 0): 0}, []
        todo = [(0, 0)]
        for a, b in todo:
            row = []
            for s in SYMBOLS:
                (x, p), (y, q) = self.arcs[a][s], other.arcs[b][s]
                if (x, y) not in pairs:
                    pairs[x, y] = len(pairs)
                    todo.append((x, y))
                row.append((pairs[x, y], p * q))
            arcs.append(row)
        return Transducer(arcs)

    def factors(self, clause: list[tuple[int, float]]) -> list[float]:
        """What the transducer makes of each symbol."""
        state, out = 0, []
        for symbol, _ in clause:
            state, factor = self.arcs[state][symbol]
            out.append(factor)
        return out

    def score(self, clause: list[tuple[int, float]]) -> float:
        return sum(f * w for f, (_, w) in zip(self.factors(clause), clause, strict=True))


def after(cue: int, reach: int, factors: dict[int, float], plain: dict[int, float] | None = None) -> Transducer:
    """Symbols in factors are weighed by them up to `reach` symbols after the cue, else by plain (1 where missing)."""
    plain = plain or {}
    arcs = []
    for left in range(reach + 1):
        row = []
        for s in SYMBOLS:
            then = reach if s == cue else max(0, left - 1)
            row.append((then, factors.get(s, 1.0) if left else plain.get(s, 1.0)))
        arcs.append(row)
    return Transducer(arcs)


def again(symbol: int, factor: float) -> Transducer:
    """The second and every later such symbol of a clause counts times factor."""
    plain = [(1 if s == symbol else 0, 1.0) for s in SYMBOLS]
    later = [(1, factor if s == symbol else 1.0) for s in SYMBOLS]
    return Transducer([plain, later])


FAR = 40
#: What a transducer that lets nothing through does to what is weighed.
SILENT = {INSULT: 0.0, THREAT: 0.0}
#: Insults weigh more when they pile up.
PILED = again(INSULT, 1.25)
NEAR_NEGATION, ELSEWHERE = after(NEGATION, 3, {}, SILENT), after(NEGATION, 3, SILENT)
#: Three grammars, composed from the same parts: what is said openly, denied, or reported of others. What each is worth is learned.
GRAMMARS = (
    PILED.composed(ELSEWHERE).composed(after(REPORT, FAR, SILENT)),
    PILED.composed(NEAR_NEGATION),
    PILED.composed(ELSEWHERE).composed(after(REPORT, FAR, {}, SILENT)),
)
#: Insults weigh more near a target, threats need one. A target may stand on either side.
AIMED = after(TARGET, 6, {INSULT: 1.3}).composed(after(TARGET, 6, {}, {THREAT: 0.0}))


def clause_scores(clause: list[tuple[int, float]]) -> list[float]:
    """What the clause holds openly, denied and reported."""
    aimed = [*map(max, AIMED.factors(clause), AIMED.factors(clause[::-1])[::-1])]
    return [sum(f * a * w for f, a, (_, w) in zip(grammar.factors(clause), aimed, clause, strict=True)) for grammar in GRAMMARS]


def symbol_of(word: str, lexicon: dict[str, float]) -> tuple[int, float]:
    """The symbol and weight of a lower-case word: the lexicon's whole word, else its longest known beginning."""
    weight = lexicon.get(word)
    if weight is None:
        for n in STEMS:
            if len(word) > n and (weight := lexicon.get(word[:n] + "*")) is not None:
                break
    if weight is not None:
        return INSULT, weight
    if word in THREATS:
        return THREAT, THREAT_WEIGHT
    if word in TARGETS:
        return TARGET, 0.0
    if word in NEGATIONS:
        return NEGATION, 0.0
    return (REPORT, 0.0) if word in REPORTS else (OTHER, 0.0)


class Scorer:
    """Features of whole texts: what the grammar finds in their clauses."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.symbols: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.symbols.get(word)
        if found is None:
            if len(self.symbols) >= REMEMBERED_WORDS:
                self.symbols.clear()
            found = self.symbols[word] = symbol_of(word, self.lexicon)
        return found

    def features(self, text: str | None) -> tuple[float, ...]:
        """Of what is said openly: sum over clauses, best clause, sum per 100 words, matched clauses; then the sums of
        what is denied and of what is reported (logarithms but for the best)."""
        text = (text or "").lower()
        words = WORD.findall(text)
        if not any(self.symbol(w)[0] in (INSULT, THREAT) for w in set(words)):
            return (0.0,) * FEATURES
        total = best = denied = reported = 0.0
        matched = 0
        clause: list[tuple[int, float]] = []
        for piece in [*PIECES.findall(text), "."]:
            if piece not in BREAKS:
                clause.append(self.symbol(piece))
                continue
            if any(s in (INSULT, THREAT) for s, _ in clause):
                worth, not_so, told = clause_scores(clause)
                total += worth
                denied += not_so
                reported += told
                best = max(best, worth)
                matched += worth > 0
            clause = []
        logs = np.log1p([total, 100 * total / max(1, len(words)), matched, denied, reported]).tolist()
        return logs[0], best, *logs[1:]


def entries(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def lexicon_of(counts: list[tuple[str, int, int]], n_bad: int, n_good: int) -> dict[str, float]:
    """Words and beginnings that toxic texts hold far more often than others, with their log odds.

    counts has each entry with the number of toxic and of other texts that hold it.
    """
    known = {}
    for entry, bad, good in counts:
        if bad >= LEAST_TOXIC_TEXTS and bad >= LEAST_TOXIC_SHARE * (bad + good):
            odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
            known[entry] = float(max(0.0, min(6.0, odds)))
    return known


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with an intercept in front, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def entry_counts(sample: DataFrame) -> list:
    """For each entry that may be in a lexicon, the texts with it by half (0, 1) and label: bad0, good0, bad1, good1.

    Counted where the texts are; what comes back is held by LEAST_TOXIC_TEXTS of the toxic texts at least.
    """
    def run(texts: list) -> list:
        return [[sorted(entries(t)) for t in texts]]

    held = per_text(sample.select("half", "toxic", "text"), run, "entries array<string>")
    each = held.select("half", "toxic", F.explode("entries").alias("entry"))
    counted = each.groupBy("entry").agg(*[
        F.count_if((F.col("half") == h) & (F.col("toxic") == y)).alias(f"{name}{h}") for h in (0, 1) for name, y in (("bad", 1), ("good", 0))])
    bad, all_ = F.col("bad0") + F.col("bad1"), F.col("bad0") + F.col("bad1") + F.col("good0") + F.col("good1")
    halves = [(F.col(f"bad{h}"), F.col(f"bad{h}") + F.col(f"good{h}")) for h in (0, 1)]
    some = F.lit(False)
    for toxic, texts in [(bad, all_), *halves]:
        some = some | ((toxic >= LEAST_TOXIC_TEXTS) & (toxic >= LEAST_TOXIC_SHARE * texts))
    return counted.where(some).orderBy("entry").collect()


def learn(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon of all texts of a sample (text, toxic 0 or 1), and final weights fitted on texts that did not shape
    the lexicon used for them. Equal texts count once. Only counts and features leave the executors."""
    once = sample.groupBy("text").agg(F.min_by("toxic", F.struct("doc_id")).alias("toxic"))
    once = once.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    sizes = {(r["half"], r["toxic"]): r["n"] for r in once.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n = {y: [sizes.get((h, y), 0) for h in (0, 1)] for y in (0, 1)}
    if not sum(n[0]) or not sum(n[1]):
        return {}, np.array([-4.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.0])
    counts = entry_counts(once)
    whole = lexicon_of([(r["entry"], r["bad0"] + r["bad1"], r["good0"] + r["good1"]) for r in counts], sum(n[1]), sum(n[0]))
    others = [lexicon_of([(r["entry"], r[f"bad{1 - h}"], r[f"good{1 - h}"]) for r in counts], n[1][1 - h], n[0][1 - h]) for h in (0, 1)]
    rows = []
    for h in (0, 1):
        x = per_text(once.where(F.col("half") == h).select("toxic", "text"), features_by(others[h]), "x array<double>")
        rows += [(*r["x"], r["toxic"]) for r in x.collect()]
    rows = np.array(sorted(rows))
    return whole, logistic(rows[:, :-1], rows[:, -1])


def features_by(lexicon: dict[str, float]):
    scorers: list[Scorer] = []

    def run(texts: list) -> list:
        if not scorers:
            scorers.append(Scorer(lexicon))
        return [[list(scorers[0].features(t)) for t in texts]]

    return run


def trained(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAINING_ROWS):
    docs = pick(documents, "doc_id", "text")
    usable = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != fold))
    return learn(drawn_texts(docs, usable.withColumn("toxic", (F.col("toxic") == 1).cast("int")), rows))


def score(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAINING_ROWS) -> DataFrame:
    """documents (doc_id, text) with held_out, score, predicted and the number of matched clauses.

    Learns from at most `rows` labelled rows outside the held-out fold; labels is (doc_id, toxic).
    Without labels of both kinds only the fixed threat words count. Null and empty texts score
    like any text without a match. Null ids are never held out nor learned from; of several labels
    of one id the smallest counts; repeated rows each get their row; an empty table gives no rows.
    Whole texts are read. The lexicon sent to the tasks holds entries of at least LEAST_TOXIC_TEXTS of the
    sample's toxic texts, so the sample bounds it. No shuffle of texts but the sample's.
    """
    lexicon, weights = trained(documents, labels, folds, fold, rows)
    docs = pick(documents, "doc_id", "text")
    return rated(docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text"), lexicon, weights,
                 "score double, predicted int, n_clauses bigint")


def rated(rows: DataFrame, lexicon: dict[str, float], weights: np.ndarray, fields: str, keep_text: bool = False) -> DataFrame:
    scorers: list[Scorer] = []

    def run(texts: list) -> list:
        if not scorers:
            scorers.append(Scorer(lexicon))
        x = np.array([scorers[0].features(t) for t in texts]).reshape(-1, FEATURES)
        p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
        return [p, (p >= 0.5).astype(np.int32), np.rint(np.expm1(x[:, 3])).astype(np.int64)]

    return per_text(rows, run, fields, keep_text=keep_text)


def harmless(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; all columns stay, whatever their names.

    Rows with null or empty texts stay, repeated rows share their fate; an empty table gives no rows.
    """
    lexicon, weights = trained(documents, labels)
    marked = rated(wrapped(documents, "text"), lexicon, weights, "score double, toxic int, clauses bigint", keep_text=True)
    return unwrapped(marked.where("toxic = 0"), documents, "text")
