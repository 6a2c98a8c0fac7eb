"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_texts, fold_of, held_out, per_text, pick

#: Rows used for training, at most: half trusted positives, half unlabelled web text.
TRAINING_ROWS = 16_000
#: Buckets for pairs of neighbouring bytes.
PAIR_BUCKETS = 256
#: Numbers that shape() gives.
SHAPES = 24
#: Hidden units, passes over the unlabelled rows and rows of a step of the fit. More passes overfit small samples.
HIDDEN, PASSES, STEP_ROWS = 24, 30, 512

WORD = re.compile(r"\w+")
END = re.compile(r"[.!?]")


def shape(text: str) -> list[float]:
    """Shares and lengths of a whole text that tell prose from menus, junk and repetition."""
    n = len(text)
    if not n:
        return [0.0] * SHAPES
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    bare = WORD.findall(text)
    letters = sum(map(len, bare))
    ends = len(END.findall(text))
    line_words = [x.count(" ") + 1 for x in lines] or [0]
    word_count = max(1, len(words))
    long_share = sum(len(x) > 12 for x in words) / word_count
    short_lines = sum(x < 4 for x in line_words) / max(1, len(lines))
    starts = sum(x[0].isupper() for x in words) / word_count
    digits = sum(map(text.count, "0123456789")) / n
    return [
        np.log1p(n), np.log1p(len(words)), n / word_count, letters / n, digits, long_share, starts, short_lines,
        len(set(words)) / word_count, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)),
        np.log1p(float(np.mean(line_words))), ends / word_count, text.count(",") / word_count, text.count("|") / word_count,
        sum(map(text.count, "#$%&*@<>{}[]_=+~^\\")) / n, sum(map(text.count, "\"'()-:;/")) / n,
        sum(len(x) == 1 for x in words) / word_count, len(text.encode("utf-8", "replace")) / n - 1,
        max(map(len, words), default=0) / n, float(ends == 0), float(len(words) < 20),
        sum(map(eq, words[1:], words)) / word_count, len(set(zip(words, words[1:]))) / word_count,
    ]


def pairs(text: str) -> np.ndarray:
    """Shares of hashed pairs of neighbouring bytes, as square roots."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 2:
        return np.zeros(PAIR_BUCKETS)
    code = (raw[:-1] * np.uint32(257) + raw[1:]) * np.uint32(2654435761) >> np.uint32(24)
    return np.sqrt(np.bincount(code % PAIR_BUCKETS, minlength=PAIR_BUCKETS) / (len(raw) - 1))


def features(texts: list) -> np.ndarray:
    texts = ["" if t is None else t for t in texts]
    if not texts:
        return np.zeros((0, SHAPES + PAIR_BUCKETS), np.float32)
    return np.array([np.concatenate([shape(t), pairs(t)]) for t in texts], np.float32)


class Network:
    """A small network with one hidden layer; its output is the margin for the positive class."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def hidden(self, x):
        a, b, _, _ = self.weights
        return np.maximum(x @ a + b, 0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return self.hidden(x) @ self.weights[2] + self.weights[3][0]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Minimise the non-negative unbiased risk; without a prior, plain positives against unlabelled.

    The risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss l.
    Where the second part falls below zero on a step, the step undoes the overfit instead.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-4, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    d = p.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    net = Network(mean, scale, w)
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for turn in range(PASSES):
        order = rng.permutation(len(u))
        rate = 3e-3 * (1 - turn / PASSES) + 1e-4
        for at in range(0, len(u), STEP_ROWS):
            xu, xp = u[order[at : at + STEP_ROWS]], p[rng.integers(0, len(p), STEP_ROWS)]
            hu, hp = net.hidden(xu), net.hidden(xp)
            gu, gp = hu @ w[2] + w[3][0], hp @ w[2] + w[3][0]
            up, un = sigmoid(gu) / len(gu), -sigmoid(-gp) / len(gp)  # slopes of l(-g) on u and of l(g) on p
            if prior is None:
                su, sp = up, un
            else:
                back = sigmoid(gp) / len(gp)  # slope of l(-g) on p
                rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                su, sp = (up, prior * un - prior * back) if rest >= 0 else (-up, prior * back)
            grads = [0, 0, hu.T @ su + hp.T @ sp, np.array([su.sum() + sp.sum()])]
            du, dp = np.outer(su, w[2]) * (hu > 0), np.outer(sp, w[2]) * (hp > 0)
            grads[0], grads[1] = xu.T @ du + xp.T @ dp, du.sum(0) + dp.sum(0)
            t += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, lower: bool = False) -> float:
    """The share of positives among the unlabelled, by the best bin.

    A classifier of positives against unlabelled ranks rows. Above any threshold, the share of the
    unlabelled over the share of positives bounds the prior from above; the least bound counts,
    each widened by its sampling error. As it bounds from above, and a prior that is too large calls
    negatives positive, its `lower` side is less the sampling error. Both sides are rows that the classifier was not
    fitted on.
    """
    cut_p, cut_u = len(positive) // 2, len(unlabelled) // 2
    net = fit(positive[:cut_p], unlabelled[:cut_u], None)
    p, u = np.sort(net.margin(positive[cut_p:])), np.sort(net.margin(unlabelled[cut_u:]))
    best, found = np.inf, 1.0
    for at in np.quantile(p, np.linspace(0, 0.9, 91)):
        share_p, share_u = (p >= at).mean(), (u >= at).mean()
        error = np.sqrt(np.log(40) / (2 * len(p))) + np.sqrt(np.log(40) / (2 * len(u)))
        if (share_u + error) / share_p < best:
            best, found = (share_u + error) / share_p, (share_u - error * lower) / share_p
    return float(np.clip(found, 0.02, 0.98))


def learn(trusted: np.ndarray, pool: np.ndarray) -> tuple[Network | None, float]:
    """The fitted network and the estimated prior, from features of trusted positives and of unlabelled rows; no network
    without enough of either."""
    if len(trusted) < 4 or len(pool) < 4:
        return None, 0.5
    rng = np.random.default_rng(3)
    p, u = (y[rng.permutation(len(y))] for y in (trusted, pool))
    prior = class_prior(p, u, lower=True)
    return fit(p, u, prior), prior


def featured(sample: DataFrame) -> np.ndarray:
    """The features of a sample's texts, computed where the texts are; only these numbers reach the driver."""

    def run(texts: list) -> list:
        return [[x.tobytes() for x in features(texts)]]

    rows = per_text(sample.select("doc_id", "text"), run, "x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).reshape(len(rows), SHAPES + PAIR_BUCKETS)


def trained(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAINING_ROWS):
    """Half of the rows are trusted positives, half are drawn from all documents without a look at labels."""
    docs = pick(documents, "doc_id", "text")
    outside = fold_of(F.col("doc_id"), folds) != fold
    good = pick(labels, "doc_id", "quality").where((F.col("quality") == 1) & outside).select("doc_id")
    return learn(featured(drawn_texts(docs, good, rows // 2)), featured(drawn_texts(docs, docs.select("doc_id").where(outside), rows // 2)))


def score(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAINING_ROWS,
          threshold: float = 0.3) -> DataFrame:
    """documents (doc_id, text) with held_out, score and predicted (score >= threshold).

    Learns from at most `rows` documents outside the held-out fold, half of them trusted positives, the other
    half drawn by hash from all documents, labelled or not; labels is (doc_id, quality).
    Only quality 1 is used as a label; negatives are never looked at. With too few positives every
    score is 0.5. Null texts score as empty ones. Null ids are never held out nor learned from;
    of several labels of one id the smallest counts; repeated rows each get their row; an empty
    table gives no rows. Whole texts are read; no shuffle of texts.
    """
    net, _ = trained(documents, labels, folds, fold, rows)

    def run(texts: list) -> list:
        p = sigmoid(net.margin(features(texts))).astype(float) if net else np.full(len(texts), 0.5)
        return [p, (p >= threshold).astype(np.int32)]

    docs = pick(documents, "doc_id", "text")
    return per_text(docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text"), run,
                    "score double, predicted int")
