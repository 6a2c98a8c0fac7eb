"""Learned operators: accuracy on the held-out fold, marginals of the mix, whole pipeline."""

import random
import re

import numpy as np
import pytest
from plain import SF, contaminated, near, personal
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import langid, mixing, quality, toxicity
from millrace.llm.queries import QUERIES
from millrace.session import staged

LARGER = "/root/testdata/sf0.1"


def held(spark, name, column):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = QUERIES[name](spark, LARGER).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(column).alias("y")).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return rows


def test_toxicity_held_out(spark):
    rows = held(spark, "op1_toxicity", "toxic")
    right = sum(r["predicted"] == r["y"] for r in rows)
    assert right >= 0.95 * len(rows)


def test_quality_held_out(spark):
    rows = held(spark, "op9_quality_classifier", "quality")
    assert sum(r["predicted"] == r["y"] for r in rows) >= 0.94 * len(rows)
    assert sum(r["predicted"] for r in rows if r["y"]) >= 0.98 * sum(r["y"] for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, LARGER).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)


def test_clauses_are_scored_not_words():
    scorer = toxicity.Scorer({"idiot": 3.0, "clown": 2.0})
    plain, aimed, denied, told = (scorer.features(t)[1] for t in (
        "what an idiot here.", "you are an idiot.", "you are not an idiot.", "he said idiot."))
    assert denied < plain < aimed and told < plain
    assert scorer.features("kill the process.")[1] == 0 < scorer.features("i will kill you.")[1]
    assert scorer.features("idiot clown.")[1] > scorer.features("idiot. clown.")[1]


def test_composition_multiplies():
    a, b = toxicity.after(toxicity.TARGET, 2, {toxicity.INSULT: 2.0}), toxicity.after(toxicity.NEGATION, 1, {toxicity.INSULT: 0.5})
    clause = [(toxicity.TARGET, 0.0), (toxicity.NEGATION, 0.0), (toxicity.INSULT, 4.0)]
    assert a.score(clause) == 8 and b.score(clause) == 2 and a.composed(b).score(clause) == 4


def told_and_denied(rng, n):
    """Documents whose insults are open (toxic), denied or reported (not toxic), or that have none."""
    plain = lambda: " ".join(rng.choice(["stone", "water", "light", "the", "of", "green", "walk"]) for _ in range(rng.randrange(6, 14)))
    rows = []
    for i in range(n):
        bad = rng.choice(["idiot", "clown", "moron"])
        kind = i % 4
        clause = [f"you {bad}", f"you are not an {bad}", f"they said you are an {bad}", "you there"][kind]
        rows.append((i, ". ".join([plain(), clause, plain()]) + ".", int(kind == 0)))
    return rows


def test_denied_and_reported_clauses_flip_documents(spark, monkeypatch):
    """The grammar decides whole documents; without it the same words decide, and much worse."""
    rng = random.Random(5)
    rows = told_and_denied(rng, 400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    truth = {i: y for i, _, y in rows}

    def right():
        got = toxicity.score(docs, labels).where("held_out").collect()
        return sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got), {r["doc_id"]: r["predicted"] for r in got}

    monkeypatch.setattr(toxicity, "LEAST_TOXIC_SHARE", 0.2)
    with_grammar, said = right()
    assert with_grammar >= 0.97 and {said[i] for i in said if i % 4 == 1} == {0} == {said[i] for i in said if i % 4 == 2}
    everything = toxicity.PILED
    nothing = toxicity.PILED.composed(toxicity.after(toxicity.NEGATION, 1, toxicity.SILENT, toxicity.SILENT))
    # The same words through transducers that neither deny nor report.
    lexicon, weights = {"idiot": 3.0, "clown": 3.0, "moron": 3.0}, None
    assert toxicity.Scorer(lexicon).features(rows[1][1])[0] == 0 < toxicity.Scorer(lexicon).features(rows[0][1])[0]
    monkeypatch.setattr(toxicity, "GRAMMARS", (everything, nothing, nothing))
    x = np.array([toxicity.Scorer(lexicon).features(t) for _, t, _ in rows])
    y = np.array([y for _, _, y in rows], float)
    weights = toxicity.logistic(x, y)
    flat = ((weights[0] + x @ weights[1:] > 0) == y).mean()
    assert flat < with_grammar - 0.1


def test_toxicity_against_plain_automata(spark):
    """Scores of the small documents against a walk over the grammar's rules without transducers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lexicon, weights = toxicity.trained(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    for r in docs.collect():
        x = plain_features((r["text"] or "").lower(), lexicon)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))) < 1e-9


def plain_features(text, lexicon):
    n_words = max(1, len(toxicity.WORD.findall(text)))
    sums, best, matched = np.zeros(3), 0.0, 0
    for clause in re.split(r"[.!?;:,|()\n]", text):
        symbols = [toxicity.symbol_of(w, lexicon) for w in toxicity.WORD.findall(clause)]
        worth = np.zeros(3)
        insults = 0
        for i, (s, w) in enumerate(symbols):
            if s not in (toxicity.INSULT, toxicity.THREAT):
                continue
            near = [t for t, _ in symbols[max(0, i - 6) : i] + symbols[i + 1 : i + 7]]
            aimed = toxicity.TARGET in near
            if s == toxicity.INSULT:
                w = w * (1.25 if insults else 1) * (1.3 if aimed else 1)
                insults += 1
            elif not aimed:
                w = 0
            denied = toxicity.NEGATION in [t for t, _ in symbols[max(0, i - 3) : i]]
            told = toxicity.REPORT in [t for t, _ in symbols[max(0, i - toxicity.FAR) : i]]
            worth[1 if denied else 2 if told else 0] += w
        sums += worth
        best, matched = max(best, worth[0]), matched + (worth[0] > 0)
    total = sums[0]
    return np.array([np.log1p(total), best, np.log1p(100 * total / n_words), np.log1p(matched), *np.log1p(sums[1:])])


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    positive = rng.normal(1.5, 1, (1200, 4))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (900, 4)), rng.normal(-1.5, 1, (2100, 4))])
    prior = quality.class_prior(positive, unlabelled[rng.permutation(3000)])
    assert 0.2 < prior < 0.45
    net = quality.fit(positive, unlabelled, prior)
    assert (net.margin(rng.normal(1.5, 1, (500, 4))) > 0).mean() > 0.95
    assert (net.margin(rng.normal(-1.5, 1, (500, 4))) < 0).mean() > 0.95


def test_letter_vectors_are_nearly_orthogonal():
    v = langid.letter_vectors(np.arange(97, 123))
    cosines = v @ v.T / langid.DIMENSIONS
    assert np.abs(cosines - np.eye(26)).max() < 0.25
    assert set(np.unique(v)) == {-1.0, 1.0}


def test_margins_are_met(spark):
    cells = spark.createDataFrame([(f"=s{i}", f"=l{j}", f"=t{k}", 1 + 7 * i + 3 * j * k) for i in range(3) for j in range(2) for k in range(2)],
                                  "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"l0": 0.6, "l1": 0.4}, "topic": {"t0": 0.5, "t1": 0.5}}
    raked = mixing.raked(cells, mixing.FLATTEN, targets)
    total = raked.agg(F.sum("tokens")).first()[0]
    for m, shares in targets.items():
        for r in raked.groupBy(m).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] / total - shares[r[m][1:]]) < 1e-3
    chosen = mixing.calibrated(raked, 0.25)
    expected = chosen.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert 0.24 * total < expected < 0.28 * total


def test_mix_is_the_same_each_time(spark):
    one, two = (QUERIES["op6_mixing_sources"](spark, SF).orderBy("doc_id").collect() for _ in range(2))
    assert one == two and 0 < sum(r["kept"] for r in one) < len(one)


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage on the small documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_pipeline_stages(spark, stages):
    given, calm, single, clean, masked, mixed = stages
    assert {r["doc_id"] for r in calm} <= {r["doc_id"] for r in given}
    groups = near([(r["doc_id"], r["text"]) for r in calm])
    assert {r["doc_id"] for r in single} == {i for i, (_, c) in groups.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = [h for _, h, _ in contaminated([r["text"] for r in single], items)]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r, h in zip(single, hit, strict=True) if not h}
    assert {r["doc_id"] for r in masked} == {r["doc_id"] for r in clean}
    assert not any(personal(r["text"]) for r in masked) and all(r["n_chars"] == len(r["text"]) for r in masked)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked} and mixed


def test_pipeline_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*stages[0][0].__fields__, "mix_weight"]
    assert all(rows[0].__fields__ == stages[0][0].__fields__ for rows in stages[1:-1])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stages[-1]))
