"""Conversation repair, source divergence and token files against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from plain import SF, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import auction, conversations, divergence, tokens, wavelet
from millrace.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# ---------------------------------------------------------------- conversations


def plain_repair(rows):
    """Faults and cheapest edits of one conversation, by trying all edits; rows are (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def take(cost, letter, line, rest):
            if rest is not None:
                ways.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))

        if inserts < 2:
            name = {"u": "user", "a": "assistant"}[follow[state]]
            take(3, "I", name + ":", best(i, follow[state], inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            take(4, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                extra = 3 if faults[i] == "t" else 0
                to = role[:1]
                if to == follow[state] or to == "s" and state == "":
                    take(extra, "K", f"{role}:{text}", best(i + 1, to, 0))
                name = {"u": "user", "a": "assistant"}[follow[state]]
                take(3 + extra, "R", f"{name}:{text}", best(i + 1, follow[state], 0))
        return min(ways, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some_messages(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "umpire", " "]
    texts = ["yes.", "no!", "well", "", " \n", "why? ", "so\x0b", "é.", "x" * 50 + "."]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.3 else i, rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts) + rng.choice(["", f"{rng.randrange(4)}."]))
            for i in range(n)]


@pytest.mark.parametrize("run_rows", [4096, 2])
def test_repair_against_all_edits(spark, monkeypatch, run_rows):
    monkeypatch.setattr(conversations, "RUN_ROWS", run_rows)
    rng = random.Random(11)
    talks = {i: some_messages(rng, rng.randrange(1, 9)) for i in range(150)} | {None: some_messages(rng, 40), 999: some_messages(rng, 60)}
    rows = [(c, t, r, x, rng.choice([1, 1, 1, 2, 3])) for c, talk in talks.items() for t, r, x in talk]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies bigint").repartition(3)).collect()
    assert len(got) == len(talks)
    for r in got:
        whole = [(t, role, x) for c, t, role, x, n in rows if c == r["conv_id"] for _ in range(n)]
        assert tuple(r)[1:] == plain_repair(whole), r["conv_id"]


def test_a_long_conversation_in_many_tasks(spark):
    rng = random.Random(2)
    one = [(7, i, rng.choice(["user", "assistant"]), f"{rng.randrange(10**6)}" + rng.choice([".", ".", ""]), 1) for i in range(1500)]
    same = [(8, None, "user", "again.", 1)] * 3000
    frame = spark.createDataFrame(one + same, "conv_id bigint, turn bigint, role string, text string, copies bigint")
    parts = conversations.shape("part int")
    spread = conversations.judged(frame).repartitionByRange(4, "conv_id", "turn").mapInArrow(
        conversations.streaming(lambda b: iter([(conversations.TaskContext.get().partitionId(),)] if any(x.num_rows for x in b) else []), parts, 9), parts)
    assert spread.distinct().count() > 1
    got = {r["conv_id"]: r for r in conversations.repair(frame).collect()}
    assert got[8]["audit"] == "K" + "D" * 2999 + "I" and got[8]["cost"] == 4 * 2999 + 3
    assert tuple(got[7])[1:6] == plain_faults([r[1:4] for r in one])
    # The cost by plain steps from the end, over the whole conversation at once.
    ahead = {"": 0, "u": 3, "a": 0}
    follow = {"": "u", "u": "a", "a": "u"}
    for _, _, role, text, _ in reversed(one):
        extra = 0 if text[-1] == "." else 3
        here = {q: min(4 + ahead[q], (0 if role[0] == follow[q] else 3) + extra + ahead[follow[q]]) for q in ahead}
        ahead = {q: min(here[q], 3 + here[follow[q]], 6 + here[follow[follow[q]]]) for q in here}
    assert got[7]["cost"] == ahead[""]


def plain_faults(rows):
    seen, counts, illegal = set(), Counter(), sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    for _, role, text in rows:
        counts["d" if (role, text) in seen else "t" if text[-1] not in ".!?" else ""] += 1
        seen.add((role, text))
    return 0, 0, counts["d"], counts["t"], illegal


def test_prices_are_dual_and_tight():
    rng = random.Random(4)
    for _ in range(60):
        block = "".join(rng.choice("uaosUAOS") for _ in range(rng.randrange(0, 12)))
        arcs, sink = auction.lattice(block, auction.END)
        price = auction.auction(arcs, 0, sink)
        assert all(price[i] <= cost + price[to] for i, out in enumerate(arcs) for _, to, cost in out)
        cost, letters, _ = auction.repaired(block, 0, auction.END)
        assert price[0] - price[sink] == cost
        assert auction.edits(block * 5, 0, auction.END)[0] == auction.traced(
            *(lambda a, s: (a, auction.auction(a, 0, s), 0, s))(*auction.lattice(block * 5, auction.END)))[0]


def test_damage_and_odd_conversations(spark):
    rows = [(c, t, r, x, 5, "x") for c, t, r, x in [
        (1, 0, "user", "a."), (1, 1, "assistant", "b."), (None, 1, "user", "c"), (None, None, None, None), (2, None, "user", None),
        (3, 0, None, "d."), (3, 0, None, "d."), (4, 1, "user", "e. " * 50_000)]]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cost int, audit string")
    got = {r["conv_id"]: r for r in conversations.audit(frame).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert conversations.audit(frame.limit(0)).collect() == []
    given = defaultdict(list)
    for c, t, r, x, _, _ in rows:
        given[c].append((t, r or " ", " " if x is None else x))
    for c, talk in given.items():
        after = []
        for t, r, x in talk:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
            after += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
        want = plain_repair(after) if after else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(got[c])[1:] == want


# ---------------------------------------------------------------- divergence


def plain_audit(rows, least, top):
    """Rows (lang, source, text) to (lang, source, part, item, value, rank)."""
    docs, counts = defaultdict(lambda: defaultdict(int)), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
        counts[lang, source].update(found)
        for t in set(found):
            docs[lang][t] += 1
    out = []
    for lang in {g[0] for g in counts}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted(s for g, s in counts if g == lang)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        own = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((whole[t] - own[s][t], t, t.decode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,row,tile", [(250_000, 2048, 1024), (40, 3, 2)])
def test_divergence_against_plain_counts(spark, monkeypatch, block, row, tile):
    monkeypatch.setattr(divergence, "ROW", row)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "LONG", 400)
    monkeypatch.setattr(divergence, "WORDS", 7)
    monkeypatch.setattr(divergence, "index", lambda shards, make=divergence.index: make(shards, block))
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "日本", "Zz"]
    rows = [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]),
             " ".join(rng.choices(words, k=rng.randrange(0, 120))) + "0\x00") for _ in range(120)]
    rows += [("xx", "a", None), ("xx", "b", "rare"), ("en", "empty", ""), ("en", "a", "wa " * 500)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, part string, value int")
    got = divergence.audit(frame.repartition(3), least_docs=10, top=5)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 10, 5)
    assert divergence.audit(frame.limit(0)).collect() == []


# ---------------------------------------------------------------- token files


def test_wavelet_questions(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    monkeypatch.setattr(wavelet, "KEPT", 3)
    rng = np.random.default_rng(0)
    for ids in (np.array([], "<u4"), np.array([0]), np.zeros(300), rng.integers(0, 7, 500), rng.zipf(1.5, 1000) % 50257, np.arange(64)):
        ids = ids.astype("<u4")
        matrix = wavelet.Wavelet(wavelet.pack(ids, [(5, len(ids))]))
        assert matrix.tokens().tolist() == ids.tolist()
        for i in range(0, len(ids), 7):
            assert matrix.access(i) == ids[i]
        for token in {0, 1, 3, 50256, 10**6, *ids[:20].tolist()}:
            where = np.flatnonzero(ids == token)
            assert matrix.occurrences(token).tolist() == where.tolist()
            for lo, hi in ((0, len(ids)), (3, 90), (10, 10), (50, 10**6), (len(ids), len(ids))):
                inside = where[(where >= lo) & (where < hi)]
                assert matrix.count(token, lo, hi) == len(inside) and matrix.occurrences(token, lo, hi).tolist() == inside.tolist()
            assert [matrix.select(token, k) for k in range(0, len(where), 9)] == where[::9].tolist()
            assert matrix.rank(token, len(ids) // 2) == (where < len(ids) // 2).sum()
            with pytest.raises(IndexError):
                matrix.select(token, len(where))


ODD = ["", None, " ", "a", "a b", "a \x00 b c d", "it's we're  two  spaces\n\nlines\t tabs ", "x <|endoftext|> y z", "1 a2 b 3c d e f", "日本 語 a b",
       "é è ê ë", "a b́ c d e", "word " * 30_000, "emoji \U0001f600 and a b c", " a b c d", "A ’s b' c's d"]


def plain_ids(texts):
    model = Tokenizer.from_file(VOCABULARY)
    model.encode_special_tokens = True
    return [[*model.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def plain_files(rows):
    start, out = 0, []
    for (doc_id, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_of_odd_texts():
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choices(list("ab é's 1\n.\x00-") + ["the ", " word"], k=80)) for _ in range(200)]
    encoder = tokens.Encoder(VOCABULARY)
    for _ in range(2):  # the second time from what is remembered
        assert [[*np.frombuffer(encoder.encode(t), "<u4").tolist(), 0] for t in texts] == plain_ids(texts)


def test_token_files_of_the_given_documents(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = QUERIES["op13_token_files"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_files(rows)


def test_token_files_and_questions(spark, tmp_path):
    docs = documents(spark, ODD).withColumns({"start": F.lit("x"), "at": F.lit(1), "part": F.lit(2)})
    got = tokens.token_files(docs.repartition(3), VOCABULARY, f"{tmp_path}/ids", size=50).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_files(list(enumerate(ODD)))
    ids = plain_ids(ODD)
    wanted = [0, 220, 257, 50256]
    found = tokens.occurrences(spark, f"{tmp_path}/ids", wanted).collect()
    assert sorted((r["token"], r["doc_id"], r["place"]) for r in found) == sorted(
        (t, d, i) for t in wanted for d, line in enumerate(ids) for i, x in enumerate(line) if x == t)
    counted = {r["token"]: r["n"] for r in tokens.counts(spark, f"{tmp_path}/ids", wanted).collect()}
    assert counted == {t: sum(line.count(t) for line in ids) for t in wanted}
    # null and repeated ids, repeated rows, no rows
    rows = [(None, "b"), (None, "a"), (3, "same"), (3, "same"), (3, "other"), (-1, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    twice = tokens.token_files(frame, VOCABULARY).orderBy("start").collect()
    assert [r["doc_id"] for r in twice] == [None, None, -1, 3, 3, 3]
    assert [r["start"] for r in twice] == [0, *np.cumsum([r["n_tokens"] for r in twice])[:-1].tolist()]
    assert tokens.token_files(frame.limit(0), VOCABULARY).collect() == []


def test_no_plan_scales_to_more_than_one_margin(spark, monkeypatch):
    """Plans of nested scalings double with each margin, and the driver holds what they broadcast."""
    from millrace.llm import mixing

    rows = [(f"=s{i % 5}", f"=l{i % 3}", f"=t{i % 7}", 10 + i * i % 97) for i in range(105)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy(
        *mixing.MARGINS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens").localCheckpoint()
    joins = []

    def counted(df, purpose, write=mixing.staged):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, purpose)

    monkeypatch.setattr(mixing, "staged", counted)
    got = mixing.raked(cells, mixing.FLATTEN, {"lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}})
    assert len(joins) > 4 and max(joins) <= 3 and set(joins[1:]) == {1}
    total = sum(r[3] for r in rows)
    found = {r["lang"]: r["w"] for r in got.groupBy("lang").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
    assert all(abs(found[f"=l{i}"] / total - share) < 1e-3 for i, share in enumerate((0.2, 0.3, 0.5)))
    assert got.columns == [*cells.columns, "weight"]
