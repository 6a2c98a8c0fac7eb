"""Operators against SQL or a plain version."""

import hashlib
import random

import numpy as np
import oracle
import pytest
from plain import SF, contaminated, documents, near, personal, repeats
from pyspark.sql import functions as F

from millrace.llm import decontaminate, htmltext, pii, setsketch, suffixes, topk
from millrace.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    problems, count = oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE[name])
    assert not problems and count


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def mixed_texts(rng):
    base = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 60)
    texts = [*base, base[0], base[1].upper(), None, "", "  \n", "one", "one", "two words", "é" * 300, "a" * 700]
    for i in range(30):
        w = base[i % 3].split()
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(12)]
    texts += ["same line here again and again\n" * 30, "y" + "a" * 320 + "z"]
    return texts


@pytest.mark.parametrize("hot", [4000, 3])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = mixed_texts(random.Random(3))
    got = suffixes.remove_repeats(documents(spark, texts), kept_text=True).orderBy("doc_id").collect()
    want = repeats(texts)
    assert [tuple(r)[1:5] for r in got] == want
    for r, (n, gone, _, digest) in zip(got, want, strict=True):
        assert r["kept"] is None or len(r["kept"]) == n - gone and hashlib.sha256(r["kept"]).hexdigest() == digest


def test_repeated_bytes_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = suffixes.remove_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == repeats([r["text"] for r in rows])


def test_matches_at_the_edge_of_a_span(spark):
    rng = random.Random(5)
    raw = "".join(rng.choice("abcdefgh") for _ in range(3000))
    for n in (199, 200, 201, 260):
        texts = [raw[:1000], raw[1000:1300] + raw[300 : 300 + n] + raw[1300:1500], raw[2000:2400] + raw[700 : 700 + n]]
        got = suffixes.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == repeats(texts)


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 40))) for _ in range(k)]

        def shared(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        tree = suffixes.LoserTree([(r, np.array([0] + [shared(a, b) for a, b in zip(r, r[1:])])[: len(r)]) for r in runs])
        out = list(tree.merged())
        strings = [runs[i][j] for i, j, _ in out]
        assert strings == sorted(x for r in runs for x in r)
        assert [p for _, _, p in out][1:] == [shared(a, b) for a, b in zip(strings, strings[1:])]


def test_near_duplicates(spark):
    texts = mixed_texts(random.Random(4))
    got = {r["doc_id"]: r for r in setsketch.link(documents(spark, texts)).collect()}
    for i, (n, component) in near(enumerate(texts)).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component)


def test_near_duplicates_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = near([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setsketch.link(docs).collect()}
    assert got == want


def test_a_star_whose_hub_is_not_first(spark):
    """Variants of a text that are similar to it but not to each other; the text has the largest id."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(40):
        w = list(words)
        for j in rng.sample(range(200), 4):
            w[j] = f"x{i}_{j}"
        texts.append(" ".join(w))
    texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in setsketch.link(documents(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in near(enumerate(texts)).items()}


def test_sketches_merge_and_tell_similarity():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    both = np.maximum(setsketch.registers(np.unique(a)), setsketch.registers(np.unique(b)))
    assert (both == setsketch.registers(np.unique(np.concatenate([a, b])))).all()
    near_a = np.unique(np.concatenate([a[:2700], b[:300]]))
    for other, similar in ((near_a, True), (np.unique(b), False)):
        x, y = setsketch.registers(np.unique(a)), setsketch.registers(other)
        assert setsketch.likely([(x > y).sum()], [(x < y).sum()], [3000], [len(other)])[0] == similar


def test_decontamination(spark, monkeypatch):
    rng = random.Random(7)
    items = [(1, prose(rng, 30)), (2, prose(rng, 14)), (3, "Short item, HERE"), (4, ""), (None, prose(rng, 12)), (5, None), (2, prose(rng, 11))]
    texts = [prose(rng, 50), f"{prose(rng, 300)} {items[0][1]} {prose(rng, 20)}", items[1][1].upper(), "the short ITEM here is",
             f"{items[4][1]}", None, "", "...", " ".join(items[0][1].split()[:9]), f"{prose(rng, 120)} {items[0][1]} {items[0][1]}"]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for bound in (10, decontaminate.BROADCAST_WINDOWS):  # both ways to join
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        got = decontaminate.scan(documents(spark, texts), table).orderBy("doc_id").collect()
        for r, (n, hit, ids) in zip(got, contaminated(texts, items), strict=True):
            listed = sorted(str(i) for i in ids if i is not None)
            digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(listed), digest)
            assert r["contaminated"] == (hit > 0)


def test_personal_data(spark):
    texts = ["mail a@b.co and x.y@z.example.com, a@b", "at 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 ok",
             "call +1 (555) 123-4567 or +12", "4111-1111-1111-1112", None, "", "é 10.0.0.1 ü a@é.b x@y.z@w.v", "9" * 5000, "+" * 50 + "1" * 12]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        assert pii.base_spans(t or "") == personal(t)
    got = pii.find(documents(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in personal(t))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))


def test_overlapping_spans_are_masked_whole():
    for text, want in (
        ("call +1 555 123 4567 007bond@x.com now", "call <phone> now"),
        ("at 10.0.0.4 111 1111 1111 1111 on", "at <card> on"),
        ("+1 555 123 4567 and a@b.co, a@b.co", "<phone> and <email>, <email>"),
        ("a@b.co/c@d.org", "<email>/<email>"),
    ):
        spans = pii.base_spans(text)
        assert pii.masked(text, {}) == want, spans
    pieces = pii.base_spans("at 10.0.0.4 111 1111 1111 1111 on")
    assert [k for k, *_ in pieces] == ["ip", "card"] and pieces[1][1] < pieces[0][2]


def test_the_sample_holds_base_spans_of_every_kind(spark, monkeypatch):
    """Half the rows hold long numbers but nothing personal, most others hold phone numbers."""
    rare = ["mail a@b.co", "host 1.2.3.4", "card 4111 1111 1111 1111"]
    texts = [f"order {10**8 + i} came" for i in range(1000)] + [f"call +1 555 123 {1000 + i}" for i in range(900)] + rare + [None, ""]
    monkeypatch.setattr(pii, "fit", lambda drawn: drawn)
    drawn = pii.trained(documents(spark, texts), 40)
    assert len(drawn) == 40 and set(rare) <= set(drawn) and all(map(pii.base_spans, drawn))
    assert drawn == pii.trained(documents(spark, texts).repartition(5), 40)
    assert set(pii.trained(documents(spark, texts[:1000] + rare), 40)) == set(rare)


def test_training_reads_regions_beyond_the_first(spark, monkeypatch):
    junk = "".join(f"number {10**6 + i} in the list {'of plain words ' * 12}. " for i in range(8))
    texts = [f"{junk[i:]} mail user{i}@mail.example.com now" for i in range(12)]
    assert pii.fit(texts).get("email:address", 0) > 0
    assert pii.fit(texts, most_regions=0) == pii.fit(texts, most_pieces=0) == {f"{k}:any": -2.0 for k in pii.KINDS}
    monkeypatch.setattr(pii, "fit", lambda drawn: drawn)
    long = "mail a@b.co " + "x" * 1000
    assert pii.trained(documents(spark, [long, "mail c@d.co"]), most_chars=500) == ["mail c@d.co"]
    assert len(pii.trained(documents(spark, [long, "mail c@d.co"]))) == 2


def test_the_field_finds_disguised_spans(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("[0-9@]")).collect()]
    weights = pii.fit([t for t in texts if pii.base_spans(t)])
    for text, span in (("write to bob (at) example (dot) com now", "bob (at) example (dot) com"), ("ring 555-123-4567 today", "555-123-4567"),
                       ("seen at 10[.]2[.]3[.]44 once", "10[.]2[.]3[.]44"), ("pay 4111.1111.1111.1111 soon", "4111.1111.1111.1111")):
        assert [text[a:b] for _, a, b in pii.added_spans(text, [], weights)] == [span]
    for text in ("version 2.0 of 2024-01-02", "order 123456789012345678901234 came", "nothing here"):
        assert not pii.added_spans(text, pii.base_spans(text), weights)


def test_long_disguised_addresses_are_one_span(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("[0-9@]")).collect()]
    weights = pii.fit([t for t in texts if pii.base_spans(t)])
    for address in ("anna.lee@mail.example.com", "anna.b.lee@dept.mail.university.example.com"):
        for text, truth in (pii.disguised(f"write to {address} now", [("email", 9, 9 + len(address))], way) for way in (1, 2)):
            (_, a, b), = truth
            assert ("email", a, b) in [(k, r[i][0], r[j - 1][1]) for r in pii.regions(text) for i, j, k, _ in pii.candidates(text, r)]
            assert pii.masked(text, weights) == "write to <email> now", text


def test_dynamic_programming_is_best():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 7)
        segments = [(i, j, "ip", [f"f{i}_{j}"]) for i in range(n) for j in range(i + 1, n + 1)]
        weights = {s[3][0]: rng.uniform(-2, 2) for s in segments}

        def best(at):
            if at == n:
                return 0.0
            return max([best(at + 1)] + [weights[f"f{at}_{j}"] + best(j) for j in range(at + 1, n + 1)])

        got = sum(s for *_, s in pii.best_segments(n, segments, weights))
        assert abs(got - best(0)) < 1e-9
        # each place lies in a segment or in none: expectations are probabilities
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in pii.expectations(n, segments, weights))


PAGE = """<!doctype html><html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=x>Menu one</a><a href=y>Menu two</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><aside>Side bar text that goes on</aside><article><h1>The &eacute;t&eacute;</h1><p>First   paragraph
with <b>bold</b> and <a href=z>a link</a> &amp; more words to read.</p><div class="ad">Buy now</div><ul><li>one item<li>two items</ul>
<p>Second paragraph of some length, so that there is text.<p>Third one<br>goes on.<form><input value=no>Send</form></article>
<div class="comments"><p>A reader writes a long comment that is not part of the article at all.</p></div></div>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "\n\n".join([
        "The été", "First paragraph with bold and a link & more words to read.", "one item", "two items",
        "Second paragraph of some length, so that there is text.", "Third one goes on."])
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("<p>plain") == "plain"
    assert htmltext.main_text("<div>" * 3000 + "deep") == "deep"


ARTICLE = "<h1>The title</h1>" + "".join(f"<p>{n} paragraph {'with many plain words ' * 12}to read.</p>" for n in ("First", "Second", "Third"))
PARTS = ('<div class="sidebar">Side bar text that goes on</div><div class="cookie-notice">We use cookies</div><form>Search here</form>'
         f'<div class="comments"><p>{"A reader writes a long comment. " * 40}</p></div>')


@pytest.mark.parametrize("wrapper", [
    '<div class="content no-sidebar">%s</div>', '<div class="page has-header">%s</div>', '<div id="main-with-comments">%s</div>',
    '<div class="layout sidebar-right">%s</div>', "<form action=x>%s</form>",
    '<div class="has-header"><div class="layout sidebar-right"><form class="no-ads">%s</form></div></div>'])
def test_marks_of_the_layout_keep_the_article(wrapper):
    want = htmltext.main_text(f"<body>{ARTICLE}</body>")
    assert want.startswith("The title\n\nFirst paragraph") and want.count("\n\n") == 3
    for body in (ARTICLE, f"<article>{ARTICLE}</article>"):
        for page in (wrapper % body, PARTS + wrapper % body, wrapper % body + PARTS, wrapper % (body + PARTS), wrapper % (PARTS + body)):
            assert htmltext.main_text(f"<body><nav><a href=x>Menu</a></nav>{page}<footer>end</footer></body>") == want


def test_articles_split_over_siblings():
    part = "<p>" + ("plain words to read " * 15)[:300] + "</p>"
    text = htmltext.main_text(part)
    links = "<ul>" + "<li><a href=x>some link text</a></li>" * 6 + "</ul>"
    for page, want in [
        (f"<section>{part * 3}</section><section>{part}</section>", [text] * 4),
        (f"<div><h1>Heading</h1></div><div>{part * 3}</div>", ["Heading", *[text] * 3]),
        (f"{links}<div><h1>Heading</h1></div><div>{part * 3}</div><div>{links}</div><a href=x>one</a> | <a href=y>two</a>", ["Heading", *[text] * 3]),
        (f"Loose <b>words</b> and <a href=x>a link</a><div>{part * 3}</div><p>A short end", ["Loose words and a link", *[text] * 3, "A short end"]),
        (f"<div>{part * 3}</div></body><p>After the body", [*[text] * 3, "After the body"]),
    ]:
        assert htmltext.main_text(f"<html><head><title>no</title></head><body>{page}") == "\n\n".join(want)


def test_top_k_beyond_64_bits_and_odd_vectors(spark):
    rows = [(0, [1e18, 1.0]), (50, [2.0, 1.0]), (1, [1e18, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]),
            (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [2.0, 1.0]), (100, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 7), (50, 1, 0), (50, 2, 1)]
    assert got[2]["score"] == 512 * (256 * 10**18) + 256 * 256 if 512 * 256 * 10**18 < 2**63 else got[2]["score"] == 2**63 - 1


def unnamed(*parts):
    return "<html><head><title>no</title></head><body>" + "".join(parts) + "</body></html>"


PROSE = "<h1>The title</h1>" + "".join(f"<p>{n} paragraph {'with many plain words ' * 14}to read.</p>" for n in ("First", "Second", "Third", "Fourth", "Fifth"))
NOTICE = "<div><div>This site stores small files.</div><div><b>Fine</b></div></div>"
READERS = "<div>" + "".join(f"<div><b>{n}</b><div>I read this twice and liked it a lot.</div><div><i>2 days</i></div></div>" for n in "ABC") + "</div>"
TEASERS = "<div>" + "<div><div><a href=x>More to see here</a></div><div>A short line</div></div>" * 4 + "</div>"
END = "<div><div>Copyright of the owners</div></div>"


@pytest.mark.parametrize("page", [
    unnamed(NOTICE, f"<div>{PROSE}</div>", READERS, END),
    unnamed(f"<div>{NOTICE}<div>{PROSE}</div>{READERS}</div>", END),
    unnamed(f"<div><div>{PROSE}</div></div>", TEASERS, READERS),
    unnamed(TEASERS, f"<section>{PROSE}</section>", END),
    unnamed(NOTICE, "<div><h1>The title</h1></div>", f"<div>{PROSE.removeprefix('<h1>The title</h1>')}</div>", READERS, END),
])
def test_density_alone_finds_the_article(page):
    """No class, id or telling element: what is beside the article is only less dense."""
    assert htmltext.main_text(page) == htmltext.main_text(f"<body>{PROSE}</body>")


def test_negated_densities_change_the_text(monkeypatch):
    page = unnamed(NOTICE, f"<div>{PROSE}</div>", READERS, END)
    right = htmltext.main_text(page)
    plain = htmltext.measure

    def negated(nodes):
        plain(nodes)
        for n in nodes:
            n.density, n.total = -n.density, -n.total

    monkeypatch.setattr(htmltext, "measure", negated)
    assert htmltext.main_text(page) != right


def test_pages_of_any_length(spark):
    rows = [(1, "u", unnamed(f"<div>{PROSE * 400}</div>", READERS)), (2, "u", "<b>" * 20_000 + "deep"), (3, "u", "x " * 300_000)]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1]["text"].count("\n\n") == 6 * 400 - 1 and got[2]["text"] == "deep" and got[3]["n_chars"] == 599_999


def plain_density(html):
    """Character and tag counts of every element outside scripts and styles, by a plain walk: tag path -> characters per tag."""
    tree = htmltext.Tree()
    tree.feed(html)
    tree.close()

    def count(node):
        chars = sum(len("".join(x.split())) for x in node.content if isinstance(x, str))
        tags = 0
        for x in node.content:
            if not isinstance(x, str) and not x.beside:
                c, t = count(x)
                chars, tags = chars + c, tags + t + 1
        return chars, tags

    htmltext.judge(tree.nodes)
    htmltext.measure(tree.nodes)
    for node in tree.nodes:
        if not node.beside:
            assert (node.chars, node.tags) == count(node)
    return tree.nodes


def test_densities_of_the_given_pages(spark):
    """Counts against a plain walk; the sums are those of the children; the article's element is the densest sum."""
    for row in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        nodes = plain_density(row["html"])
        for n in nodes:
            if not n.beside:
                assert abs(n.total - sum(x.density for x in n.content if not isinstance(x, str) and not x.beside)) < 1e-9
