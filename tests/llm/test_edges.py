"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, htmltext, langid, mixing, pii, quality, setsketch, suffixes, topk, toxicity

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, Text string, score double, predicted int, "
          "raw string, tid bigint, node bigint, n_words bigint, item_id bigint, held_out string")
MORE = ("other", 0.5, 7, "raw", 1, 2, 3, 4, "x")
ROWS = [
    (1, "some words of a plain text that goes on for a while you know", "en", "a"), (1, "some words of a plain text that goes on for a while you know", "en", "a"),
    (2, None, "en", "a"), (3, "", None, None), (None, "text without an id but with words", "fr", None), (None, None, None, None),
    (4, "word " * 60_000, "en", "b"), (5, "1234 !!", "de", "b"), (6, "some words of a plain text that goes on for a while you know", "en", "b"),
    (7, "\U0001f600 \x00 mixed ééé text", "es", "c"), (1, "another text with the same id", "en", "a"),
]
LABELS = [(1, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (4, 0, 1), (4, 1, 0), (6, 1, 0), (99, 1, 1)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), *MORE) for r in rows], SCHEMA)


def labels(spark, rows=LABELS):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, text string")


def items(spark, rows=((1, "words of a plain text that goes on for a while"), (None, "x"), (2, None), (3, ""))):
    return spark.createDataFrame([(*r, 5) for r in rows], "item_id bigint, text string, doc_id int")


OPERATORS = {
    "toxicity": lambda s, d, full: toxicity.score(d, labels(s, LABELS if full else [])),
    "decontaminate": lambda s, d, full: decontaminate.scan(d, items(s) if full else items(s, [])),
    "suffixes": lambda s, d, full: suffixes.remove_repeats(d),
    "setsketch": lambda s, d, full: setsketch.link(d),
    "langid": lambda s, d, full: langid.identify(d),
    "mixing": lambda s, d, full: mixing.mix(d),
    "pii": lambda s, d, full: pii.find(d),
    "quality": lambda s, d, full: quality.score(d, labels(s, LABELS if full else [])),
}


@pytest.fixture(autouse=True)
def sensitive(spark):
    """Two columns that differ in case only can't be made otherwise."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, docs(spark), True).collect()
    assert len(got) == len(ROWS)
    assert sum(r["doc_id"] is None for r in got) == 2
    assert sum(r["doc_id"] == 1 for r in got) == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, docs(spark, []), True).collect() == []
    assert OPERATORS[name](spark, docs(spark, []), False).collect() == []
    assert len(OPERATORS[name](spark, docs(spark), False).collect()) == len(ROWS)


def test_defined_results(spark):
    d = docs(spark)
    und = {r["doc_id"]: r["lang_pred"] for r in langid.identify(d).collect()}
    assert und[2] == und[3] == und[5] == "und" and und[7] != "und"
    linked = [r for r in setsketch.link(d).collect()]
    assert {r["component_id"] for r in linked if r["doc_id"] in (1, 6)} == {1}
    assert all(r["component_id"] is None and r["kept"] for r in linked if r["doc_id"] is None)
    hit = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.scan(d, items(spark)).collect()}
    assert (6, 11, 1) in hit and (2, 0, 0) in hit
    cuts = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(d).collect()}
    assert cuts[4] == 300_000 and cuts[2] == cuts[3] == 0


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None), (2, "u", "", "t")],
                                  "page_id bigint, url string, html string, text string")
    got = htmltext.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert htmltext.extract(pages.limit(0)).collect() == []
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, score int, rank int")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = docs(spark).select("doc_id", "text", "lang", "source", "n_chars", "score", "item_id")
    out = stage(spark, plain, str(tmp_path))
    rows = out.collect()
    if name != "mixing":
        assert out.columns == plain.columns
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}
    if name == "near_duplicates":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7] and sum(r["doc_id"] is None for r in rows) == 2
    if name in ("toxicity", "decontamination"):
        assert {2, 3, 5} <= {r["doc_id"] for r in rows}
    if name == "pii":
        assert len(rows) == len(ROWS)
    assert stage(spark, plain.limit(0), str(tmp_path)).collect() == []


#: Names that stages use for columns of their own, and those that a caller may like just as much.
HELPERS = ("_row _0 _1 _toxic _score toxic score clauses dirty_id dirty_body _doc_id body kept_id copies place _place masked _masked "
           "topic weight probability kept _kept n_tokens _n_tokens cell_source mix_weight row hash text_hash").split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, name, tmp_path):
    """Each helper's name is taken by a column of the caller; it comes out as it went in."""
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    taken = plain.withColumns({h: F.lit(f"own {h}") for h in HELPERS})
    out = stage(spark, taken, str(tmp_path))
    if name == "mixing":
        assert out.columns == [c for c in taken.columns if c != "mix_weight"] + ["mix_weight"]
    else:
        assert out.columns == taken.columns
    rows = out.collect()
    assert rows and all(r[h] == f"own {h}" for r in rows for h in HELPERS if (name, h) != ("mixing", "mix_weight"))
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}
    if name == "near_duplicates":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7]
