"""Edge cases of all operators: nulls, empty and long texts, repeats, empty tables, extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, chat, embed, html, langid, lines, minhash, packing, quality, queries, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string"
LONG = " ".join(f"word{i}" for i in range(60_000))
CLEAN = " ".join(f"term{i} goes{i}" for i in range(60)) + "."


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, CLEAN, "en", "a"), (1, CLEAN, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, CLEAN + " x", "en", None), (4, LONG, "de", "b"), (5, "...", "en", "a"), (6, CLEAN, "en", "a")]
    return docs(spark, rows).withColumns({"score": F.lit("own"), "n_removed": F.lit("own"), "quality": F.lit("own"), "h": F.lit(1)})


def test_all_operators_take_odd_rows(spark, odd):
    path = queries.tokenizer_path()
    judged = quality.judge(odd)
    assert judged.count() == 8 and judged.columns[:-1] == odd.columns
    by = {(r.doc_id, r.text): r[-1] for r in judged.collect()}
    assert by[2, None].n_words == 0 and by[2, None].base_failed and by[4, LONG].n_words == 60_000 and not by[1, CLEAN].base_failed
    out = langid.predict(odd, langid.fit(odd))
    assert out.count() == 8 and {r.lang_pred for r in out.filter("doc_id in (2, 3, 5)").collect()} == {"und"}
    cut = lines.dedup(odd)
    assert cut.count() == 8 and cut.filter("doc_id = 2").first().text is None
    near = {r.doc_id: r.class_id for r in minhash.near_duplicates(odd).collect()}
    assert near[6] == near[1] == near[None] == 1 and near[2] == 2 and near[3] == 3 and len(near) == 7
    pieces = packing.pack(odd, path).collect()
    assert sum(p.piece == 0 for p in pieces) == 8 and all(p.length == 1 for p in pieces if p.doc_id in (2, 3))
    trip = bpe.round_trip(odd, path).collect()
    assert len(trip) == 8 and {r.n_tokens for r in trip if r.doc_id in (2, 3)} == {0}


def test_all_operators_take_empty_tables(spark):
    none, path = docs(spark, []), queries.tokenizer_path()
    assert quality.judge(none).count() == 0 and lines.dedup(none).count() == 0
    assert langid.fit(none) is None and langid.predict(none, None).count() == 0
    assert minhash.near_duplicates(none).count() == 0 and packing.pack(none, path).count() == 0 and bpe.round_trip(none, path).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.main_text(pages).count() == 0 and urlfilter.judge(pages).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    turns = chat.blocks_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert chat.parse(chat.transcripts_of(turns), chat.fit(turns)).count() == 0


def test_pages_and_urls(spark):
    rows = [(1, None, None), (2, "no scheme", "<p>a"), (3, "HTTP://WWW.Example.org:80/es/x?q#f", ""), (3, "HTTP://WWW.Example.org:80/es/x?q#f", ""), (None, "x://sub.foo.com/de/", "<b>b</b>"), (4, "x://Ä.org", "text")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("path", F.lit("own"))
    out = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert out[1].host == out[2].host == out[2].path == "" and out[1].rule is None and out[1].verdict == "allow"
    assert out[3].host == "www.example.org:80" and out[3].path == "/es/x" and out[3].rule is None
    assert out[None].rule == "com/de/" and out[None].verdict == "block" and out[4].host == "Ä.org" and out[4].path == "" and out[4].rule is None
    texts = [r.text for r in html.main_text(pages).orderBy("page_id").collect()]
    assert len(texts) == 6 and "" in texts and "a" in texts and "b" in texts


def test_rules(spark):
    urls = {"http://a.org/x": "org/", "http://example.org/es/1": "example.org/es/", "http://m.example.org/en/17": "example.org/en/1", "http://a.com/fr/": "com/fr/", "http://a.com/de/x": "com/de/", "http://notorg/x": None, "http://org/": "org/"}
    out = urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert {r.url: r.rule for r in out} == urls


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[0] + 0.02 * rng.normal(size=16)], 0) for i in range(30)]
    rows += [(200, rows[5][1], 0), (201, rows[5][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [1.0, None], 0), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (208, rows[5][1], 1), (5, rows[5][1], 0)]
    out = {r.vec_id: r for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert len(out) == 79 and out[0].n_links == 30 and out[129].component_id == 0 and not out[129].kept
    assert out[200].n_links == 1 and out[200].component_id == 5 and out[207].component_id == 206
    assert all(out[i].n_links == 0 and out[i].kept for i in (201, 202, 203, 204, 205, 208))
