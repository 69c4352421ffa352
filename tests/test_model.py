"""Model-backed operators on canned answers, providers over a fake connection, and the
repaired readers."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from quillspark.operators import assembly, model, profile, rewrite
from quillspark.operators.providers import HttpProvider, ProviderConfig, QuotaExhausted, available, estimate_minutes, list_models, resolve_key
from quillspark.plans.fixtures import FailingProvider, RuleProvider
from quillspark.sources.html import markdown


def test_html_with_tags_left_out():
    assert markdown("<html><head><title>x</title><body><h1>T</h1><p>a<p>b") == "# T\n\n\na\n\n\nb"
    assert markdown("<ul><li><p>x</p></li><li>y<li>z</ul>") == "- x\n- y\n- z"
    assert markdown("<blockquote><p>q</p></blockquote><script>s<h1></script>t") == "> q\nt"
    assert markdown("<head><meta><h2>H</h2>rest") == "## H\n\nrest" and markdown(None) == ""


def test_footnotes_behind_a_rule(spark):
    docs = spark.createDataFrame([(1, "Alpha and beta alpha.", {"alpha": "first", "gamma": "none", "beta": "second"})], "doc_id long, text string, notes map<string,string>")
    r = assembly.insert_footnotes(docs).first()
    assert r.text == "Alpha[^1] and beta[^2] alpha.\n\n---\n\n## Notes\n\n[^1]: **alpha** — first\n\n[^2]: **beta** — second\n" and r.n_notes == 2
    with_map = docs.select(model.place_concept_map(F.lit(r.text), F.lit("MAP")).alias("t")).first().t
    assert with_map.index("MAP") < with_map.index("---") and with_map.endswith("second\n")
    assert docs.select(model.place_concept_map(F.lit("a"), F.lit("")).alias("t")).first().t == "a"


def test_author_needs_a_title(spark):
    chunks = spark.createDataFrame([(1, 0, "One", "", "x", True), (1, 1, "Two", "", "y", True)], "doc_id long, chunk_id int, chapter string, section string, text string, is_chapter_start boolean")
    titles = spark.createDataFrame([(1, None, "Ann", ["Two"])], "doc_id long, title string, author string, sections array<string>")
    assert assembly.assemble_book(chunks, titles).first().text == "x\n\n## Two\n\ny"


def test_failures_leave_the_fallback(spark):
    pages = spark.createDataFrame([(1, 0, "A title"), (1, 1, None)], "doc_id long, page int, text string")
    docs = spark.createDataFrame([(1, "First lines\n\nword word word term term term")], "doc_id long, text string")
    r = model.scan_structure(docs, pages, FailingProvider).first()
    assert (r.title, r.authors, r.has_toc, r.body_starts_at_page, r.sections, r.total_pages) == (None, [], False, 0, [], 2)
    chunks = docs.withColumns({"chunk_id": F.lit(0), "chapter_idx": F.lit(0), "chapter": F.lit("c")})
    assert model.classify_chunks(chunks, FailingProvider).first().section_type == "BODY"
    assert model.extract_glossary(chunks, FailingProvider).first().glossary == {"word": "occurs 3 times", "term": "occurs 3 times"}
    assert model.book_summary(chunks, FailingProvider).first().summary.startswith("The book begins: First")
    assert model.rewrite_paragraphs(chunks, FailingProvider).first().text == docs.first().text
    assert model.simplify_sequential(chunks, FailingProvider).first().text == docs.first().text
    assert model.concept_map(docs, FailingProvider).first().concept_map == "" and model.footnotes(chunks, FailingProvider).count() == 0


def test_scan_goes_on_where_front_matter_is_long(spark):
    pages = spark.createDataFrame([(1, i, "x" if i == 0 else f"page {i}") for i in range(20)], "doc_id long, page int, text string")
    docs = spark.createDataFrame([(1, "Heading one\n\ntext\n\nHeading two here\n\nmore")], "doc_id long, text string")
    r = model.scan_structure(docs, pages, RuleProvider).first()
    assert r.authors == ["Ann Lee", "Bo Ek"] and r.sections == ["Heading one", "Heading two here"] and r.body_starts_at_page in (1, 10)


def test_similar_paragraphs_merge(spark):
    rows = spark.createDataFrame([(1, 0, "a b c d e"), (1, 1, "a b c d f"), (1, 2, "x y z u v"), (1, 3, "x y")], "doc_id long, i int, s string")
    encode = lambda texts: [[t.count(c) for c in "abcdefxyzuv"] for t in texts]
    assert [r.text for r in model.merge_similar(rows, encode, 0.75).orderBy("g").collect()] == ["a b c d e a b c d f", "x y z u v", "x y"]


def test_epub_check(spark):
    files = spark.createDataFrame([(1,), (2,)], "doc_id long")
    chapters = spark.createDataFrame([(1, "A plain sentence of words. " * 300)], "doc_id long, text string")
    assert {r.doc_id: (r.n_chapters, r.passed) for r in profile.check_epub(files, chapters).collect()} == {1: (1, True), 2: (0, False)}


def test_meta_openings(spark):
    from quillspark.operators.cleanup import drop_meta

    text = "  The passage argues that.\n\nThe passages argue\n\nIn summary, x"
    assert spark.range(1).select(drop_meta(F.lit(text)).alias("t")).first().t == "The passages argue"


def _opener(answers, seen):
    def open_(request, timeout):
        seen.append(json.loads(request.data) if request.data else request.full_url)
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return io.BytesIO(json.dumps(x).encode())

    return open_


def test_providers(monkeypatch):
    seen, waits = [], []
    busy = lambda wait: urllib.error.HTTPError("u", 429, "busy", {"retry-after": wait} if wait else {}, None)
    p = HttpProvider(ProviderConfig("http://x", "m"), sleep=waits.append, opener=_opener([busy("7"), busy(None), {"choices": [{"message": {"content": "hi"}}]}], seen))
    assert p.generate("q", "s") == "hi" and waits == [7.0, 10.0] and seen[-1]["messages"][0] == {"role": "system", "content": "s"}
    with pytest.raises(QuotaExhausted):
        HttpProvider(ProviderConfig("http://x", "m"), sleep=waits.append, opener=_opener([busy("900")], seen)).generate("q")
    for style, answer in (("generate", {"response": "a"}), ("parts", {"candidates": [{"content": {"parts": [{"text": "a"}]}}]})):
        assert HttpProvider(ProviderConfig("http://x", "m", style), opener=_opener([answer], seen)).generate("q") == "a"
    monkeypatch.setenv("SOME_KEY", "k")
    assert resolve_key(None, "SOME_KEY") == "k" and resolve_key("g", "SOME_KEY") == "g" and resolve_key(None, None) is None
    with pytest.raises(ValueError):
        resolve_key(None, "NO_SUCH_KEY")
    q = HttpProvider(ProviderConfig("http://x", "m"), opener=_opener([{"models": [{"name": "b"}, {"name": "a"}]}, OSError()], seen))
    assert list_models(q, "http://x/tags") == ["a", "b"] and not available(q, "http://x") and estimate_minutes(108_000, 300) == 6.0


def test_section_names_that_no_line_has(spark):
    lines = spark.createDataFrame([(1, 0, "Alpha one"), (1, 1, "Beta")], "doc_id long, i int, s string")
    named = spark.createDataFrame([(1, "Alpha"), (1, "Beta and more"), (1, "Gamma")], "doc_id long, name string")
    assert {(r.name, r.heading) for r in rewrite.resolve_headings(named, lines).collect()} == {("Alpha", "Alpha one"), ("Beta and more", "Beta")}
