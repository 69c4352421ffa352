"""Operators that ask a model: structure scan, classification, glossary, summary,
notes, concept maps, rewriting by paragraphs and in sequence, verification.

Each makes one row a request, calls the provider there (parallelism is that of the
rows), and parses and checks the answers with column functions. A request that fails
leaves the stated fallback. What is gathered is bounded by one document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordered_join, paragraphs, strip, word_count
from . import prompts
from .glossary import one_definition, top_terms
from .rewrite import SECTION_TYPES, apply_corrections, call, parse_corrections, parse_labels, parse_object, previews, resolve_headings

Factory = Callable[[], object]
FRONT_PAGES, BACK_PAGES, MOST_STARTERS = 5, 5, 80
_FRONT = "title string, subtitle string, authors array<string>, has_toc boolean, has_abstract boolean, body_starts_at_page int"
_BACK = "has_references boolean, has_endnotes boolean, has_appendix boolean, back_matter_starts_at_page int"


def _json(response: str, schema: str) -> Column:
    raw = F.regexp_extract(F.regexp_replace(response, "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.from_json(F.when(raw != "", raw), schema)


# ---------------------------------------------------------------- structure scan


def _page_texts(pages: DataFrame) -> DataFrame:
    text = strip(F.coalesce("text", F.lit("")))
    body = F.when(text == "", "[BLANK PAGE]").otherwise(F.left(text, F.lit(prompts.PAGE_CHARS)))
    marked = F.concat(F.lit("=== PAGE "), (F.col("page") + 1).cast("string"), F.lit(" ===\n"), body)
    return pages.select("doc_id", "page", marked.alias("s")).groupBy("doc_id").agg(ordered_join("page", "s", "\n\n").alias("s"))


def scan_front(pages: DataFrame, factory: Factory, first: int = 0, count: int = FRONT_PAGES) -> DataFrame:
    """(doc_id, front): what the pages first to first + count - 1 (doc_id, page from 0,
    text) say of title, authors and where the body begins."""
    asked = _page_texts(pages.where((F.col("page") >= first) & (F.col("page") < first + count))).select("doc_id", prompts.request(prompts.FRONT, F.col("s")).alias("prompt"))
    return call(asked, factory, temperature=0.0).select("doc_id", _json("response", _FRONT).alias("front"))


def scan_back(pages: DataFrame, factory: Factory, count: int = BACK_PAGES) -> DataFrame:
    """(doc_id, back) of the last pages."""
    last = F.max("page").over(Window.partitionBy("doc_id"))
    asked = _page_texts(pages.withColumn("_last", last).where(F.col("page") > F.col("_last") - count)).select("doc_id", prompts.request(prompts.BACK, F.col("s")).alias("prompt"))
    return call(asked, factory, temperature=0.0).select("doc_id", _json("response", _BACK).alias("back"))


def starters(docs: DataFrame, most: int = MOST_STARTERS) -> DataFrame:
    """(doc_id, i, s): paragraphs' first lines, 100 characters at most, heading marks
    off, evenly thinned where there are more than ``most``."""
    line = F.left(strip(F.split("p", "\n")[0]), F.lit(100))
    rows = docs.select("doc_id", F.posexplode(paragraphs("text")).alias("p_i", "p")).select("doc_id", "p_i", F.regexp_replace(line, r"^#{1,6}\s+", "").alias("s")).where(F.length("s") > 1)
    whole = Window.partitionBy("doc_id")
    rows = rows.select("doc_id", "s", (F.row_number().over(whole.orderBy("p_i")) - 1).alias("k"), F.count("*").over(whole).alias("n"))
    step = F.when(F.col("n") > most, F.expr(f"n div {most}")).otherwise(F.lit(1))
    return rows.where(F.col("k") % step == 0).select("doc_id", F.floor(F.col("k") / step).cast("int").alias("i"), "s")


def section_headings(docs: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, sections): headings that the model picks from the starters. A name that
    is no starter stands for the first one of which either is a prefix, or goes."""
    lines = starters(docs)
    asked = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x.s).alias("items"))
    asked = asked.select("doc_id", prompts.request(prompts.SECTIONS, prompts.numbered("items")).alias("prompt"))
    raw = F.regexp_extract(F.regexp_replace("response", "```(?:json)?", ""), r"(?s)\[.*\]", 0)
    named = call(asked, factory, temperature=0.0).select("doc_id", F.posexplode(F.from_json(F.when(raw != "", raw), "array<string>")).alias("k", "name"))
    named = named.select("doc_id", "k", strip("name").alias("name")).where("name <> ''")
    found = resolve_headings(named.select("doc_id", "name").distinct(), lines)
    return named.join(found, ["doc_id", "name"]).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "heading"))), lambda x: x.heading).alias("sections"))


def scan_structure(docs: DataFrame, pages: DataFrame, factory: Factory) -> DataFrame:
    """One row a document: title, subtitle, authors, has_toc, has_abstract,
    body_starts_at_page, has_references, has_endnotes, back_matter_starts_at_page,
    sections, total_pages. Where the first pages are all front matter, the next ten
    are asked where the body begins."""
    front, back = scan_front(pages, factory), scan_back(pages, factory)
    total = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    longer = front.where(F.col("front.body_starts_at_page") >= FRONT_PAGES).join(total.where(F.col("total_pages") > FRONT_PAGES), "doc_id").select("doc_id")
    further = scan_front(pages.join(longer, "doc_id", "left_semi"), factory, FRONT_PAGES, 2 * FRONT_PAGES).select("doc_id", F.col("front.body_starts_at_page").alias("further"))
    all_of = total.join(front, "doc_id", "left").join(back, "doc_id", "left").join(further, "doc_id", "left").join(section_headings(docs, factory), "doc_id", "left")
    names = F.transform(F.coalesce("front.authors", F.array().cast("array<string>")), lambda x: F.when((F.upper(strip(x)) == strip(x)) & (F.length(strip(x)) > 1), F.initcap(strip(x))).otherwise(strip(x)))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c.rpartition(".")[2])
    return all_of.select(
        "doc_id", "front.title", "front.subtitle", names.alias("authors"), no("front.has_toc"), no("front.has_abstract"), F.coalesce("further", "front.body_starts_at_page", F.lit(0)).alias("body_starts_at_page"),
        no("back.has_references"), no("back.has_endnotes"), "back.back_matter_starts_at_page", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), "total_pages",
    )


def scan_report(scanned: DataFrame) -> DataFrame:
    """(doc_id, report): the scan in a few lines."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return scanned.select("doc_id", F.format_string("title: %s\nauthors: %s\ncontents: %s\nreferences: %s\nsections: %d\npages: %d", F.coalesce("title", F.lit("-")), F.array_join("authors", ", "), yes("has_toc"), yes("has_references"), F.size("sections"), F.col("total_pages")).alias("report"))


# ---------------------------------------------------------------- classification


def _labelled(pieces: DataFrame, factory: Factory, labels, task: str = prompts.CLASSIFY) -> DataFrame:
    """(doc_id, idx, label) of pieces (doc_id, idx, piece): one request a document."""
    asked = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("at"))
    asked = asked.select("doc_id", F.transform("at", lambda x: x.idx).alias("idx"), prompts.labelling(F.transform("at", lambda x: x.piece), labels, task).alias("prompt"), F.size("at").alias("n"))
    got = call(asked, factory, temperature=0.0).withColumn("response", F.coalesce("response", F.lit("")))
    return got.select("doc_id", F.explode(F.arrays_zip("idx", parse_labels("response", "n", labels).alias("label"))).alias("x")).select("doc_id", "x.idx", "x.label")


def classify_segments(segments: DataFrame, categories, factory: Factory) -> DataFrame:
    """(doc_id, idx, label) of segments (doc_id, idx, text) by their first 200
    characters; without an answer the first category."""
    return _labelled(segments.select("doc_id", "idx", F.left("text", F.lit(prompts.SEGMENT_CHARS)).alias("piece")), factory, tuple(categories))


def classify_chunks(chunks: DataFrame, factory: Factory, labels=SECTION_TYPES) -> DataFrame:
    """chunks with section_type: a first pass, then a second that corrects it."""
    seen = previews(chunks).select("doc_id", F.col("chunk_id").alias("idx"), F.col("preview").alias("piece"))
    first = _labelled(seen, factory, tuple(labels))
    checked = seen.join(first, ["doc_id", "idx"]).select("doc_id", "idx", F.concat(F.lit("["), "label", F.lit("] "), "piece").alias("piece"))
    asked = checked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("at"))
    asked = asked.select("doc_id", F.transform("at", lambda x: x.idx).alias("idx"), prompts.labelling(F.transform("at", lambda x: x.piece), labels, prompts.CORRECT).alias("prompt"), F.size("at").alias("n"))
    got = call(asked, factory, temperature=0.0).withColumn("response", F.coalesce("response", F.lit("")))
    fixes = got.select("doc_id", "idx", F.posexplode(parse_corrections("response", "n", labels)).alias("pos", "x")).select("doc_id", F.element_at("idx", F.col("x.index") + 1).alias("idx"), "pos", F.upper("x.to").alias("to"))
    return chunks.join(apply_corrections(first, fixes).select("doc_id", F.col("idx").alias("chunk_id"), F.col("label").alias("section_type")), ["doc_id", "chunk_id"], "left")


def classification_report(classified: DataFrame) -> DataFrame:
    """(section_type, n), the most frequent first."""
    return classified.groupBy("section_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_type")


def fragment_boundaries(pieces: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, idx, label): KEEP or MERGE for each place between a piece and the next
    (doc_id, i, s), judged by the 80 characters on either side."""
    nxt = F.lead("s").over(Window.partitionBy("doc_id").orderBy("i"))
    edge = F.lit(prompts.EDGE_CHARS)
    sides = pieces.withColumn("after", nxt).where("after is not null")
    return _labelled(sides.select("doc_id", F.col("i").alias("idx"), F.concat(F.right("s", edge), F.lit(" | "), F.left("after", edge)).alias("piece")), factory, ("KEEP", "MERGE"))


def merge_by_labels(pieces: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, g, text): pieces joined over the places labelled MERGE."""
    by_doc = Window.partitionBy("doc_id").orderBy("i")
    rows = pieces.join(boundaries.select("doc_id", (F.col("idx") + 1).alias("i"), "label"), ["doc_id", "i"], "left")
    rows = rows.withColumn("g", F.sum(F.when(F.col("label") == "MERGE", 0).otherwise(1)).over(by_doc))
    return rows.groupBy("doc_id", "g").agg(ordered_join("i", "s", " ").alias("text"))


def paragraph_roles(pieces: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, idx, label): BODY, SECTION_HEADING or FOOTNOTE."""
    return classify_segments(pieces, ("BODY", "SECTION_HEADING", "FOOTNOTE"), factory)


def meta_commentary(pieces: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, idx, meta): whether a rewritten paragraph describes its source. Judged
    are paragraphs whose first sentence has five words or more; others are not meta."""
    first = F.split("text", r"(?<=[.!?])\s+")[0]
    judged = pieces.where(word_count(first) >= 5).select("doc_id", "idx", first.alias("piece"))
    found = _labelled(judged, factory, ("REWRITE", "META"))
    return pieces.select("doc_id", "idx").join(found, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce(F.col("label") == "META", F.lit(False)).alias("meta"))


# ------------------------------------------------------- glossary, summary, notes


def _intros(chapters: DataFrame, each: Column, most: int, chars: int) -> DataFrame:
    """(doc_id, s): something of every chapter, cut to ``most`` characters."""
    rows = chapters.select("doc_id", "chapter_idx", "chapter", F.left("text", F.lit(chars)).alias("piece"))
    return rows.select("doc_id", "chapter_idx", each.alias("s")).groupBy("doc_id").agg(F.left(ordered_join("chapter_idx", "s", "\n\n"), F.lit(most)).alias("s"))


def extract_glossary(chapters: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, glossary map): from the chapters' first 2,000 characters, 12,000 in all;
    without an answer the frequent terms, with their counts."""
    asked = _intros(chapters, F.col("piece"), 12_000, 2_000).select("doc_id", prompts.request(prompts.GLOSSARY, F.col("s")).alias("prompt"))
    got = call(asked, factory, temperature=0.0).withColumn("response", F.coalesce("response", F.lit(""))).select("doc_id", parse_object().alias("answer"))
    whole = chapters.groupBy("doc_id").agg(ordered_join("chapter_idx", "text", "\n\n").alias("text"))
    terms = top_terms(whole.join(got.where(F.size("answer") == 0), "doc_id", "left_semi"))
    own = terms.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "freq"))), lambda x: F.struct(x.term, F.format_string("occurs %d times", x.freq)))).alias("own"))
    return got.join(own, "doc_id", "left").select("doc_id", F.when(F.size("answer") > 0, F.col("answer")).otherwise(F.coalesce("own", F.col("answer"))).alias("glossary"))


def book_summary(chapters: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, summary) from ``[chapter]`` and 2,000 characters of each, 16,000 in all;
    without an answer the start of the first chapter."""
    asked = _intros(chapters, F.concat(F.lit("["), "chapter", F.lit("]\n"), "piece"), 16_000, 2_000).select("doc_id", prompts.request(prompts.SUMMARY, F.col("s")).alias("prompt"))
    got = call(asked, factory).select("doc_id", strip("response").alias("answer"))
    first = chapters.groupBy("doc_id").agg(F.min_by(F.left("text", F.lit(2_000)), "chapter_idx").alias("own"))
    return got.join(first, "doc_id").select("doc_id", F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer")).otherwise(F.concat(F.lit("The book begins: "), "own")).alias("summary"))


def footnotes(chunks: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, term, definition): terms of every chunk of over 20 words; the first
    definition of a term counts."""
    asked = chunks.where(word_count("text") > 20).select("doc_id", "chunk_id", prompts.request(prompts.FOOTNOTES, F.col("text")).alias("prompt"))
    got = call(asked, factory, temperature=0.0).withColumn("response", F.coalesce("response", F.lit("")))
    return one_definition(got.select("doc_id", "chunk_id", F.posexplode(F.map_entries(parse_object())).alias("pos", "e")).select("doc_id", "chunk_id", "pos", F.col("e.key").alias("term"), F.col("e.value").alias("definition")))


def concept_map(docs: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, concept_map): the answer from its code block or first heading on; '' if
    it fails or has under 50 characters."""
    got = call(docs.select("doc_id", prompts.concepts(F.col("text")).alias("prompt")), factory)
    kept = strip(F.coalesce(F.regexp_extract("response", r"(?ms)^(```|#).*\z", 0), F.lit("")))
    return got.select("doc_id", F.when(F.length(kept) >= 50, kept).otherwise("").alias("concept_map"))


def place_concept_map(text: Column, concept: Column) -> Column:
    """Before the rule above the notes, else at the end."""
    at = F.regexp_instr(text, F.lit(r"\n---\s*\n+## (Notes|Footnotes)"))
    placed = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit("\n\n"), concept, F.lit("\n"), F.substring(text, at, F.length(text)))).otherwise(F.concat(text, F.lit("\n\n"), concept))
    return F.when(concept == "", text).otherwise(placed)


# --------------------------------------------------------------------- rewriting


def merge_similar(rows: DataFrame, encode: Callable[[list[str]], list] | None, threshold: float = 0.85, least_words: int = 5) -> DataFrame:
    """(doc_id, g, text) of paragraphs (doc_id, i, s): one that is as similar as that to
    the growing paragraph before joins it. Without an encoder nothing does."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out: list[str] = []
        for s in pdf.sort_values("i")["s"]:
            if out and encode and min(len(s.split()), len(out[-1].split())) >= least_words:
                a, b = (np.asarray(v, float) for v in encode([out[-1], s]))
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                if norm and a @ b / norm >= threshold:
                    out[-1] += " " + s
                    continue
            out.append(s)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "g": range(len(out)), "text": out})

    return rows.groupBy("doc_id").applyInPandas(fold, "doc_id long, g int, text string")


def rewrite_paragraphs(chunks: DataFrame, factory: Factory, context_chars: int = 200, smooth: tuple[float, float] = (0.8, 1.3)) -> DataFrame:
    """(doc_id, chunk_id, text): every paragraph asked for alone, with the end of what
    came before it in the chunk; then smoothed, if that keeps the length. A paragraph
    whose request fails stays. chunks: doc_id, chunk_id, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                parts: list[str] = []
                for p in (p.strip() for p in (r.text or "").split("\n\n")):
                    if not p:
                        continue
                    before = parts[-1][-context_chars:] if parts else ""
                    try:
                        answer = provider.generate(f"{prompts.PARAGRAPH}\n\nAbout {len(p.split())} words.\n\nWhat came before: {before}\n\nTEXT:\n{p}").strip()
                    except Exception:  # a paragraph's failure is its own
                        answer = ""
                    parts.append(answer or p)
                text = "\n\n".join(parts)
                try:
                    smoothed = provider.generate(f"{prompts.SMOOTH}\n\nKeep {len(parts)} paragraphs and about {len(text.split())} words.\n\nTEXT:\n{text}")
                    if smooth[0] <= len(smoothed.split()) / max(1, len(text.split())) <= smooth[1]:
                        text = smoothed
                except Exception:
                    pass
                out.append((r.doc_id, r.chunk_id, text))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "text"])

    return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, "doc_id long, chunk_id int, text string")


def simplify_sequential(chunks: DataFrame, factory: Factory, fallback_chars: int = 300) -> DataFrame:
    """(doc_id, chunk_id, text, bridge): chunks of a document in order, each with a
    bridge that tells what the ones before said: the model's two sentences, or the end
    of the last result. One document is one ordered group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        provider, bridge, out = factory(), "", []
        for r in pdf.sort_values("chunk_id").itertuples():
            try:
                text = provider.generate(f"Rewrite in plain words.\n\nWhat came before: {bridge}\n\nTEXT:\n{r.text}")
            except Exception:
                text = r.text
            out.append((r.doc_id, r.chunk_id, text, bridge))
            try:
                bridge = provider.generate(f"{prompts.BRIDGE}\n\nTEXT:\n{text[-prompts.BRIDGE_CHARS:]}", "", 0.3, 200).strip()
            except Exception:
                bridge = text[-fallback_chars:]
        return pd.DataFrame(out, columns=["doc_id", "chunk_id", "text", "bridge"])

    return chunks.select("doc_id", "chunk_id", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, chunk_id int, text string, bridge string")


def verify_results(chunks: DataFrame, results: DataFrame, factory: Factory) -> DataFrame:
    """(doc_id, chunk_id, verdict, clean); write it beside the results."""
    both = chunks.select("doc_id", "chunk_id", F.col("text").alias("o")).join(results.select("doc_id", "chunk_id", F.col("simplified_text").alias("r")), ["doc_id", "chunk_id"])
    got = call(both.select("doc_id", "chunk_id", prompts.verification(F.col("o"), F.col("r")).alias("prompt")), factory, temperature=0.0)
    verdict = F.coalesce("response", F.lit(""))
    return got.select("doc_id", "chunk_id", verdict.alias("verdict"), F.lower(verdict).rlike("no issues|all preserved").alias("clean"))


def result_summary(results: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, mean_ratio, n_retried, n_flagged) of simplify()'s rows."""
    return results.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg("final_ratio"), 6).alias("mean_ratio"), F.count_if("was_retried").alias("n_retried"), F.count_if(~F.col("qa_passed")).alias("n_flagged"))


def similarity_summary(flags: DataFrame) -> DataFrame:
    """(n, n_flagged, mean) of similarity_flags()'s rows."""
    return flags.agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg("similarity"), 5).alias("mean"))


def region_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
