"""Book files: discovery, EPUB chapters, and the page and span tables of a PDF
adapter (a reader is plugged in; none is bundled)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import markdown

# Names of parts of a book that are not chapters.
SKIP_NAMES = "title|copyright|cover|toc|nav|colophon|dedication|contents"
REFERENCE_HEADINGS = (r"\breferences\b", r"\bbibliography\b", r"\bworks?\s+cited\b", r"\bliterature\s+cited\b", r"\bcited\s+works?\b", r"\bsources\b", r"\bendnotes\b", r"\bnotes\s+and\s+references\b", r"\bfurther\s+reading\b")
# Authors that are no persons.
TOOL_NAMES = ("acrobat", "adobe", "microsoft", "scanner", "unknown", "user")
SPANS = "doc_id long, page int, page_height double, block int, block_type int, block_y0 double, line int, line_y double, span int, text string, size double, flags int, font string"


def find_books(spark: SparkSession, path: str) -> DataFrame:
    """Every PDF and EPUB below path: (path, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,epub}").option("recursiveFileLookup", "true").load(path)


def epub_items(content: bytes) -> list[tuple[int, str, str]]:
    """(spine index, name, html) in reading order."""
    z = zipfile.ZipFile(io.BytesIO(content))
    root = next(x.get("full-path") for x in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if x.tag.endswith("rootfile"))
    opf = ElementTree.fromstring(z.read(root))
    items = {x.get("id"): x.get("href") for x in opf.iter() if x.tag.endswith("}item")}
    out = []
    for k, x in enumerate(x for x in opf.iter() if x.tag.endswith("}itemref")):
        if name := items.get(x.get("idref")):
            out.append((k, name, z.read(posixpath.join(posixpath.dirname(root), name)).decode("utf-8", "replace")))
    return out


def epub_rows(content: bytes) -> list[tuple]:
    """(chapter_idx, chapter, section, text, heading_level, spine_index)"""

    def rows(kept, word, least):
        out = []
        for k, _, html in kept:
            text = markdown(html)
            if len(text) < least or not text:
                continue
            m = re.match(r"(#{1,6})\s+(.+)", text)
            out.append((len(out), m[2].strip() if m else f"{word} {len(out) + 1}", "", text, len(m[1]) if m else 1, k))
        return out

    items = epub_items(content)
    return rows([x for x in items if not re.search(SKIP_NAMES, x[1].lower())], "Chapter", 1) or rows(items, "Section", 50)


def epub_chapters(files: DataFrame) -> DataFrame:
    """(doc_id, chapter_idx, chapter, section, text, heading_level, spine_index) of
    files (doc_id, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(r.doc_id, *x) for r in pdf.itertuples() for x in epub_rows(bytes(r.content))]
            yield pd.DataFrame(out, columns=["doc_id", "chapter_idx", "chapter", "section", "text", "heading_level", "spine_index"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, chapter_idx int, chapter string, section string, text string, heading_level int, spine_index int")


def pdf_spans(files: DataFrame, reader: Callable[[bytes], list[tuple]]) -> DataFrame:
    """The span table of files (doc_id, content); reader gives a file's rows without
    the doc_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(r.doc_id, *x) for r in pdf.itertuples() for x in reader(bytes(r.content))], columns=[c.split()[0] for c in SPANS.split(", ")])

    return files.select("doc_id", "content").mapInPandas(run, SPANS)


def toc_pages(pages: DataFrame, first: int = 4) -> DataFrame:
    """(doc_id, has_toc): a contents heading with two dotted leaders, or five of
    them, on one of the first pages (doc_id, page, text)."""
    leaders = F.regexp_count("text", F.lit(r"\.{3,}\s*\d+"))
    page = (F.col("text").rlike(r"(?i)\b(table of )?contents\b") & (leaders >= 2)) | (leaders >= 5)
    return pages.where(F.col("page") < first).groupBy("doc_id").agg(F.bool_or(page).alias("has_toc"))


def references_start(pages: DataFrame, last: int = 5) -> DataFrame:
    """(doc_id, page): the first of the last pages with a line of 40 characters at
    most that names references."""
    n = pages.groupBy("doc_id").agg((F.max("page") - last).alias("after"))
    rows = pages.join(n, "doc_id").where("page > after").select("doc_id", "page", F.explode(F.split(F.lower("text"), "\n")).alias("s"))
    return rows.where((F.length(F.trim("s")) <= 40) & F.col("s").rlike("|".join(REFERENCE_HEADINGS))).groupBy("doc_id").agg(F.min("page").alias("page"))


def metadata(raw: DataFrame) -> DataFrame:
    """(doc_id, title, author) tidied: no file names, no tools, no capitals only."""
    t, a = F.trim("title"), F.trim("author")
    title = F.when((t == "") | t.endswith(".pdf") | t.endswith(".PDF"), None).when((F.length(t) > 5) & (F.upper(t) == t), F.initcap(t)).otherwise(t)
    tool = F.lower(a).isin(*TOOL_NAMES)
    author = F.when((a == "") | tool, None).when((F.length(a) > 2) & (F.upper(a) == a), F.initcap(a)).otherwise(a)
    return raw.select("doc_id", title.alias("title"), author.alias("author"))
