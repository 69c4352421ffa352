"""Page layout analysis on spans: body font, lines, headings, footnotes, paragraphs.

spans: doc_id, page, page_height, block, block_type, block_y0, line, line_y, span,
text, size, flags, font."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordered_join, strip

KEYWORDS = r"^(chapter|part|section|introduction|conclusion|abstract|preface|appendix)\b"
DEFAULT_GAP = 14.0


def body_fonts(spans: DataFrame) -> DataFrame:
    """(doc_id, body, footnote, superscript): the size with the most characters."""
    t = F.length(strip(F.col("text")))
    rows = spans.where((F.col("block_type") == 0) & (t >= 2)).groupBy("doc_id", F.bround("size", 1).alias("size")).agg(F.sum(t).alias("n"), F.min(F.struct("page", "block", "line", "span")).alias("first"))
    # Of equal sums the size that is seen first.
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return rows.withColumn("k", rank).where("k = 1").select("doc_id", F.col("size").alias("body"), (F.col("size") - 1.5).alias("footnote"), (F.col("size") - 3.0).alias("superscript"))


def layout_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, y, page_height, text, size, bold, numbered, kind, level, body)"""
    rows = spans.where("block_type = 0").join(body_fonts(spans), "doc_id")
    t = strip(F.col("text"))
    rows = rows.where(~((F.col("size") < F.col("superscript")) & (F.length(t) <= 3)))
    bold = F.col("flags").bitwiseAND(16).cast("boolean") | F.col("font").contains("Bold")
    keys = ["doc_id", "page", "block", "line"]
    out = rows.groupBy(*keys).agg(
        strip(ordered_join("span", "text", "")).alias("text"), F.max(F.when(F.length(t) > 1, F.col("size"))).alias("size"),
        F.bool_and(F.when(t != "", bold)).alias("bold"), F.min_by("text", "span").alias("lead"), F.min("line_y").alias("y"), F.min("block_y0").alias("block_y0"),
        F.first("page_height").alias("page_height"), F.first("body").alias("body"), F.first("footnote").alias("footnote"),
    ).where("text <> ''").fillna(0.0, ["size"])
    numbered = strip(F.col("lead")).rlike(r"^\d+[\.\)]\s*$") & (F.col("size") >= F.col("body") - 0.5)
    caps = (F.length("text") > 3) & F.col("text").rlike(r"\p{L}") & (F.upper("text") == F.col("text"))
    keyword = F.lower("text").rlike(KEYWORDS)
    out = out.withColumns({"numbered": numbered, "bold": F.coalesce("bold", F.lit(False))})
    signals = F.col("bold").cast("int") + caps.cast("int") + keyword.cast("int")
    level = F.when(F.col("size") > F.col("body") + 3, 1).when(F.col("size") > F.col("body") + 1.5, 2).when(
        (F.length("text") < 80) & ~F.col("numbered"), F.when(signals >= 2, 2).when((signals == 1) & (F.col("bold") | keyword), 3)
    )
    foot = (F.col("size") > 0) & (F.col("size") <= F.col("footnote")) & (F.col("y") > 0.65 * F.col("page_height"))
    return out.withColumns({"level": F.when(~foot, level), "kind": F.when(foot, "footnote").otherwise("body")})


def _order():
    return Window.partitionBy("doc_id").orderBy("page", "block_y0", "block", "line")


def footnotes(rows: DataFrame) -> DataFrame:
    """(doc_id, island, text): runs of footnote lines on one page."""
    by = Window.partitionBy("doc_id", "page").orderBy("block_y0", "block", "line")
    new = ((F.col("kind") == "footnote") & (F.coalesce(F.lag("kind").over(by), F.lit("")) != "footnote")).cast("int")
    out = rows.withColumn("new", new).withColumn("island", F.sum("new").over(_order())).withColumn("k", F.row_number().over(_order()))
    return out.where("kind = 'footnote'").groupBy("doc_id", "island").agg(ordered_join("k", "text", " ").alias("text"))


def body_paragraphs(rows: DataFrame, last_page_only: bool = True) -> DataFrame:
    """(doc_id, paragraph, level, text). The usual gap is the upper median of the
    positive gaps, of the last page only unless asked otherwise."""
    by = Window.partitionBy("doc_id", "page").orderBy("block_y0", "block", "line")
    rows = rows.where("kind = 'body'").withColumn("gap", F.col("y") - F.lag("y").over(by))
    last = F.max("page").over(Window.partitionBy("doc_id"))
    gaps = rows.withColumn("last", last).where((F.col("gap") > 0) & ((F.col("page") == F.col("last")) | F.lit(not last_page_only)))
    usual = gaps.groupBy("doc_id").agg(F.array_sort(F.collect_list("gap")).alias("g")).select("doc_id", F.get("g", F.expr("size(g) div 2")).alias("usual"))
    rows = rows.join(usual, "doc_id", "left").fillna(DEFAULT_GAP, ["usual"])
    order = _order()
    new = F.col("gap").isNull() | (F.col("gap") > 1.5 * F.col("usual")) | F.col("numbered") | F.col("level").isNotNull() | F.lag(F.col("level").isNotNull()).over(order)
    rows = rows.withColumn("paragraph", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order)).withColumn("k", F.row_number().over(order))
    out = rows.groupBy("doc_id", "paragraph").agg(F.max("level").alias("level"), ordered_join("k", "text", " ").alias("text"))
    return out.withColumn("text", F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text")))


def to_markdown(spans: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs, then the footnotes as a list behind a rule."""
    rows = layout_lines(spans)
    body = body_paragraphs(rows).groupBy("doc_id").agg(ordered_join("paragraph", "text", "\n\n").alias("body"))
    notes = footnotes(rows).withColumn("text", F.concat(F.lit("- "), "text")).groupBy("doc_id").agg(ordered_join("island", "text", "\n").alias("notes"))
    text = F.concat_ws("\n\n", "body", F.when(F.col("notes").isNotNull(), F.concat(F.lit("---\n\n## Original Document Footnotes\n\n"), "notes")))
    return body.join(notes, "doc_id", "full").select("doc_id", F.regexp_replace(text, "\n{4,}", "\n\n\n").alias("text"))


def regions_to_markdown(regions: DataFrame) -> DataFrame:
    """(doc_id, text) of labelled regions (doc_id, page, label, y, text)."""
    foot = F.col("label").isin("Footnote", "PageFooter")
    text = F.when(F.col("label") == "Title", F.concat(F.lit("# "), "text")).when(F.col("label") == "SectionHeader", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    rows = regions.where("label <> 'PageHeader'").withColumns({"part": foot.cast("int"), "k": F.struct("page", "y"), "text": text})
    parts = rows.groupBy("doc_id", "part").agg(ordered_join("k", "text", "\n\n").alias("text"))
    return parts.groupBy("doc_id").agg(ordered_join("part", "text", "\n\n---\n\n").alias("text"))
