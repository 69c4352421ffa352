"""Chapters, segments, numbered sequences and the structure of documents.

Positions are explicit everywhere, every window is partitioned by the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, matches, ordered_join, strip, strip_ascii, word_count

HEADING = r"^(#{1,6})\s+(.+)$"
#: A heading as SQL has it: a carriage return or another line separator ends no line.
_SQL_HEADING = r"(?s)^(#{1,6})[\t\n\f\r ]+(.+)\z"
NUMBERED = r"^\d+[\.\)]\s"
BULLET = r"^[-*•]\s"
_AUTHOR_HEADING = r"^([A-Z][A-Z\s.'-]{2,30}?)\s+([A-Z][a-z].{20,})$"


def clean_markdown(text: Column) -> Column:
    """Author names taken out of headings, overlong headings split at their first
    sentence, lone BY lines blanked, runs of blank lines shortened."""

    def line(x):
        level, title = F.regexp_extract(x, HEADING, 1), F.regexp_extract(x, HEADING, 2)
        author, rest = F.regexp_extract(title, _AUTHOR_HEADING, 1), F.regexp_extract(title, _AUTHOR_HEADING, 2)
        first = F.regexp_extract(title, r"^(.*?[.!?])\s+([A-Z].*)$", 1)
        after = F.regexp_extract(title, r"^(.*?[.!?])\s+([A-Z].*)$", 2)
        return (
            F.when((level != "") & (author != ""), F.concat(F.lit("\n**"), author, F.lit("**\n"), level, F.lit(" "), rest))
            .when((level != "") & (F.length(title) > 120) & (first != ""), F.concat(level, F.lit(" "), first, F.lit("\n\n"), after))
            .when(strip(x) == "BY", F.lit(""))
            .otherwise(x)
        )

    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n", -1), line), "\n"), "\n{4,}", "\n\n\n")


def detect_chapters(docs: DataFrame, clean: bool = True, keep_preamble: bool = False, whole: bool = True) -> DataFrame:
    """(doc_id, chapter_idx, chapter, section, text, heading_level). Text before
    the first heading is dropped unless kept; headings without a body give no row
    but still name the chapter of those below. A text without headings is one chapter
    if ``whole``, else none. White space and headings are as in SQL."""
    docs = docs.select("doc_id", (clean_markdown(F.col("text")) if clean else F.col("text")).alias("text"))
    by_line = Window.partitionBy("doc_id").orderBy("i")
    rows = lines(docs).withColumn("level", F.length(F.regexp_extract("s", _SQL_HEADING, 1)))
    rows = rows.withColumn("g", F.sum((F.col("level") > 0).cast("int")).over(by_line))
    heads = rows.withColumn("body", F.when(F.col("level") == 0, F.col("s"))).groupBy("doc_id", "g").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level") > 0, strip_ascii(F.regexp_extract("s", _SQL_HEADING, 2)))).alias("title"),
        # A null body, the heading's own, is left out of the join.
        strip_ascii(F.coalesce(ordered_join("i", "body", "\n"), F.lit(""))).alias("text"),
    )
    by_heading = Window.partitionBy("doc_id").orderBy("g")
    heads = heads.withColumns({
        "top": F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(by_heading),
        "last_g": F.max("g").over(Window.partitionBy("doc_id")),
    })
    plain = (F.col("last_g") == 0) & F.lit(whole)
    kept = heads.where((F.col("text") != "") & ((F.col("g") > 0) | plain | F.lit(keep_preamble)))
    return kept.select(
        "doc_id",
        (F.row_number().over(by_heading) - 1).alias("chapter_idx"),
        F.when(plain, "Full Document").otherwise(F.coalesce("top", "title", F.lit(""))).alias("chapter"),
        F.when(F.col("level") > 1, F.col("title")).otherwise("").alias("section"),
        "text",
        F.when(plain, 1).otherwise(F.col("level")).cast("int").alias("heading_level"),
    )


def split_segments(chapters: DataFrame, keys=("doc_id", "chapter_idx")) -> DataFrame:
    """(keys, seg_idx, seg_type, text). A line without a marker goes on with a list
    if the last marker was one and is prose otherwise; blank lines separate nothing."""
    by_line = Window.partitionBy(*keys).orderBy("i")
    t = strip(F.col("s"))
    rows = lines(chapters, keys=keys).withColumn("t", t)
    marker = F.when(F.col("t").rlike(NUMBERED), "numbered").when(F.col("t").rlike(BULLET), "bullet").when(F.col("t").rlike(r"^#{1,6}\s+"), "heading")
    rows = rows.withColumn("m", marker)
    last = F.last("m", ignorenulls=True).over(by_line)
    rows = rows.withColumn("eff", F.when(F.col("t") != "", F.coalesce("m", F.when(last.isin("numbered", "bullet"), last).otherwise("prose"))))
    before = F.last("eff", ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (F.col("eff").isNotNull() & (before.isNull() | (before != F.col("eff")))).cast("int"))
    rows = rows.withColumn("g", F.sum("new").over(by_line))
    out = rows.where("g > 0").groupBy(*keys, "g").agg(F.first("eff", ignorenulls=True).alias("seg_type"), strip(ordered_join("i", "s", "\n")).alias("text"))
    return out.select(*keys, (F.col("g") - 1).cast("int").alias("seg_idx"), "seg_type", "text")


def numbered_items(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, number, preview, n_words): items from a numbered line up to the
    next one."""
    by_line = Window.partitionBy("doc_id").orderBy("i")
    rows = lines(docs).withColumn("number", F.regexp_extract("s", r"^(\d+)[\.\)]\s", 1))
    rows = rows.withColumn("pos", F.sum((F.col("number") != "").cast("int")).over(by_line)).where("pos > 0")
    rows = rows.withColumn("s", F.when(F.col("number") != "", F.regexp_replace("s", r"^\d+[\.\)]\s", "")).otherwise(F.col("s")))
    items = rows.groupBy("doc_id", "pos").agg(F.max(F.when(F.col("number") != "", F.col("number").cast("long"))).alias("number"), strip(ordered_join("i", "s", "\n")).alias("item"))
    return items.select("doc_id", F.col("pos").cast("int").alias("pos"), "number", F.replace(F.substring("item", 1, 120), F.lit("\n"), F.lit(" ")).alias("preview"), word_count("item").alias("n_words"))


def primary_sequence(items: DataFrame) -> DataFrame:
    """(doc_id, pos, number, major): which items belong to the main sequence. An
    item that would skip numbers is minor if any of these comes later, or if it
    skips more than two."""
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("a"))
    fold = """aggregate(a, named_struct('next', 1L, 'used', cast(array() as array<bigint>), 'major', cast(array() as array<int>)), (z, x) ->
      case when x.number >= z.next and not array_contains(z.used, x.number)
            and (x.number = z.next or (x.number <= z.next + 2 and not exists(a, y -> y.pos > x.pos and y.number >= z.next and y.number < x.number)))
        then named_struct('next', x.number + 1L, 'used', concat(z.used, array(x.number)), 'major', concat(z.major, array(x.pos)))
        else z end)"""
    rows = rows.select("doc_id", "a", F.expr(fold).getField("major").alias("major"))
    return rows.select("doc_id", F.explode("a").alias("x"), "major").select("doc_id", F.col("x.pos").alias("pos"), F.col("x.number").alias("number"), F.array_contains("major", F.col("x.pos")).alias("major"))


def document_structure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_major, n_minor, n_headings, bullet_groups, segment_type)."""
    seq = primary_sequence(numbered_items(docs)).groupBy("doc_id").agg(F.sum(F.col("major").cast("long")).alias("n_major"), F.sum((~F.col("major")).cast("long")).alias("n_minor"))
    out = docs.select("doc_id", matches("text", r"(?md)^#{1,6}\s+.+$").alias("n_headings"), matches("text", r"(?md)(?:^[-*•]\s.*\n?)+").alias("bullet_groups")).join(seq, "doc_id", "left").fillna(0, ["n_major", "n_minor"])
    return out.withColumn("segment_type", F.when(F.col("n_major") >= 3, "numbered").when(F.col("n_headings") >= 3, "headed").otherwise("unstructured"))
