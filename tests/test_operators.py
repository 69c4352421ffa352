"""Hand-derived cases."""

from pyspark.sql import functions as F

from quillspark.operators import assembly, chunking, cleanup, profile, rewrite, structure
from quillspark.sources.html import markdown


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chapters_inherit_and_drop_empty_bodies(spark):
    rows = structure.detect_chapters(docs(spark, "preamble\n# A\n## B\nbody b\n### C\nbody c", "no heading")).orderBy("doc_id", "chapter_idx").collect()
    assert [(r.doc_id, r.chapter, r.section, r.text, r.heading_level) for r in rows] == [(0, "A", "B", "body b", 2), (0, "A", "C", "body c", 3), (1, "Full Document", "", "no heading", 1)]


def test_prose_is_absorbed_by_a_list(spark):
    c = docs(spark, "prose\n\nprose\n1. a\nwrapped\n\nprose\n- b\n# H\n# H2\nbody\n* c").withColumn("chapter_idx", F.lit(0))
    assert [r.seg_type for r in structure.split_segments(c).orderBy("seg_idx").collect()] == ["prose", "numbered", "bullet", "heading", "prose", "bullet"]


def test_primary_sequence(spark):
    items = structure.numbered_items(docs(spark, "\n".join(f"{n}. x" for n in (1, 2, 7, 3, 4, 4, 6))))
    assert [r.major for r in structure.primary_sequence(items).orderBy("pos").collect()] == [True, True, False, True, True, False, True]


def test_packing_and_overlap(spark):
    text = "\n".join(["# A", "p" * 360, "- " + "q" * 398, "1. " + "r" * 117])
    chunks = chunking.create_chunks(structure.detect_chapters(docs(spark, text)), 200, 5).orderBy("chunk_id").collect()
    assert [len(c.raw) for c in chunks] == [360 + 2 + 400, 120]
    assert chunks[1].text.startswith("q" * 20 + "\n\n1. r") and chunks[0].is_chapter_start


def test_duplicate_paragraphs_and_headings(spark):
    long = "x" * 101
    out = cleanup.drop_duplicate_paragraphs(docs(spark, f"A\n\nA\n\n\n\nA\n\n{long} a\n\n{long} b")).first().text
    assert out == f"A\n\n\n\nA\n\n{long} a"
    assert cleanup.drop_duplicate_headings(docs(spark, "# T\n\n## T\nx\n## T")).first().text == "# T\n\nx\n## T"


def test_repeated_sentence_goes(spark):
    t = "The green river flows north. Birds sing loudly today. Rain fell again yesterday. The green river flows north."
    assert docs(spark, t).select(cleanup.drop_repeated_sentences(F.col("text")).alias("t")).first().t == t[: t.rindex("The") - 1]


def test_labels_are_padded_and_cut(spark):
    df = spark.createDataFrame([('```json\n["body","nope"]\n```', 3), ("none", 2), ('["APPENDIX","BODY"]', 1)], "response string, n int")
    assert [r.x for r in df.select(rewrite.parse_labels("response", "n").alias("x")).collect()] == [["BODY"] * 3, ["BODY"] * 2, ["APPENDIX"]]


def test_elements_round_trip():
    text = "a ![x](y) $a$\n|a|\n|b|\nz\n|c|\n|d|\n$$q$$"
    bare, marks = rewrite.strip_elements(text)
    assert marks["<<TABLE_1>>"] == "|c|\n|d|" and "|" not in bare
    for k in reversed(marks):
        bare = bare.replace(k, marks[k])
    assert bare == text


def test_footnotes_longer_terms_first(spark):
    df = docs(spark, "The law of value and the law.").withColumn("notes", F.create_map(F.lit("law"), F.lit("l"), F.lit("law of value"), F.lit("v")))
    text = assembly.insert_footnotes(df).first().text
    assert "[^1]: **law of value** — v" in text and "[^2]: **law** — l" in text


def test_realign_rounds_half_even_and_keeps_all(spark):
    df = spark.createDataFrame([(0, " ".join("a" * 30) + "\n\n" + " ".join("b" * 70), "1\n\n2\n\n3\n\n4\n\n5")], "doc_id long, original string, result string")
    assert [r.text for r in assembly.realign(df).orderBy("slot").collect()] == ["1 2", "3 4 5"]


def test_reference_flag(spark):
    cite = "Marx, K. (1997). Capital. University Press, pp. 12"
    assert [r.x for r in docs(spark, cite + "\n" + cite, "A plain line of prose here.", "").select(profile.is_reference().alias("x")).collect()] == [True, False, False]


def test_html_invariants():
    out = markdown('<html><head><script>var t="</p>";</script></head><body><h1>A &amp; b</h1><p>x <b>y<br>z</p><ul><li>1</li></ul>')
    assert out.startswith("# A & b") and "<" not in out and "- 1" in out and "var t" not in out


def test_no_window_without_partition(spark):
    plan = chunking.create_chunks(structure.detect_chapters(docs(spark, "# A\nb")))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
