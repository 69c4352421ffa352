"""Every query with SQL against DuckDB on the smallest tables."""

import hashlib

import duckdb
import pytest

from quillspark.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b)]
    assert rows[0].equals(rows[1])


@pytest.mark.parametrize("name", ["repeated_sentences", "trim_overlaps", "html_to_markdown", "simplify_stub", "layout_markdown", "label_normalise_pad"])
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_line_queries_take_all_lines(spark, tmp_path):
    texts = {k: [f"line {i} of document {k}" for i in range(20)] for k in range(4)}
    texts[2][15] = texts[2][1][:12]
    spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fixed = {k: ["" if i == 2 else "fixed" if i == 4 else x for i, x in enumerate(t)] for k, t in texts.items()}
    got = {r.doc_id: r.text_md5 for r in QUERIES["line_corrections"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5("\n".join(t).encode()).hexdigest() for k, t in fixed.items()}
    got = {r.doc_id: r.heading for r in QUERIES["heading_fuzzy_match"](spark, str(tmp_path)).collect()}
    assert got == {k: t[15] if k == 2 else t[1] for k, t in texts.items()}


AUTHOR = "MARX K. Capital as a whole is a long book"


@pytest.mark.parametrize("name", ["chunk_overlap", "chunk_stats", "detect_chapters", "extraction_validation", "split_segments", "next_fit_chunks"])
def test_headings_with_authors_are_as_in_sql(spark, tmp_path, name):
    texts = [AUTHOR + "\n" + "\n".join(f"line {i} of document {k}" for i in range(4)) + f"\nx\n{AUTHOR}\n{'BY' * k}\n\n\n\n\nlast\n" + "word " * 700 * k for k in range(3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    a, b = QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert len(b)
    rows = [x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b)]
    assert rows[0].equals(rows[1])


def test_chapters_of_odd_lines_are_as_in_sql(spark, tmp_path):
    odd = ["\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　"]
    texts = ["", "\n\n", "\nx\ny", None, *[f"{c}a{c}b{c}\n{c}c{c}\n" + f"d{c}\n" * 12 + c for c in odd], *[f"a\n{c}\n##{c}b\nc" for c in odd]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cols = "doc_id, chapter_idx, chapter, section, heading_level, text_md5"
    got = {tuple(r) for r in QUERIES["detect_chapters"](spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect()}
    assert got == set(c.sql(f"select {cols} from ({SQL['detect_chapters']})").fetchall())
