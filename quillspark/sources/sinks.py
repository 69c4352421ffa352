"""Sinks: one Markdown row a document, stage tables, and results for a resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_markdown(docs: DataFrame, path: str) -> None:
    """A JSON line a document with its id and text, in as many files as partitions."""
    docs.select("doc_id", "text").write.mode("overwrite").json(path)


def write_markdown_files(docs: DataFrame, path: str, name: str = "doc_id") -> None:
    """A file a document, written by the executors into a folder that all of them
    share: for the books of one project, not for millions."""

    def save(rows):
        import pathlib

        for r in rows:
            where = pathlib.Path(path, f"{int(r[name]) % 1000:03d}")
            where.mkdir(parents=True, exist_ok=True)
            part = where / f".{r[name]}.part"
            part.write_text(r["text"] or "", encoding="utf-8")
            part.replace(where / f"{r[name]}.md")

    docs.select(name, "text").foreachPartition(save)


def write_stage(df: DataFrame, base: str, name: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{base}/{name}")


def append_results(results: DataFrame, path: str) -> None:
    """Results are added, never rewritten."""
    results.write.mode("append").parquet(path)


def read_stage(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{base}/{name}")


def pending(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a result."""
    return chunks.join(results.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
