"""Frequent terms of a document and one definition a term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Common words that are no terms; a parameter of ``top_terms``.
COMMON_WORDS = (
    "that with this from have they which were their there been would when what will more about into than them then some "
    "these those such only other also over after before between through under while where because being both each even "
    "could should might must shall does done made make many most much very just like well back still even down upon same "
    "your ours ourselves himself herself itself themselves against during without within among another again first last"
).split()
MIN_COUNT = 3
LIMIT = 30


def top_terms(docs: DataFrame, common=COMMON_WORDS, min_count: int = MIN_COUNT, limit: int = LIMIT) -> DataFrame:
    """(doc_id, rank, term, freq): words of four ASCII letters or more, by count,
    then by first appearance. A term's count is made before anything is ranked."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0))).alias("pos", "term"))
    counted = found.where(~F.col("term").isin(*common)).groupBy("doc_id", "term").agg(F.count("*").alias("freq"), F.min("pos").alias("first")).where(F.col("freq") >= min_count)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("freq"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).select("doc_id", "rank", "term", "freq")


def one_definition(terms: DataFrame) -> DataFrame:
    """(doc_id, term, definition): of the first chunk and place that has it."""
    return terms.groupBy("doc_id", "term").agg(F.min_by("definition", F.struct("chunk_id", "pos")).alias("definition"))
