"""The corpus pipeline: quality rules, n-gram Jaccard join, substring
de-duplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents. ``run`` writes each stage as
Parquet in the shared folder and reads it again.

Null, empty and very short texts fail the quality rules and go there; very long texts
are read whole in every stage. Of rows with one doc_id the n-gram join keeps the first by
its columns, of equal or near-equal texts the smallest doc_id; rows without doc_id stay
until packing, which deals them by their text. Further columns, whatever their names,
are kept until packing, whose rows are segments with their place and token ids. An
empty table gives empty stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from quillspark.llm.common import checkpoint_dir

STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard", ngram_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: MinHash collisions, token ids and bucket boundaries are beyond SQL; tests/llm checks
#: the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
