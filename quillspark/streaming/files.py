"""Documents that arrive as files: the per-document operators on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def stream_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through a batch operator into a folder of its own, so a batch
    that is run again replaces what it wrote before."""

    def batch(df: DataFrame, epoch: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
