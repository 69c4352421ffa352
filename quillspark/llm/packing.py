"""Packing: optimal length buckets over the global histogram.

A document's ids and its end id are cut into segments of at most ``max_len`` (nothing
is dropped), lengths are counted in steps of ``step`` tokens, and dynamic programming
chooses the ``buckets`` boundaries, multiples of the step, that minimise the total
padding, exactly on that grid, over the histogram of all segments. Its size is
max_len / step whatever the input. Inside a bucket, batches take
floor(token_budget / boundary) segments each, in order of doc_id.

A bucket may hold any share of the rows: rows are dealt by ranges of (bucket,
doc_id, text's hash, segment), numbered inside each range, and shifted by the ranges
before. ``batch_ids`` gives the segments their ids, padded to the bucket's length.

Edge cases: null and empty texts are their end id alone, one segment in the first
bucket; ties and repeated rows stand next to each other; rows without doc_id are dealt
by their text; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, release, small_arrow, trim
from .tokens import END_ID, pieces_of

MAX_LEN = 4096
STEP = 8
BUCKETS = 16
TOKEN_BUDGET = 65_536


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, h, n_tokens) of every row: a hash of its text, its ids and the end id."""

    def run(batches):
        pieces = pieces_of(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) + 1 for x in pieces.batch(batch.column(2))], pa.int64())], ["doc_id", "h", "n_tokens"])
        trim()

    small_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n_tokens long")


def boundaries(counts: np.ndarray, step: int = STEP, buckets: int = BUCKETS) -> list[int]:
    """counts[i]: segments of up to (i + 1) * step tokens. The boundaries, ascending,
    of at most this many buckets with the least padding; the last holds the
    longest segment. Ties: the smaller boundary."""
    used = np.flatnonzero(counts)
    if not len(used):
        return [step]
    n = counts[used].astype(np.float64)
    length = (used + 1.0) * step
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * length)])
    m = len(used)
    # cost[i, j]: lengths i..j padded to length j
    cost = length[None, :] * (rows[1:][None, :] - rows[:-1][:, None]) - (tokens[1:][None, :] - tokens[:-1][:, None])
    cost[np.tril_indices(m, -1)] = np.inf
    best, cuts = cost[0].copy(), []
    for _ in range(min(buckets, m) - 1):
        total = np.vstack([best[None, :], best[:-1, None] + cost[1:]])
        # row 0: no cut added; row i: the last bucket begins at length i
        pick = np.argmin(total, axis=0)
        cuts.append(pick)
        best = total[pick, np.arange(m)]
    out, j, k = [], m - 1, len(cuts)
    while j >= 0:
        out.append(int(length[j]))
        i = 0
        while k and not i:
            k -= 1
            i = int(cuts[k][j])
        j = i - 1
    return out[::-1]


def segments(lengths: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, h, n_tokens, segment, length): a row for each piece of max_len tokens."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / max_len)).cast("int")
    df = lengths.select("doc_id", "h", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("segment"))
    return df.withColumn("length", F.least(F.lit(max_len), F.col("n_tokens") - F.col("segment").cast("long") * max_len).cast("long"))


def pack(lengths: DataFrame, max_len: int = MAX_LEN, step: int = STEP, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, h, segment, n_tokens, length, bucket, bucket_length, batch, place) of
    lengths (doc_id, h, n_tokens)."""
    segs = segments(lengths, max_len)
    slot = F.greatest(F.lit(1), F.ceil(F.col("length") / step)).cast("int")
    histogram = segs.groupBy(slot.alias("slot")).count().collect()  # max_len / step rows at most
    counts = np.zeros(max(1, max_len // step + 1), np.int64)
    for r in histogram:
        counts[r["slot"] - 1] = r["count"]
    ends = boundaries(counts, step, buckets)
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[i], i).otherwise(bucket)
    order = ["bucket", "doc_id", "h", "segment", "length"]
    dealt = segs.withColumn("bucket", bucket.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its upper 31 bits and the row in the lower 33.
    dealt = durable(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("_part"), "bucket").agg(F.count("*").alias("_n"), F.min("_id").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))  # a row for each partition and bucket
    ranked = dealt.withColumn("_part", part).join(F.broadcast(starts.select("_part", "bucket", "_from", "_before")), ["_part", "bucket"])
    length = F.element_at(F.array(*[F.lit(x) for x in ends]), F.col("bucket") + 1).cast("long")
    rank = F.col("_before") + F.col("_id") - F.col("_from")
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / length)).cast("long")
    return ranked.select("doc_id", "h", "segment", "n_tokens", "length", "bucket", length.alias("bucket_length"), F.floor(rank / rows).cast("long").alias("batch"), F.pmod(rank, rows).cast("long").alias("place"))


_PLACE = ["segment", "n_tokens", "length", "bucket", "bucket_length", "batch", "place"]


def batch_ids(docs: DataFrame, placed: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, pad_id: int = END_ID) -> DataFrame:
    """pack()'s rows with their ids, padded to bucket_length; a reader that takes rows of
    one bucket and batch in order of place has the batch. Equal rows of docs are read once."""
    asked = placed.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*_PLACE)).alias("_at"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_h"), "text").dropDuplicates(["_doc", "_h"])
    schema = "doc_id long, segment int, n_tokens long, length long, bucket int, bucket_length long, batch long, place long, ids array<int>"

    def run(batches):
        pieces = pieces_of(tokenizer_path)
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), batch.column(2)
            for i, x in enumerate(pieces.batch(batch.column(1))):
                x = np.append(x, end_id).astype(np.int32)
                places = at[i].as_py()
                out = [np.pad(x[p["segment"] * max_len : (p["segment"] + 1) * max_len], (0, p["bucket_length"] - p["length"]), constant_values=pad_id) for p in places]
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                columns = [pa.array([p[c] for p in places], pa.int32() if c in ("segment", "bucket") else pa.int64()) for c in _PLACE]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(places), pa.int64()), *columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))], ["doc_id", *_PLACE, "ids"])
        trim()

    small_arrow(docs.sparkSession)
    same = texts["_doc"].eqNullSafe(asked["doc_id"]) & (texts["_h"] == asked["h"])
    return texts.join(asked, same).select("_doc", "text", "_at").mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = durable(token_lengths(read(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer()))
    return pack(lengths).drop("h")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every segment's bucket, batch, place and ids."""
    lengths = durable(token_lengths(docs.select("doc_id", "text"), default_tokenizer()))
    placed = durable(pack(lengths))
    release(lengths)
    return batch_ids(docs.select("doc_id", "text"), placed, default_tokenizer())
