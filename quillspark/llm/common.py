"""Helpers shared by the operators of this subpackage.

* ``durable`` cuts lineage through a table in the shared folder, ``release`` deletes it.
* ``TextBlocks`` turns Arrow string columns into numpy word arrays, one slice of
  about a megabyte at a time, so memory does not depend on the batch size.
* ``among`` leaves out, before a shuffle, most rows that a join will not take.
* ``stream_pairs`` brings the two texts of candidate pairs together without
  holding a group in memory; hot pivots are dealt over salted groups.
* ``components`` labels connected components with distributed star contraction.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most (bytes are bounded by Spark itself).
ARROW_ROWS = 2000
#: Bytes of text that one numpy pass handles; a longer document is one pass.
SLICE_BYTES = 1 << 20
#: The same for operators whose passes hold many arrays of a slice at once.
SMALL_SLICE = 1 << 18
#: Bits a key of ``among``, and 64-bit words of its table at most (8 MB).
KEY_BITS = 16
MOST_WORDS = 1 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a local master
    gets a temporary one; elsewhere executors would not see it, so that fails."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quill-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables in the shared folder that this process has written and not deleted.
_written: set[str] = set()


def durable(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors do not lose it,
    and what made it need not be kept. ``release`` deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quill-table-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def release(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_quill_path", None):
            _delete(df.sparkSession, path)
    collect_shuffles(tables[0].sparkSession)


def collect_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files that no plan needs any more once the driver has
    collected its garbage, so that is asked for."""
    gc.collect()
    spark._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete every table of this process that is left; results must be written."""
    for path in list(_written):
        _delete(spark, path)


def trim() -> None:
    """Give memory that is free back to the system: idle Python workers keep theirs."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def small_arrow(spark: SparkSession) -> None:
    """Keep Arrow batches of text columns small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def among(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of df whose keys are those of a row of wanted (columns in the order of
    keys, of their types), and a few others: a table of their hashes' bits is broadcast,
    2 bytes a key. It is for the side of an inner join on the keys that has wide rows;
    none that the join takes is lost. Past MOST_WORDS more others stay. wanted is read
    twice."""
    spark = df.sparkSession
    words = min(max(64, wanted.count() * KEY_BITS // 64), MOST_WORDS)
    slot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(64 * words))
    word, bit = F.shiftright("_s", 6).cast("int").alias("w"), F.col("_s").bitwiseAND(F.lit(63)).cast("int").alias("b")
    masks = wanted.select(slot(wanted.columns).alias("_s")).select(word, bit).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[masks.column("w").to_numpy()] = masks.column("m").to_numpy()
    table = spark.createDataFrame(pa.table({"_bits": pa.array([bits.tolist()], pa.list_(pa.int64()))}))
    s = slot(keys)
    known = F.get(F.col("_bits"), F.shiftright(s, 6).cast("int"))
    hit = F.call_function("shiftright", known, s.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(table), hit).select(*df.columns)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- numpy words

#: Bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_QINV = pow(_Q, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Grows with the longest slice seen."""

    def __init__(self, base: int):
        self.base, self.table = base, _powers(base, 1 << 12)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            self.table = _powers(self.base, max(n, 2 * len(self.table)))
        return self.table[:n]


_pow, _inv, _qpow, _qinv = _Powers(_P), _Powers(_PINV), _Powers(_Q), _Powers(_QINV)


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers; other seeds give other orders."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several documents: hash, first and end byte; ``at[d]:at[d+1]``
    are the words of document d, ``first`` its row in the Arrow batch. Without
    ``is_word`` there are bytes and offsets alone."""

    __slots__ = ("at", "data", "end", "first", "h", "offsets", "start")

    def __init__(self, data, offsets, first, is_word):
        self.data, self.offsets, self.first = data, offsets, first
        if is_word is None:
            return
        n = len(data)
        inside = is_word[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLD[data] * _pow.upto(n), out=sums[1:])
        self.h = mix64((sums[self.end] - sums[self.start]) * _inv.upto(n)[self.start]) if n else np.zeros(0, np.uint64)
        self.at = np.searchsorted(self.start, offsets)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k-1 run over."""
        n = len(self.h)
        if n < k:
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.h * _qpow.upto(n), out=sums[1:])
        return mix64((sums[k:] - sums[:-k]) * _qinv.upto(n)[: n - k + 1], k)

    def whole(self, d: int) -> np.uint64:
        """Hash of all words of document d, as one sequence."""
        h = self.h[self.at[d] : self.at[d + 1]]
        return mix64(np.sum(h * _qpow.upto(len(h)), dtype=np.uint64, keepdims=True), len(h))[0]

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, lower-cased A-Z, joined by a blank."""
        return b" ".join(self.data[a:b].tobytes().lower() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def text_blocks(column, is_word: np.ndarray | None, slice_bytes: int = SLICE_BYTES):
    """Words of an Arrow string column, slice by slice; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + slice_bytes, "right")) - 1)
        j = min(j, n)
        yield Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, is_word)
        i = j


def doc_shingles(words: Words, k: int, grams: np.ndarray, d: int) -> np.ndarray:
    """Sorted distinct k-word shingles of document d; fewer words: one shingle."""
    a, b = words.at[d], words.at[d + 1]
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    return np.array([words.whole(d)], np.uint64) if b > a else np.zeros(0, np.uint64)


# ------------------------------------------------------------- pairs of texts


def salted_by_pivot(pairs: DataFrame, docs: DataFrame, per_group: int = 64) -> DataFrame:
    """Rows (pivot, pv, salt, member, text, extra columns): for each group the text
    of its pivot (member null) first, then its members'. pairs: pivot, pv, member, mv
    and any further columns; docs: doc_id, v, text. A pivot with many members is dealt
    over count / per_group groups, so no task gets more than a share of it."""
    extra = [c for c in pairs.columns if c not in ("pivot", "pv", "member", "mv")]
    sizes = pairs.groupBy("pivot", "pv").agg(F.ceil(F.count("*") / per_group).cast("int").alias("_salts"))
    members = (
        pairs.join(sizes, ["pivot", "pv"])
        .withColumn("_salt", F.pmod(F.xxhash64("member", "mv"), F.col("_salts")).cast("int"))
        .join(docs.select(F.col("doc_id").alias("member"), F.col("v").alias("mv"), "text"), ["member", "mv"])
        .select("pivot", "pv", "_salt", "member", "mv", "text", *extra)
    )
    pivots = (
        sizes.join(docs.select(F.col("doc_id").alias("pivot"), F.col("v").alias("pv"), "text"), ["pivot", "pv"])
        .select("pivot", "pv", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(None).cast("long").alias("member"), F.lit(None).cast("int").alias("mv"), "text", *[F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in extra])
    )
    return pivots.unionByName(members).repartition("pivot", "pv", "_salt").sortWithinPartitions("pivot", "pv", "_salt", F.col("member").asc_nulls_first())


# ------------------------------------------------------ connected components


def _edge_state(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge (u, v long); component is the
    smallest node reachable. Large-star and small-star steps in turn; every round
    is cut through the shared folder. Only counts reach the driver."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges)
    before = _edge_state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, durable(small)
        now = _edge_state(edges)
        release(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
