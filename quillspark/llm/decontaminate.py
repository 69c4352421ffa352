"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is
``n`` consecutive words of an item; a shorter item is one window. Every position
of every document is looked up by its rolling hash; a hit counts only after its
words have been compared. Documents are scanned in place: no shuffle.

The set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows (at most about
100 MB); a larger benchmark takes several scans, whose hits are merged by
document. Edge cases: null and empty texts have no words and no hits; items
without words have no windows; repeated items and rows count as they stand, and an
item_id counts once; other columns are kept, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, durable, read, small_arrow, text_blocks

N = 10
BLOCK_WINDOWS = 500_000
_BITS = 22


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item, hash, m, words): every window of every item (item_id, text)."""

    def windows(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for w in text_blocks(texts, ALNUM):
                for d in range(len(w.at) - 1):
                    a, b = int(w.at[d]), int(w.at[d + 1])
                    m = min(n, b - a)
                    if m:
                        h = w.grams(m)
                        out += [(ids[w.first + d], int(h[i].astype(np.int64)), m, w.text(i, i + m)) for i in range(a, b - m + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["item", "hash", "m", "words"])

    rows = items.select(F.col("item_id").cast("string"), F.col("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(windows, "item string, hash long, m int, words binary").distinct()


class WindowSet:
    """Windows by hash: a bit filter, sorted hashes, then the words themselves."""

    def __init__(self, rows):
        self.items: dict[bytes, tuple] = {}
        by_m: dict[int, set] = {}
        for item, h, m, words in rows:
            key = bytes(words)
            self.items[key] = (*self.items.get(key, ()), item)
            by_m.setdefault(m, set()).add(h)
        self.by_m = {}
        for m, hs in sorted(by_m.items()):
            h = np.sort(np.array(list(hs), np.int64).astype(np.uint64))
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.by_m[m] = (h, bits)

    def find(self, w, hits: dict) -> None:
        """hits[d]: (first word, past the last, items) of each verified hit."""
        for m, (known, bits) in self.by_m.items():
            g = w.grams(m)
            at = np.flatnonzero(bits[g >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            at = at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]
            doc = np.searchsorted(w.at, at, "right") - 1
            ok = at + m <= w.at[doc + 1]
            for i, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
                if items := self.items.get(w.text(i, i + m)):
                    hits.setdefault(d, []).append((i - int(w.at[d]), i - int(w.at[d]) + m, items))


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _merged(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(docs: DataFrame, found: WindowSet) -> DataFrame:
    """docs, whose last column is text, with n_words, word spans that are hit, the
    same as byte spans, and items."""
    spark = docs.sparkSession
    small_arrow(spark)
    sent = spark.sparkContext.broadcast(found)
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_words", T.LongType()), T.StructField("_spans", _SPANS), T.StructField("_bytes", _SPANS), T.StructField("_items", T.ArrayType(T.StringType()))])

    def scan(batches):
        known = sent.value
        for batch in batches:
            n, spans, cuts, items = [], [], [], []
            for w in text_blocks(batch.column(batch.num_columns - 1), ALNUM):
                hits: dict = {}
                known.find(w, hits)
                n += np.diff(w.at).tolist()
                for d in range(len(w.at) - 1):
                    got = hits.get(d, ())
                    merged = _merged((a, b) for a, b, _ in got)
                    spans.append([{"a": a, "b": b} for a, b in merged])
                    o, f = int(w.offsets[d]), int(w.at[d])
                    cuts.append([{"a": int(w.start[f + a]) - o, "b": int(w.end[f + b - 1]) - o} for a, b in merged])
                    items.append(sorted({x for _, _, names in got for x in names}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(cuts, _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))], schema.names)

    return docs.mapInArrow(scan, schema)


def window_sets(benchmark: DataFrame, n: int = N):
    """Blocks of windows, each of a bounded size; one for any usual benchmark."""
    windows = durable(item_windows(benchmark, n))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    dealt = windows.withColumn("_block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    for k in range(blocks):
        yield WindowSet(dealt.where(F.col("_block") == k).drop("_block").toLocalIterator())


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text, _n_words, _spans, _bytes, _items) for each row of docs."""
    rows = docs.select("doc_id", "text")
    sets = list(window_sets(benchmark, n))
    if len(sets) == 1:
        return _scan(rows, sets[0])
    # Beyond one block: a row key, one scan a block, and merged spans.
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "text"))
    return rows.join(_scan_blocks(rows.select("_row", "text"), sets), "_row").drop("_row")


def _scan_blocks(rows: DataFrame, sets) -> DataFrame:
    """(_row, _n_words, _spans, _bytes, _items) of rows (_row, text) over all sets."""
    parts = None
    for s in sets:
        part = _scan(rows, s).drop("text")
        parts = part if parts is None else parts.union(part)

    def merge(key, pdf):
        import pandas as pd

        one = pdf.iloc[0]
        join = lambda c: [{"a": a, "b": b} for a, b in _merged((x["a"], x["b"]) for r in pdf[c] for x in r)]
        return pd.DataFrame([{"_row": one["_row"], "_n_words": one["_n_words"], "_spans": join("_spans"), "_bytes": join("_bytes"), "_items": sorted({x for r in pdf["_items"] for x in r})}])

    return parts.groupBy("_row").applyInPandas(merge, parts.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.expr("aggregate(_spans, 0L, (n, x) -> n + x.b - x.a)").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def _without(text: str, spans) -> str:
    raw, out, at = text.encode(), [], 0
    for x in spans:
        out.append(raw[at : x["a"]])
        at = x["b"]
    return b"".join([*out, raw[at:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, n: int = N, max_share: float = 0.5) -> DataFrame:
    """docs without benchmark passages: the hit words go; a document of which more
    than max_share of the words is hit goes as a whole. Columns stay as they are;
    n_chars, if there, follows the text. One block is scanned in place; the hits of
    several are merged before a document is judged and cut."""
    spark = docs.sparkSession
    schema, names = docs.schema, docs.columns
    sets = list(window_sets(benchmark, n))
    if len(sets) > 1:
        return _remove_blocks(docs, sets, max_share)
    for found in sets:
        small_arrow(spark)
        sent = spark.sparkContext.broadcast(found)

        def cleaned(batches, sent=sent):
            known = sent.value
            for batch in batches:
                k = batch.schema.get_field_index("text")
                keep, new = [], {}
                for w in text_blocks(batch.column(k), ALNUM):
                    hits: dict = {}
                    known.find(w, hits)
                    words = np.diff(w.at)
                    for d in range(len(words)):
                        if got := hits.get(d):
                            merged = _merged((a, b) for a, b, _ in got)
                            if sum(b - a for a, b in merged) > max_share * words[d]:
                                continue
                            o, f, row = int(w.offsets[d]), int(w.at[d]), w.first + d
                            new[row] = _without(batch.column(k)[row].as_py(), [{"a": int(w.start[f + a]) - o, "b": int(w.end[f + b - 1]) - o} for a, b in merged])
                        keep.append(w.first + d)
                columns = list(batch.columns)
                if new:
                    columns[k] = pa.array([new.get(i, x) for i, x in enumerate(columns[k].to_pylist())], batch.schema.field(k).type)
                    c = batch.schema.get_field_index("n_chars")
                    if c >= 0:
                        columns[c] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(columns[c].to_pylist())], batch.schema.field(c).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).take(pa.array(keep, pa.int64()))

        docs = docs.mapInArrow(cleaned, schema)
    return docs.select(*names)


def _remove_blocks(docs: DataFrame, sets, max_share: float) -> DataFrame:
    schema, names = docs.schema, docs.columns
    small_arrow(docs.sparkSession)
    keyed = durable(docs.withColumn("_row", F.monotonically_increasing_id()))
    hit = _scan_blocks(keyed.select("_row", "text"), sets).where("size(_spans) > 0")
    hit = hit.select("_row", "_bytes", (F.expr("aggregate(_spans, 0L, (n, x) -> n + x.b - x.a)") > F.lit(float(max_share)) * F.col("_n_words")).alias("_gone"))

    def cut(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            k, c = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else -1
            texts, spans = columns[k].to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = {i: _without(texts[i], x) for i, x in enumerate(spans) if x}
            if new:
                columns[k] = pa.array([new.get(i, x) for i, x in enumerate(texts)], batch.schema.field(k).type)
                if c >= 0:
                    columns[c] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(columns[c].to_pylist())], batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    kept = keyed.join(hit, "_row", "left").where("_gone is null or not _gone")
    return kept.select(*names, "_bytes").mapInArrow(cut, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages go, whole documents where they prevail."""
    return remove(docs, read(spark, sf_dir, "benchmark"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
), hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
