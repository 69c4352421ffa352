"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds three of them, the
first rotated twice, the second once, by multiplication; a text bundles the
trigrams of its letters, with one blank between words, into their sum. A language
is the sum of its training texts' unit vectors; a text gets the language with the
largest cosine once the mean of all languages is taken off.

Learning takes about ``TRAIN_DOCS`` documents a language, chosen by hash, of the
``MAX_LANGS`` most frequent languages; all texts are read whole, long ones stretch by
stretch. Edge cases: null, empty and letterless texts are `und` with score
0; null languages are not learned from; without any learned language all texts
are `und`; ties go to the first language in order; rows are judged one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_arrow
from .toxicity import crc_fold

DIMENSIONS = 1024
TRAIN_DOCS = 3_000
SEED = 20
#: Characters that are counted at once, and kinds of trigrams that are bundled at once.
SLICE_CHARS, BLOCK = 400_000, 4_096
#: Languages learned at most, the most frequent.
MAX_LANGS = 1_000
_BLANK = 32
_ROOM = 1 << 21  # above any code point

_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


class Vectors:
    """Letter vectors, made when met; the same everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known = dimensions, {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.known:
            self.known[c] = np.random.default_rng([SEED, c]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.known[c]

    def grams(self, keys: np.ndarray) -> np.ndarray:
        parts = [(keys >> 42), (keys >> 21) & (_ROOM - 1), keys & (_ROOM - 1)]
        out = None
        for k, p in enumerate(parts):
            letters, at = np.unique(p, return_inverse=True)
            table = np.stack([np.roll(self.letter(int(c)), 2 - k) for c in letters])[at]
            out = table if out is None else out * table
        return out.astype(np.float32)


def _bundles(texts: list[str], vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """(one vector a text, whether it has a letter)."""
    joined = "".join("\x00" + x.lower() for x in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = code == 0
    letter = _is_letter()[code]
    # NUL begins a text and stands for a blank; those inside are taken out before.
    doc = np.cumsum(cut, dtype=np.int32) - 1
    code = np.where(letter, code, np.uint32(_BLANK))
    keep = letter | cut
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stands for a blank
    code, doc = code[keep], doc[keep]
    n = len(texts)
    out, has = np.zeros((n, vectors.dimensions), np.float32), np.bincount(doc[code != _BLANK], minlength=n)[:n] > 0
    # Trigrams are bundled a stretch of text and a block of kinds at a time.
    for i in range(0, len(code) - 2, SLICE_CHARS):
        c, d = code[i : i + SLICE_CHARS + 2].astype(np.int64), doc[i : i + SLICE_CHARS + 2]
        same = (d[:-2] == d[2:]) & (c[1:-1] != _BLANK)
        key, d = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[same], d[:-2][same]
        kept, at = np.unique(key, return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(BLOCK, len(kept) + BLOCK, BLOCK))
        for b, (lo, hi) in enumerate(zip(np.concatenate([[0], ends])[:-1], ends, strict=True)):
            kinds, rows = kept[b * BLOCK : (b + 1) * BLOCK], order[lo:hi]
            counts = np.bincount(d[rows].astype(np.int64) * len(kinds) + at[rows] - b * BLOCK, minlength=n * len(kinds)).reshape(n, -1).astype(np.float32)
            out += counts @ vectors.grams(kinds)
    return out, has


def _slices(texts):
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = (t or "").replace("\x00", " ")
        if part and (size + len(t) > SLICE_CHARS or len(part) >= 128):
            yield first, part
            part, size, first = [], 0, i
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, one prototype each). docs: doc_id, text, lang."""
    docs = docs.where("lang is not null and text is not null")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    share = counts.select("lang", (1_000_000 * F.least(F.lit(1.0), train_docs / F.col("count"))).cast("int").alias("_share"))
    chosen = docs.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_share"))

    def run(batches):
        vectors, sums = Vectors(dimensions), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in _slices(texts):
                v = _unit(_bundles(part, vectors)[0])
                for lang in set(langs[first : first + len(part)]):
                    at = [i for i in range(len(part)) if langs[first + i] == lang]
                    sums[lang] = sums.get(lang, 0) + v[at].sum(0, dtype=np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "v"])

    small_arrow(docs.sparkSession)
    # A row a task and language, summed on the executors: languages x dimensions.
    parts = chosen.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    sums = sorted((r.lang, [x.x for x in r.v]) for r in sums)
    return [x for x, _ in sums], _unit(np.array([v for _, v in sums]).reshape(len(sums), -1 if sums else dimensions))


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text)."""
    mean = prototypes.mean(0) if len(langs) > 1 else np.zeros(dimensions)
    sent = docs.sparkSession.sparkContext.broadcast((langs, mean.astype(np.float32), _unit(prototypes - mean).astype(np.float32)))

    def run(batches):
        names, centre, rows = sent.value
        vectors = Vectors(dimensions)
        for batch in batches:
            pred, score = [], []
            for _, part in _slices(batch.column(1).to_pylist()):
                v, has = _bundles(part, vectors)
                if not names:
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                cos = _unit(_unit(v) - centre) @ rows.T
                best = cos.argmax(1)
                pred += [names[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score += np.where(has, np.clip((cos.max(1) + 1) / 2, 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    small_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(crc_fold("doc_id", 4) != 2))
    out = predict(docs.select("doc_id", "text"), *model)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
