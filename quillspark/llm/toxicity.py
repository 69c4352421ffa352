"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

``features`` reads each whole text once and yields a short row of numbers: lexicon
densities (a fixed list, and terms learned from labelled texts), hits next to a
second-person word, capitals, punctuation and obfuscation rates. Labels meet these
short rows only. Fitting takes at most ``TRAIN_ROWS`` labelled rows (the lowest
hashes) to the driver; the rest of the work is distributed.

Edge cases: null and empty texts have zero features and get a score like any
other; null labels are not learned from; without labels of both kinds every score
is the share of label 1 (0 without labels); repeated rows are scored one by one;
null doc_ids are never held out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, NON_SPACE, durable, read, small_arrow, text_blocks

#: Bounds of what is learned from: rows for the trees, rows a class for the terms.
TRAIN_ROWS = 20_000
TERM_ROWS = 2_000
MAX_TERMS = 200
#: A small lexicon of insults; ``fit`` adds learned terms.
LEXICON = "idiot loser pathetic scum worthless moron trash clown disgusting stupid dumb jerk fool ugly garbage filthy hate vermin pig coward creep".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes vosotros ti tus".split()
NEAR = 3
FEATURES = ("lexicon", "lexicon_log", "learned", "learned_log", "near_second", "capitals", "upper_words", "exclaim", "question", "punctuation", "obfuscated", "obfuscated_hits", "words_log", "densest")
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")


def crc_fold(c: str, n: int) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % n


def _hashes(terms) -> np.ndarray:
    w = next(text_blocks(pa.array([" ".join(terms) or " "]), ALNUM))
    return np.unique(w.h)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(chars)] = 1
    return t


_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 256)))
_EXCLAIM, _QUESTION = _table(b"!"), _table(b"?")
_PUNCT = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def _sums(data, table):
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=out[1:])
    return out


def _block(w, v, lexicon, learned, second, words: set) -> np.ndarray:
    """Features of the documents of a slice. w: alphanumeric words, v: the same
    bytes' words between blanks."""
    n, o = len(w.at) - 1, w.offsets
    f = np.zeros((n, len(FEATURES)))
    lex, extra, you = _among(w.h, lexicon), _among(w.h, learned), _among(w.h, second)
    total = np.maximum(np.diff(w.at), 1)

    def per_doc(mask, at=w.at):
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[at[1:]] - c[at[:-1]]

    hits, more = per_doc(lex), per_doc(extra)
    c = np.concatenate([[0], np.cumsum(you)])
    i = np.flatnonzero(lex | extra)
    doc = np.searchsorted(w.at, i, "right") - 1
    close = c[np.minimum(i + NEAR + 1, w.at[doc + 1])] - c[np.maximum(i - NEAR, w.at[doc])] > 0
    near = np.bincount(doc[close], minlength=n)
    # Most hits within 64 words.
    dense = np.zeros(n)
    if len(i):
        last = np.searchsorted(i, i + 64)
        np.maximum.at(dense, doc, np.minimum(last, np.searchsorted(i, w.at[doc + 1])) - np.arange(len(i)))
    chars = np.maximum(np.diff(o), 1)
    at = lambda t: (s := _sums(w.data, t))[o[1:]] - s[o[:-1]]
    letters, upper = _sums(w.data, _LETTER), _sums(w.data, _UPPER)
    # A word between blanks from letter to letter with anything else inside.
    odd = np.zeros(len(v.h), bool)
    if len(v.h):
        inner = (letters[v.end] - letters[v.start]) < v.end - v.start
        ends = _LETTER[w.data[v.start]].astype(bool) & _LETTER[w.data[v.end - 1]].astype(bool)
        odd = inner & ends
    odd_hits = np.zeros(n)
    j = np.flatnonzero(odd)
    for k, d in zip(j.tolist(), (np.searchsorted(v.at, j, "right") - 1).tolist(), strict=True):
        word = w.data[v.start[k] : v.end[k]].tobytes().lower().translate(_LEET)
        odd_hits[d] += bytes(x for x in word if 97 <= x <= 122).decode() in words
    loud = per_doc((upper[v.end] - upper[v.start] > 1) & (upper[v.end] - upper[v.start] == letters[v.end] - letters[v.start]), v.at) if len(v.h) else np.zeros(n)
    spaced = np.maximum(np.diff(v.at), 1)
    for k, x in enumerate((hits / total, np.log1p(hits), more / total, np.log1p(more), near / total, at(_UPPER) / chars, loud / spaced, at(_EXCLAIM) / spaced, at(_QUESTION) / spaced, at(_PUNCT) / chars, per_doc(odd, v.at) / spaced, odd_hits / spaced, np.log1p(np.diff(w.at)), dense)):
        f[:, k] = x
    return f


def features(docs: DataFrame, terms=(), lexicon=LEXICON) -> DataFrame:
    """(doc_id, f array of FEATURES) for each row of docs (doc_id, text)."""
    lex, learned, second, words = _hashes(lexicon), _hashes(terms), _hashes(SECOND_PERSON), {*lexicon, *terms}

    def run(batches):
        for batch in batches:
            out = [np.zeros((0, len(FEATURES)))]
            for w, v in zip(text_blocks(batch.column(1), ALNUM), text_blocks(batch.column(1), NON_SPACE), strict=True):
                out.append(_block(w, v, lex, learned, second, words))
            f = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES)), pa.array(f.ravel()))], ["doc_id", "f"])

    small_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f array<double>")


def learn_terms(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words far more frequent among documents of label 1, MAX_TERMS at most, from
    the TERM_ROWS lowest hashes of either label. labels: doc_id, y."""
    ids = None
    for y in (0, 1):
        part = labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TERM_ROWS)
        ids = part if ids is None else ids.union(part)
    n = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    if len(n) < 2:
        return []
    # 2 * TERM_ROWS ids at most
    texts = docs.join(F.broadcast(ids), "doc_id")
    words = texts.select("y", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("w")).where("length(w) > 2")
    counted = words.groupBy("w").agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (n[1] + 1.0)) - F.log((F.col("q") + 0.5) / (n[0] + 1.0))
    best = counted.where((F.col("p") >= max(3, n[1] * 0.01)) & (odds > 2.5)).orderBy(odds.desc(), "w").limit(MAX_TERMS)
    return [r.w for r in best.select("w").collect()]


class Boosted:
    """Trees of ``depth`` levels over binned features, logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 8.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # A feature that is 0 nearly always has its own cut just above 0.
        self.cuts = [np.unique(np.concatenate([c, [min(v[v > v.min()])] if (v > v.min()).any() else []])) for c, v in zip(self.cuts, x.T, strict=True)]
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        width = max(len(c) for c in self.cuts) + 1
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(self.depth):
                m = 1 << level
                gain, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
                for k in range(x.shape[1]):
                    key = node * width + b[:, k]
                    G = np.bincount(key, g, m * width).reshape(m, width).cumsum(1)
                    H = np.bincount(key, h, m * width).reshape(m, width).cumsum(1)
                    left, right = G**2 / (H + 1), (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + 1)
                    value = np.where((H >= self.least / 4) & (H[:, -1:] - H >= self.least / 4), left + right - G[:, -1:] ** 2 / (H[:, -1:] + 1), -1)
                    at = value.argmax(1)
                    best = value[np.arange(m), at]
                    better = best > gain + 1e-9
                    gain[better], feature[better], cut[better] = best[better], k, at[better]
                tree.append((feature, cut))
                fk = feature[node]
                node = node * 2 + np.where(fk >= 0, b[np.arange(len(y)), np.maximum(fk, 0)] > cut[node], False)
            m = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, m) / (np.bincount(node, h, m) + 1)
            self.nodes.append((tree, leaf))
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        out = np.full(len(x), self.base)
        if not self.nodes:
            return out
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        rows = np.arange(len(x))
        for tree, leaf in self.nodes:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                fk = feature[node]
                node = node * 2 + np.where(fk >= 0, b[rows, np.maximum(fk, 0)] > cut[node], False)
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray):
    """Pool adjacent violators: (upper ends of the steps, their values)."""
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, count, last score
    for a, t in zip(s.tolist(), v.tolist(), strict=True):
        if blocks and blocks[-1][2] == a:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, a2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, a2]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Boosted trees and their calibration; a thousandth of the score is the
    trees' own probability, so that a step's members keep their order."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = float(y.mean()) if len(y) else 0.0
        self.learned = len(np.unique(y)) == 2
        if self.learned:
            held = np.arange(len(y)) % 4 == 3
            if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
                held = np.zeros(len(y), bool)
            self.trees = Boosted().fit(x[~held], y[~held])
            on = held if held.any() else ~held
            self.ends, self.values = isotonic(self.trees.raw(x[on]), y[on])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(x), self.constant)
        raw = self.trees.raw(x)
        step = self.values[np.minimum(np.searchsorted(self.ends, raw), len(self.values) - 1)]
        return np.clip(0.999 * step + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit(found: DataFrame, labels: DataFrame) -> Model:
    """found: features(); labels: doc_id, y."""
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = found.join(sample, "doc_id").select("doc_id", "f", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect()
    return Model(np.array([r.f for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows]))


def score(found: DataFrame, model: Model) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return found.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(crc_fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    labels = durable(labels)
    found = durable(features(docs, learn_terms(docs, labels)))
    scored = score(found, fit(found, labels))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
