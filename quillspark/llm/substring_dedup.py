"""Substring de-duplication: MinHash banding over sliding paragraphs.

A paragraph is any run of ``PARAGRAPH`` words, wherever it starts, so a passage is
found inside a line as well as on its own. Its set is its 5-word shingles; a band
is one MinHash value (``tune_bands`` gives how many bands a recall needs). Paragraphs
that start one word apart mostly share their MinHash, so they are kept as runs: about
2 rows in 47 words and band.

1. ``anchors``: one pass over the texts gives the runs. Runs of equal words are one
   class, of which the first place stands for the others.
2. ``contexts``: classes whose key another document has are fetched once from their
   texts, as at most 91 shingles of 32 bits. No text moves after that.
3. Classes of a key meet one of them, the pivot: the most frequent, then the first.
   Paragraphs at the same place around the common shingle match when the Jaccard
   similarity of their sets is ``percent`` at least.
4. Two classes that match each other, but not the pivot, share a shingle that the
   pivot's paragraph lacks, and one of the first few of such shingles in a global
   order (at most ``missing`` of a paragraph's shingles can lack in one that it
   matches). So the classes are dealt anew by those shingles, and step 3 is repeated
   with other and more pivots until no group has two classes. A key that a third of all
   documents have costs its rows a few comparisons each, not pairs.
   Groups of up to ``GROUP`` classes do all of this inside one task; each class moves
   there once.
5. Documents with a match are clustered by connected components.

In each match the later document's words are the repeat; a passage thus stays in the
first document that has it, with its repeats inside that document. Step 4 holds for
paragraphs of different shingles; where shingles repeat inside one (runs of the
same few words), classes are compared with pivots all the same, but a link may be
missed. Edge cases: null, empty and short texts (under ``PARAGRAPH`` words) have no
paragraphs; null doc_ids take no part; rows that repeat a doc_id are one document,
each with the places of its own text; extra columns are kept."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, SMALL_SLICE, _qinv, _qpow, among, collect_shuffles, components, durable, mix64, read, release, small_arrow, text_blocks

PARAGRAPH = 50
K = 5
PERCENT = 80
RECALL = 0.95
#: Pairs of contexts compared in one numpy pass.
CHUNK = 128
#: Pivots of a group in one round.
MOST_PIVOTS = 64
#: Classes of a key that one task settles in memory (some 400 bytes each); larger groups
#: take distributed rounds until they are dealt into such.
GROUP = 4096
#: Shingles have 32 bits; 0 and 1 stand for places past a run, the last value for shingles that do not count.
_X, _Y, _GONE = 0, 1, (1 << 32) - 1


def tune_bands(percent: int = PERCENT, recall: float = RECALL) -> int:
    """Bands of one row each, so that a pair at the threshold collides in one with
    the wanted probability: 1 - (1 - J) ** bands >= recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - percent / 100)))


# -------------------------------------------------------------------- anchors


def _windows(w, size: int):
    """(document, first word) of every paragraph of a slice."""
    many = np.maximum(np.diff(w.at) - size + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    return doc, np.repeat(w.at[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(doc))


def _runs_of(w, grams, sums, doc, first, seed: int, size: int, k: int):
    """Runs of paragraphs with one MinHash place: (document, first word of the first
    paragraph, equal runs of one paragraph that follow at once, paragraphs, shingles
    before the place, key, class)."""
    span = size - k + 1
    n = len(grams)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    keys = mix64(grams, seed)
    order = (keys & ~low) | np.arange(n, dtype=np.uint64)
    # Sliding minimum: running minima of blocks, forwards and backwards.
    padded = np.full(-(-n // span) * span, ~np.uint64(0))
    padded[:n] = order
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[first], ahead[first + span - 1]) & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    m = np.diff(np.append(begin, len(at)))
    doc, at, s = doc[begin], at[begin], first[begin]
    key = keys[at]
    off = at - s
    words = (sums[s + m - 1 + size] - sums[s]) * _qinv.upto(len(sums))[s]
    cls = mix64(mix64(words, 3) + (m * 64 + off).astype(np.uint64))
    # A word many times over gives the same run at every place.
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != 1) | (cls[1:] != cls[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(new)
    reps = np.diff(np.append(begin, len(m)))
    return doc[begin], s[begin], reps, m[begin], off[begin], key[begin], cls[begin]


def anchors(docs: DataFrame, bands: int, size: int = PARAGRAPH, k: int = K) -> DataFrame:
    """(key, cls, doc, v, pos, reps, m, off) of every run in every band; keys of
    different bands differ by their seed. docs: doc_id, v, text."""
    names = ["key", "cls", "doc", "v", "pos", "reps", "m", "off"]

    def run(batches):
        for batch in batches:
            ids, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w in text_blocks(batch.column(2), NON_SPACE, SMALL_SLICE):
                doc, first = _windows(w, size)
                if not len(doc):
                    continue
                grams = w.grams(k)
                sums = np.zeros(len(w.h) + 1, np.uint64)
                np.cumsum(w.h * _qpow.upto(len(w.h)), out=sums[1:])
                for seed in range(bands):
                    d, s, reps, m, off, key, cls = _runs_of(w, grams, sums, doc, first, 100 + seed, size, k)
                    row = w.first + d
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), cls.view(np.int64), ids[row].astype(np.int64), v[row].astype(np.int32), (s - w.at[d]).astype(np.int32), reps.astype(np.int32), m.astype(np.int32), off.astype(np.int32))], names)

    small_arrow(docs.sparkSession)
    return docs.mapInArrow(run, "key long, cls long, doc long, v int, pos int, reps int, m int, off int")


def contexts(classes: DataFrame, docs: DataFrame, size: int = PARAGRAPH, k: int = K) -> DataFrame:
    """(key, cls, lo, hi, n, off, ctx): the shingles of each class's paragraphs, 32
    bits each. classes: durable; key, cls, lo, v, pos, m, off, hi, n; a text is read once
    and moves if a class is read from it."""
    asked = classes.groupBy(F.col("lo").alias("doc_id"), "v").agg(F.collect_list(F.struct("key", "cls", "pos", "m", "off", "hi", "n")).alias("asked"))
    names = ["key", "cls", "lo", "hi", "n", "off", "ctx"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2)
            for w in text_blocks(batch.column(1), NON_SPACE, SMALL_SLICE):
                grams, out = w.grams(k).astype("<u4"), [[] for _ in names]
                for d in range(len(w.at) - 1):
                    i = w.first + d
                    it = asked[i].values
                    key, cls, pos, m, off, hi, n = (it.field(c).to_numpy(zero_copy_only=False) for c in range(7))
                    a = w.at[d] + pos
                    for x, y in zip(out, (key, cls, [ids[i]] * len(key), hi, n, off, [grams[b : b + c].tobytes() for b, c in zip(a.tolist(), (m + size - k).tolist(), strict=True)]), strict=True):
                        x.extend(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    small_arrow(docs.sparkSession)
    return among(docs, ["doc_id", "v"], classes.select("lo", "v")).join(asked, ["doc_id", "v"]).select("doc_id", "text", "asked").mapInArrow(run, "key long, cls long, lo long, hi long, n long, off int, ctx binary")


# ----------------------------------------------------------------- comparison


def _grid(ctx, off, span: int, pad: int):
    """Shingles around the common one, which is in column span - 1; the paragraphs
    of each run as (first, past the last)."""
    out = np.full((len(ctx), 2 * span - 1), pad, np.uint32)
    begin = span - 1 - off
    m = np.empty(len(ctx), np.int64)
    for i, (c, b) in enumerate(zip(ctx, begin.tolist(), strict=True)):
        x = np.frombuffer(c, "<u4")
        out[i, b : b + len(x)] = np.clip(x, 2, _GONE - 1)
        m[i] = len(x) - span + 1
    return out, begin, begin + m


def _repeated(x):
    s = np.sort(x, axis=1)
    return ((s[:, 1:] == s[:, :-1]) & (s[:, 1:] > _Y)).any(axis=1)


def _jaccard(x, y, span: int, percent: int):
    """Whether the sets of x[i : i + span] and y[i : i + span] match, for every i."""
    ids = np.unique(np.concatenate([x, y]), return_inverse=True)[1]

    def has(i):
        sums = np.zeros((len(i) + 1, ids.max() + 1), np.int32)
        sums[np.arange(1, len(i) + 1), i] = 1
        np.cumsum(sums, axis=0, out=sums)
        return sums[span:] != sums[:-span]

    a, b = has(ids[: len(x)]), has(ids[len(x) :])
    return 100 * (a & b).sum(axis=1) >= percent * (a | b).sum(axis=1)


def _compare(x, xa, xb, y, ya, yb, more, size: int, k: int, percent: int):
    """For pairs of grids: which paragraphs match (pair, column of the first shingle),
    and for pairs of ``more`` the shingles of y that deal it out anew."""
    span = size - k + 1
    need = -(-2 * span * percent // (100 + percent))
    n, wide = x.shape
    pair, p, q = np.nonzero(x[:, :, None] == y[:, None, :])
    close = np.abs(p - q) < span
    pair, p, q = pair[close], p[close], q[close]
    # A shingle at p in x and q in y is in the paragraphs from one column to another.
    counts = np.bincount(pair * (span + 1) + np.maximum(np.maximum(p, q) - span + 1, 0), minlength=n * (span + 1)) - np.bincount(pair * (span + 1) + np.minimum(np.minimum(p, q), span - 1) + 1, minlength=n * (span + 1))
    counts = np.cumsum(counts.reshape(n, span + 1), axis=1)[:, :span]
    r = np.arange(span)
    in_x, in_y = (r >= xa[:, None]) & (r < xb[:, None]), (r >= ya[:, None]) & (r < yb[:, None])
    good = (counts >= need) & in_x & in_y
    for i in np.flatnonzero((_repeated(x) | _repeated(y)) & (in_x & in_y).any(axis=1)).tolist():
        a, b = max(xa[i], ya[i]), min(xb[i], yb[i])
        good[i] = False
        good[i, a:b] = _jaccard(x[i, a : b + span - 1], y[i, a : b + span - 1], span, percent)
    tokens = [[]] * n
    ask = np.flatnonzero(more)
    if len(ask):
        number = np.full(n, -1)
        number[ask] = np.arange(len(ask))
        mine = number[pair] >= 0
        pair, p, q = number[pair[mine]], p[mine], q[mine]
        cells = (pair * wide + q) * (span + 1)
        known = np.bincount(cells + np.maximum(p - span + 1, 0), minlength=len(ask) * wide * (span + 1)) - np.bincount(cells + np.minimum(p, span - 1) + 1, minlength=len(ask) * wide * (span + 1))
        known = (np.cumsum(known.reshape(len(ask), wide, span + 1), axis=2)[:, :, :span] > 0) & in_x[ask][:, None, :]
        known = np.ascontiguousarray(known.transpose(0, 2, 1))
        a, b, c = known.strides
        known = np.lib.stride_tricks.as_strided(known, (len(ask), span, span), (a, b + c, c))  # paragraph r, shingle r + j
        values = np.lib.stride_tricks.sliding_window_view(y[ask], span, axis=1)
        left = np.where(known, np.uint32(_GONE), values)
        first = span - need + 1
        left = np.partition(left, first - 1, axis=2)[:, :, :first]
        left[~in_y[ask]] = _GONE
        for j, i in enumerate(ask.tolist()):
            found = np.unique(left[j])
            tokens[i] = found[(found < _GONE) & (found > _Y)].tolist()
    return good, in_y, tokens


def _runs(x):
    """Runs of True as [first, past the last]."""
    d = np.diff(np.concatenate([[0], x.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(d > 0), np.flatnonzero(d < 0)], axis=1).tolist()


_MET = "a long, b long, mine array<array<int>>, theirs array<array<int>>, open boolean, tokens array<long>"
_INTS = pa.list_(pa.list_(pa.int32()))
_TYPES = [pa.int64(), pa.int64(), _INTS, _INTS, pa.bool_(), pa.list_(pa.int64())]


def compare(pairs: DataFrame, ctx: DataFrame, size: int = PARAGRAPH, k: int = K, percent: int = PERCENT) -> DataFrame:
    """pairs: a (the pivot), b, more; ctx: id, off, ctx. The paragraphs of each that match,
    as runs of their numbers, whether one of b's does not, and with ``more`` the shingles
    by which b is dealt on."""
    span = size - k + 1
    side = lambda s: ctx.select(F.col("id").alias(s), F.col("off").alias(f"off_{s}"), F.col("ctx").alias(f"ctx_{s}"))

    def run(batches):
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(0, batch.num_rows, CHUNK):
                part = {c: x.slice(i, CHUNK) for c, x in col.items()}
                x, xa, xb = _grid(part["ctx_a"].to_pylist(), part["off_a"].to_numpy().astype(np.int64), span, _X)
                y, ya, yb = _grid(part["ctx_b"].to_pylist(), part["off_b"].to_numpy().astype(np.int64), span, _Y)
                good, in_y, tokens = _compare(x, xa, xb, y, ya, yb, part["more"].to_numpy(zero_copy_only=False), size, k, percent)
                runs = [_runs(g) if g.any() else [] for g in good]
                at = lambda first: [[[s - f, e - f] for s, e in r] for r, f in zip(runs, first.tolist(), strict=True)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(at(xa), _INTS), pa.array(at(ya), _INTS), pa.array((in_y & ~good).any(axis=1)), pa.array(tokens, pa.list_(pa.int64()))], schema=pa.schema(list(zip(names, _TYPES, strict=True))))

    names = [x.split()[0] for x in _MET.split(", ")]
    small_arrow(ctx.sparkSession)
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "more", "off_a", "ctx_a", "off_b", "ctx_b").mapInArrow(run, _MET)


def _choose(g, idx, open_, lo, hi, n, pivots: int):
    """Pairs of one round: (a, b, more) for rows (group, member), each group with up to
    ``pivots`` pivots; groups that are settled or have another's members give none."""
    order = np.lexsort((idx, lo[idx], -n[idx], ~open_, g))
    g, idx, open_ = g[order], idx[order], open_[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(begin, len(g)))
    live = (size > 1) & (np.minimum.reduceat(lo[idx], begin) < np.maximum.reduceat(hi[idx], begin)) & np.logical_or.reduceat(open_, begin)
    same = np.stack([size.astype(np.uint64), np.add.reduceat(mix64(idx.astype(np.uint64)), begin), np.add.reduceat(mix64(idx.astype(np.uint64), 7), begin)], axis=1)
    other = np.zeros(len(begin), bool)
    other[np.unique(same, axis=0, return_index=True)[1]] = True
    a, b, more = [], [], []
    for s, m in zip(begin[live & other].tolist(), size[live & other].tolist(), strict=True):
        k = min(pivots, m - 1)
        for j in range(k):
            a.append(np.full(m - 1 - j, idx[s + j]))
            b.append(idx[s + j + 1 : s + m])
            more.append((np.arange(j + 1, m) >= k) & (j == 0) & (m - k > 1))
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((a, np.int64), (b, np.int64), (more, bool))]


def _settle(g, ctx, off, lo, hi, n, open_, size: int, k: int, percent: int):
    """The rounds of ``_levels`` for whole groups in memory: (a, b, mine, theirs) of the
    pairs of rows that match."""
    span = size - k + 1
    grid, first, last = _grid(ctx, off, span, _X)
    idx, met, out = np.arange(len(g)), np.zeros(0, np.int64), []
    g, pivots = np.unique(g, return_inverse=True)[1], 1
    while len(g):
        a, b, more = _choose(g, idx, open_, lo, hi, n, pivots)
        codes = a * len(ctx) + b
        order = np.lexsort((~more, codes))
        order = order[np.append(True, codes[order][1:] != codes[order][:-1])] if len(order) else order
        a, b, more, codes = a[order], b[order], more[order], codes[order]
        # A pair that was met is met again only for what it deals on.
        seen = np.isin(codes, met)
        keep = ~seen | more
        a, b, more, seen = a[keep], b[keep], more[keep], seen[keep]
        met = np.union1d(met, codes)
        dealt = []
        for i in range(0, len(a), CHUNK):
            x, y, ask = a[i : i + CHUNK], b[i : i + CHUNK], more[i : i + CHUNK]
            good, in_y, tokens = _compare(grid[x], first[x], last[x], np.maximum(grid[y], _Y), first[y], last[y], ask, size, k, percent)
            for j in np.flatnonzero(good.any(axis=1) & ~seen[i : i + CHUNK]).tolist():
                runs = _runs(good[j])
                out.append((x[j], y[j], [[s - first[x[j]], e - first[x[j]]] for s, e in runs], [[s - first[y[j]], e - first[y[j]]] for s, e in runs]))
            left = (in_y & ~good).any(axis=1)
            lens = np.array([len(z) for z in tokens])
            if lens.sum():
                dealt.append((np.repeat(x, lens), np.repeat(y, lens), np.repeat(left, lens), np.concatenate([np.array(z, np.int64) for z in tokens])))
        if not dealt:
            break
        pivot, idx, open_, t = (np.concatenate(z) for z in zip(*dealt, strict=True))
        g, counts = np.unique((pivot.astype(np.uint64) << np.uint64(32)) | t.astype(np.uint64), return_inverse=True, return_counts=True)[1:]
        keep = counts[g] > 1
        g, idx, open_, pivots = g[keep], idx[keep], open_[keep], min(4 * pivots, MOST_PIVOTS)
    return out


def _said(found, ids, key, cls, lo, hi):
    """Of the matches of _settle: each class's distinct runs with the smallest and the
    largest document that has them elsewhere, and links that connect the same documents."""
    hits, parent, links = {}, {}, []

    def root(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    for x, y, mine, theirs in found:
        for i, j, runs in ((x, y, mine), (y, x, theirs)):
            for s, e in runs:
                at = (ids[i], int(s), int(e))
                old = hits.get(at)
                hits[at] = (key[i], cls[i], lo[j], hi[j]) if old is None else (*old[:2], min(old[2], lo[j]), max(old[3], hi[j]))
        if (u := root(lo[x])) != (v := root(lo[y])):
            parent[u] = v
            links.append((lo[x], lo[y]))
    return hits, links


def settle(rows: DataFrame, size: int, k: int, percent: int) -> DataFrame:
    """rows: g, id, open, lo, hi, n, off, ctx, key, cls. Groups that fit in memory: each goes
    to one task and is settled there. (key, cls, r, low, high, u, v) of what matches there:
    a row for each run of a class, or a link u, v."""
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("r", pa.list_(pa.int32())), ("low", pa.int64()), ("high", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def solve(table):
        g, lo, hi, n, off = (table.column(c).to_numpy() for c in ("g", "lo", "hi", "n", "off"))
        found = _settle(g, table.column("ctx").to_pylist(), off.astype(np.int64), lo, hi, n, table.column("open").to_numpy(), size, k, percent)
        hits, links = _said(found, *(table.column(c).to_pylist() for c in ("id", "key", "cls", "lo", "hi")))
        out = [(key, cls, [s, e], low, high, None, None) for (_, s, e), (key, cls, low, high) in hits.items()] + [(None,) * 5 + x for x in links]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * len(schema), schema.types, strict=True)], schema=schema)

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many < GROUP:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy()
            cut = int(np.argmax(g == g[-1]))
            if cut:
                yield solve(table.slice(0, cut))
            held, many = table.slice(cut).to_batches(), len(g) - cut
        if many:
            yield solve(pa.Table.from_batches(held))

    small_arrow(rows.sparkSession)
    return rows.repartition("g").sortWithinPartitions("g", "id").mapInArrow(run, "key long, cls long, r array<int>, low long, high long, u long, v long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b"))


def _levels(ctx: DataFrame, size: int, k: int, percent: int):
    """The comparisons of every round, each a durable table: of settle, then of compare. Groups of up to ``GROUP``
    classes are settled inside a task. A larger one has one pivot in the first round and up
    to four times as many in each that follows: the best of each of so many parts. What
    is left of it is dealt on by what its first pivot lacks; of groups with the same
    members one is enough."""
    about = ctx.select("id", "lo", "hi", "n")
    rows, pivots, held = ctx.select(F.col("key").alias("g"), "id", F.lit(True).alias("open"), "lo", "hi", "n"), 1, None
    while True:
        # Few: each has over GROUP rows.
        large = durable(rows.groupBy("g").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")).groupBy("x", "y", "size").agg(F.min("g").alias("g")).select("g", (F.col("size") > GROUP).alias("large")))
        if held is None:
            small = ctx.withColumns({"g": F.col("key"), "open": F.lit(True)})
        else:
            small = rows.join(large.where("not large").select("g"), "g").join(among(ctx.select("id", "off", "ctx", "key", "cls"), ["id"], held.select("id")), "id")
        small = small.join(F.broadcast(large.where("large").select("g")), "g", "left_anti")
        yield durable(settle(small.select("g", "id", "open", "lo", "hi", "n", "off", "ctx", "key", "cls"), size, k, percent))
        rows = rows.join(F.broadcast(large.where("large").select("g")), "g", "left_semi")
        best = rows.groupBy("g", F.pmod(F.xxhash64("id"), F.lit(pivots)).alias("part")).agg(F.count("*").alias("size"), F.min(F.struct(~F.col("open"), -F.col("n"), "lo", "id")).alias("first"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.max("open").alias("some"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"))
        best = best.groupBy("g").agg(F.sum("size").alias("size"), F.min("first").alias("first"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("some").alias("some"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.collect_list("first.id").alias("pivots"))
        best = best.where("size > 1 and least < most and some")
        if held is not None:
            best = best.groupBy("x", "y", "size").agg(F.min(F.struct("g", "first", "pivots")).alias("b")).select("size", "b.*")
        best = best.select("g", "pivots", F.col("first.id").alias("first"), (F.col("size") - F.size("pivots") > 1).alias("more"))
        met = rows.join(best, "g").withColumn("pivot", F.array_contains("pivots", F.col("id"))).withColumn("a", F.explode("pivots")).where("a <> id and (not pivot or a < id)")
        pairs = durable(met.groupBy("a", F.col("id").alias("b")).agg(F.max(F.expr("more and not pivot and a = first")).alias("more")))
        if not pairs.take(1):
            release(*[x for x in (pairs, large, held) if x is not None])
            return
        found = durable(compare(pairs, among(ctx, ["id"], _ends(pairs)), size, k, percent))
        release(*[x for x in (pairs, large, held) if x is not None])
        yield found
        # A shingle that no other class of the group has leaves no row.
        dealt = found.select(F.col("b").alias("id"), "open", "a", F.explode("tokens").alias("t")).select(F.xxhash64("a", "t").alias("g"), "id", "open")
        shared = dealt.select("g").groupBy("g").count().where("count > 1").select("g")
        held = durable(dealt.join(shared, "g"))
        rows = held.join(among(about, ["id"], held.select("id")), "id")
        pivots = min(4 * pivots, MOST_PIVOTS)


def _span(pos, x: str, size: int):
    return F.array((pos + F.col(x)[0]).cast("int"), (pos + F.col("reps") - 2 + F.col(x)[1] + size).cast("int"))


def matches(docs: DataFrame, size: int = PARAGRAPH, k: int = K, percent: int = PERCENT, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """((doc, v, all, gone), (u, v)): for each text the word spans that another document
    shares, and those that an earlier one has; links between documents. docs: doc_id,
    v, text."""
    docs = docs.where("doc_id is not null and text is not null")
    raw = durable(anchors(docs, tune_bands(percent, recall), size, k))
    shared = durable(raw.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key"))
    collect_shuffles(docs.sparkSession)
    live = durable(among(raw, ["key"], shared).join(shared, "key"))
    release(raw, shared)
    classes = live.groupBy("key", "cls").agg(F.min(F.struct("doc", "v", "pos")).alias("at"), F.max("doc").alias("hi"), F.first("m").alias("m"), F.first("off").alias("off"), F.sum("reps").alias("n"))
    classes = durable(classes.select("key", "cls", F.col("at.doc").alias("lo"), F.col("at.v").alias("v"), F.col("at.pos").alias("pos"), "m", "off", "hi", "n"))
    several = classes.groupBy("key").count().where("count > 1").select("key")
    asked = durable(classes.join(several, "key"))
    ctx = durable(contexts(asked, docs, size, k).withColumn("id", F.monotonically_increasing_id()))
    release(asked)
    hits = [classes.where("lo < hi").select("key", "cls", F.array(F.array(F.lit(0), "m")).alias("runs"), F.col("lo").alias("low"), F.col("hi").alias("high"))]
    links = [live.select("key", "cls", "doc").join(classes.where("lo < hi").select("key", "cls", "lo"), ["key", "cls"]).where("doc <> lo").select(F.col("doc").alias("u"), F.col("lo").alias("v")).distinct()]
    rounds = []
    side = lambda near, s, *more: near.select(F.col("id").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in more])
    for met in _levels(ctx, size, k, percent):
        if "mine" not in met.columns:
            hits.append(met.where("r is not null").select("key", "cls", F.array("r").alias("runs"), "low", "high"))
            links.append(met.where("u <> v").select("u", "v"))
            rounds.append(met)
            continue
        match = met.where("size(mine) > 0").select("a", "b", "mine", "theirs")
        near = among(ctx.select("id", "lo", "hi", "key", "cls"), ["id"], _ends(match))
        some = durable(match.join(side(near, "b", "key", "cls"), "b").join(side(near, "a", "cls"), "a").drop("a", "b"))
        rounds.append(some)
        hits += [some.select(F.col("key_b").alias("key"), F.col("cls_b").alias("cls"), F.col("theirs").alias("runs"), F.col("lo_a").alias("low"), F.col("hi_a").alias("high")), some.select(F.col("key_b").alias("key"), F.col("cls_a").alias("cls"), F.col("mine").alias("runs"), F.col("lo_b").alias("low"), F.col("hi_b").alias("high"))]
        links.append(some.where("lo_a <> lo_b").select(F.col("lo_a").alias("u"), F.col("lo_b").alias("v")))
        rounds.append(met)
    for parts in (hits, links):
        while len(parts) > 1:
            parts[-2:] = [parts[-2].union(parts[-1])]
    # Of equal runs of paragraphs the smallest and the largest document say all.
    found = hits[0].select("key", "cls", F.explode("runs").alias("r"), "low", "high").groupBy("key", "cls", "r").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.groupBy("key", "cls").agg(F.collect_list(F.struct("r", "low", "high")).alias("runs"))
    spans = live.join(found, ["key", "cls"]).select("doc", "v", F.col("pos").alias("_p"), "reps", F.explode("runs").alias("x"))
    spans = spans.where("x.low <> doc or x.high <> doc").select("doc", "v", _span(F.col("_p"), "x.r", size).alias("s"), (F.col("x.low") < F.col("doc")).alias("later"))
    spans = spans.groupBy("doc", "v").agg(F.collect_set("s").alias("all"), F.collect_set(F.when(F.col("later"), F.col("s"))).alias("gone"))
    spans = durable(spans.select("doc", "v", *[F.expr(_union_words(c)).alias(c) for c in ("all", "gone")]))
    links = durable(links[0].distinct())
    release(live, classes, ctx, *rounds)
    return spans, links


def _union_words(spans) -> str:
    """SQL: the merged spans of an array of spans."""
    return f"""aggregate(array_sort({spans}), cast(array() as array<array<int>>), (acc, s) ->
      if(size(acc) > 0 and acc[size(acc) - 1][1] >= s[0],
         concat(slice(acc, 1, size(acc) - 1), array(array(acc[size(acc) - 1][0], greatest(acc[size(acc) - 1][1], s[1])))),
         concat(acc, array(s))))"""


def repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, v, component_id, repeated, removed) of the texts of documents that
    share a passage: merged word spans shared at all, and those that repeat an earlier
    document. v tells texts of one doc_id apart."""
    docs = _texts(docs)
    spans, links = matches(docs, **options)
    comps = durable(components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")))
    release(links)
    return spans.withColumnRenamed("doc", "doc_id").join(comps, "doc_id").select("doc_id", "v", "component_id", F.col("all").alias("repeated"), F.col("gone").alias("removed"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("v"), "text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its cluster (its own id: it shares no passage), words
    in shared passages, words that are repeats of an earlier document, their
    spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = durable(repeats(docs))
    words = lambda c: F.coalesce(F.expr(f"aggregate({c}, 0L, (n, x) -> n + x[1] - x[0])"), F.lit(0))
    return _texts(docs).drop("text").join(found, ["doc_id", "v"], "left").select(
        "doc_id",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        words("repeated").alias("n_repeated_words"),
        words("removed").alias("n_removed_words"),
        F.coalesce(F.expr("array_join(transform(removed, x -> concat(x[0], '-', x[1])), ',')"), F.lit("")).alias("removed_spans"),
        F.col("component_id").isNotNull().alias("repeats"),
    )


def remove(docs: DataFrame, **options) -> DataFrame:
    """docs without repeats of earlier documents; a document that is all repeat
    goes. Columns stay as they are; n_chars, if there, follows the text."""
    gone = durable(repeats(docs.select("doc_id", "text"), **options).where("size(removed) > 0").select(F.col("doc_id").alias("_quill_id"), F.col("v").alias("_quill_v"), F.col("removed").alias("_quill_spans")))
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            k, c = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else -1
            columns, spans = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, bool)
            if len(rows):
                text, chars = columns[k].to_pylist(), columns[c].to_pylist() if c >= 0 else []
                spans = spans.take(pa.array(rows)).to_pylist()
                for w in text_blocks(columns[k].take(pa.array(rows)), NON_SPACE, SMALL_SLICE):
                    for d in range(len(w.at) - 1):
                        f, o = int(w.at[d]), int(w.offsets[d])
                        raw, at, out = w.data[o : int(w.offsets[d + 1])].tobytes(), 0, []
                        for a, b in spans[w.first + d]:
                            out.append(raw[at : int(w.start[f + a]) - o])
                            at = int(w.end[f + b - 1]) - o
                        i = int(rows[w.first + d])
                        text[i] = b"".join([*out, raw[at:]]).decode()
                        keep[i] = bool(text[i].strip())
                        if c >= 0:
                            chars[i] = len(text[i])
                columns[k] = pa.array(text, batch.schema.field(k).type)
                if c >= 0:
                    columns[c] = pa.array(chars, batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(keep))

    small_arrow(docs.sparkSession)
    joined = docs.join(gone, (docs["doc_id"] == gone["_quill_id"]) & (F.hash(docs["text"]) == gone["_quill_v"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], "_quill_spans").mapInArrow(cut, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages that an earlier document has go."""
    return remove(docs)
