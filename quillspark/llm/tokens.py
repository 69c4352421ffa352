"""Token-id files: an adaptive context-mixing range coder over token ids.

A file is a sequence of blocks, each independently reset and checksummed. A block
holds up to ``LANES * STEPS`` ids, cut into lanes that are coded in step, so that
numpy does every operation for all lanes at once; the lanes share one model, which
is updated after each step and thus follows from what has been decoded.

The model predicts the next id from its order-2 context (two ids before it) or,
without one, from order 1; how often predictions of that confidence came true at
order 2 and order 1 and how frequent the id is at order 0 are mixed by learned
weights into the probability of a hit. A miss excludes the candidate and is coded by the adaptive
order-0 frequencies of the others. All arithmetic is on integers, so any machine decodes any file.

Carries are kept in wide digits and resolved when a block ends. Edge cases: null
and empty texts are the end id alone; an empty table gives no blocks; rows that
repeat a doc_id follow each other in order of a hash of their text; a damaged block raises
``DamagedBlock`` and leaves others readable."""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_SLICE, _inv, _pow, checkpoint_dir, durable, mix64, read, small_arrow, text_blocks

LANES, STEPS = 4096, 128
BLOCK = LANES * STEPS
END_ID = 0
MAGIC = b"QTK1"
_HEAD = struct.Struct("<4sIIIIIIII")  # magic, ids, documents, lanes, vocabulary, bytes of documents, of digits, crc of ids, crc of the rest
SEPARATOR = b"\n"
#: Bytes of text of a file, about.
RANGE_BYTES = 64 << 20
_LOW = np.uint64((1 << 40) - 1)
_MIN = np.uint64(1 << 40)
_TOP = np.uint64(1 << 56)
_16, _40 = np.uint64(16), np.uint64(40)
_GAIN = 24
_H2 = 1 << 18
_STATES = 8


def _logistic_tables():
    import math

    squash = [max(32, min(65536 - 32, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)]
    stretch = [max(-2047, min(2047, round(256 * math.log((i + 0.5) / (4096 - i - 0.5))))) for i in range(4096)]
    return np.array(squash, np.int32), np.array(stretch, np.int32)


_SQUASH, _STRETCH = _logistic_tables()


class DamagedBlock(ValueError):
    pass


#: State of a prediction after a miss (0-7) and after a hit (8-15).
_NEXT = np.array([s >> 1 for s in range(_STATES)] + [min(s + 1, _STATES - 1) for s in range(_STATES)], np.int32)
#: Of each key of ``_Mixer.predict``: the states of order 1 and 2, whether order 2 has a
#: candidate, whether order 1 agrees, whether order 1 has one.
_KEY1, _KEY2, _TWO, _AGREE, _ONE = (np.arange(512) >> shift & mask for shift, mask in ((0, 7), (3, 7), (6, 1), (7, 1), (8, 1)))
_KIND = _TWO * 2 + _AGREE


class _Mixer:
    """The model of a block. All lanes read it, then all lanes update it. Tables are read
    by ``take`` in the mode that checks no bounds; -1 is their last place."""

    def __init__(self, vocabulary: int, lanes: int):
        # One more, which stays 0, for no candidate.
        self.counts = np.ones(vocabulary + 1, np.int64)
        self.counts[-1] = 0
        self.count = self.counts[:-1]
        self.held, self.steps = [], 0
        # The id that followed and, in the lowest bits, how sure that is.
        self.next1, self.next2 = np.full(vocabulary + 1, -_STATES, np.int32), np.full(_H2, -_STATES, np.int32)
        self.hits = [np.full(_STATES, 2, np.int64) for _ in range(2)]
        self.seen = [np.full(_STATES, 4, np.int64) for _ in range(2)]
        # Fixed-point weights of order 2, 1 and 0, by whether the orders agree.
        self.weights = np.full((3, 4), 1 << 15, np.int64)
        self.weights[2] = 1 << 13
        self.before1 = np.full(lanes, vocabulary, np.int64)
        self.before2 = np.full(lanes, vocabulary, np.int64)
        self.cumulative = np.zeros(vocabulary + 1, np.int64)
        self._sum()
        self._tables()

    def _tables(self):
        """By key, what orders 1 and 2 say and its part of the mix, and the weight of order
        0. Weights are under 2 ** 19 and stretched odds under 2 ** 11: 32 bits hold a mix."""
        odds = [_STRETCH[np.minimum(4095, (h << 12) // s)] for h, s in zip(self.hits, self.seen, strict=True)]
        o1 = odds[0][_KEY1]
        self.x = np.where(_TWO, odds[1][_KEY2], 0), np.where(_AGREE, o1, -o1 >> 1)
        w = self.weights[:, _KIND].astype(np.int32)
        self.mixed, self.weight0 = w[0] * self.x[0] + w[1] * self.x[1], w[2]

    def _sum(self):
        np.cumsum(self.count, out=self.cumulative[1:])
        self.total = int(self.cumulative[-1])

    def predict(self, n: int):
        """(candidate or -1, probability of a hit in 65536ths, 0 without one) of lanes
        0..n-1. What orders 1 and 2 say is one of 512 keys."""
        b1, b2 = self.before1[:n], self.before2[:n]
        h2 = b2 * 0x9E3779B1
        h2 += b1 * 0x85EBCA6B
        h2 >>= 7
        h2 &= _H2 - 1
        self.h2 = h2
        n1, n2 = self.next1.take(b1, mode="wrap"), self.next2.take(h2, mode="wrap")
        self.c1, self.c2, self.s1, self.s2 = n1 >> 3, n2 >> 3, n1 & 7, n2 & 7
        two = n2 >= 0
        candidate = np.where(two, self.c2, self.c1)
        key = (self.c1 == candidate).astype(np.int32)
        key <<= 7
        key |= self.s2 << 3
        key |= self.s1
        key |= two.astype(np.int32) << 6
        key |= (n1 >= 0).astype(np.int32) << 8
        self.key = key.astype(np.int64)
        self.candidate = candidate.astype(np.int64)
        zero = self.counts.take(self.candidate, mode="wrap")
        zero <<= 12
        zero //= self.total
        self.x0 = _STRETCH.take(np.minimum(zero, 4095, out=zero), mode="wrap")
        dot = self.weight0.take(self.key, mode="wrap")
        dot *= self.x0
        dot += self.mixed.take(self.key, mode="wrap")
        dot >>= 16
        dot += 2047
        self.p = _SQUASH.take(dot, mode="clip")
        self.p *= candidate >= 0
        return self.candidate, self.p

    def without(self, tried: np.ndarray, ids: np.ndarray):
        """(first cumulative count of ids, count left out) after tried (or -1) has been
        excluded from order 0."""
        gone = self.counts.take(tried, mode="wrap")
        return self.cumulative.take(ids, mode="wrap") - gone * (tried < ids), gone

    def update(self, ids: np.ndarray, hit: np.ndarray, n: int):
        """hit: where the candidate was right."""
        new = ids.astype(np.int32)
        right1, right2 = (self.c1 == new).astype(np.int32), (self.c2 == new).astype(np.int32)
        right1 <<= 3
        right2 <<= 3
        if self.steps % 2 == 0:  # weights and odds learn from every second step
            # Times each key came, by whether orders 1 and 2 were right.
            came = np.bincount(self.key + (right1 << 6) + (right2 << 7), minlength=2048).reshape(2, 2, 512)
            each = came.sum(axis=(0, 1))
            error = (hit.astype(np.int32) << 16) - self.p
            by_key = np.bincount(self.key, error, minlength=512).astype(np.int64)
            by_zero = np.bincount(self.key, error * self.x0, minlength=512)
            seen = (np.bincount(_KIND, each, minlength=4).astype(np.int64) + 64) * 256
            for k, moved in enumerate((by_key * self.x[0], by_key * self.x[1], by_zero)):
                self.weights[k] += np.bincount(_KIND, moved, minlength=4).astype(np.int64) // seen
            np.maximum(self.weights, -(1 << 18), out=self.weights)
            np.minimum(self.weights, 1 << 18, out=self.weights)
            for k, (state, there, right) in enumerate(((_KEY1, _ONE, came[:, 1].sum(axis=0)), (_KEY2, _TWO, came[1].sum(axis=0)))):
                self.seen[k] += np.bincount(state, each * there, minlength=_STATES).astype(np.int64)
                self.hits[k] += np.bincount(state, right, minlength=_STATES).astype(np.int64)
            self._tables()
        b1 = self.before1[:n]
        new <<= 3
        self.s1 |= right1
        self.s2 |= right2
        self.next1[b1] = new | _NEXT.take(self.s1, mode="wrap")
        self.next2[self.h2] = new | _NEXT.take(self.s2, mode="wrap")
        self.before2[:n] = b1
        self.before1[:n] = ids
        self.held.append(ids)
        self.steps += 1
        if self.steps <= 16 or self.steps % 8 == 0:
            self.count += _GAIN * np.bincount(np.concatenate(self.held), minlength=len(self.count))
            self.held = []
            self._sum()


def _u(x) -> np.ndarray:
    """Integers that are not negative, unsigned."""
    return x.view(np.uint64)


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, bytes]:
    """(lanes, digits) of at most BLOCK ids."""
    lanes = -(-len(ids) // STEPS)
    model = _Mixer(vocabulary, lanes)
    grid = np.zeros(lanes * STEPS, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    short = len(ids) - (lanes - 1) * STEPS
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 56) - 1, np.uint64)
    digits = np.zeros((lanes, STEPS * 3 + 2), np.uint32)
    flat, rows = digits.reshape(-1), np.arange(lanes) * digits.shape[1]
    at = rows.copy()
    for step in range(STEPS):
        n = lanes if step < short else lanes - 1
        if not n:
            break
        now = grid[step, :n]
        candidate, p = model.predict(n)
        hit = now == candidate
        lo, sp = low[:n], span[:n]
        cut = sp >> _16
        cut *= p.astype(np.uint64)
        lo += cut * ~hit
        sp[:] = np.where(hit, cut, sp - cut)
        miss = np.flatnonzero(~hit)
        if len(miss):
            got = now.take(miss, mode="wrap")
            first, gone = model.without(candidate.take(miss, mode="wrap"), got)
            r = sp.take(miss, mode="wrap") // _u(model.total - gone)
            lo[miss] += r * _u(first)
            sp[miss] = r * _u(model.count.take(got, mode="wrap"))
        # Digits are of 16 bits and a carry.
        todo = np.flatnonzero(sp < _MIN)
        while len(todo):
            part, to, wide = lo.take(todo, mode="wrap"), at.take(todo, mode="wrap"), sp.take(todo, mode="wrap") << _16
            flat[to] = part >> _40
            at[todo] = to + 1
            lo[todo] = (part & _LOW) << _16
            sp[todo] = wide
            todo = todo[wide < _MIN]
        model.update(now, hit, n)
    # The one digit whose continuation by zeros lies inside the last span.
    flat[at] = (low + _LOW) >> _40
    at += 1 - rows
    for j in range(int(at.max()) - 1, 0, -1):
        digits[:, j - 1] += digits[:, j] >> 16
    digits &= 0xFFFF
    taken = np.arange(digits.shape[1])[None, :] < at[:, None]
    return lanes, at.astype("<u2").tobytes() + digits[taken].astype("<u2").tobytes()


def decode_ids(data: bytes, n_ids: int, lanes: int, vocabulary: int) -> np.ndarray:
    model = _Mixer(vocabulary, lanes)
    sizes = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    own = np.frombuffer(data, "<u2", offset=2 * lanes)
    if int(sizes.sum()) != len(own):
        raise DamagedBlock("lengths of lanes")
    # Zeros follow the digits of each lane.
    at = np.cumsum(sizes + 8) - sizes - 8
    digits = np.zeros(len(own) + 8 * lanes + 1, np.uint64)
    digits[np.arange(len(own)) + np.repeat(8 * np.arange(lanes), sizes)] = own
    code = np.zeros(lanes, np.uint64)
    # The code holds 56 bits: three digits and the upper half of the next.
    for k, shift in enumerate((40, 24, 8)):
        code += digits[at + k] << np.uint64(shift)
    at += 3
    code += digits[at] >> np.uint64(8)
    # 16 bits from the middle of one digit to that of the next.
    following = ((digits[:-1] & np.uint64(255)) << np.uint64(8)) | (digits[1:] >> np.uint64(8))
    span = np.full(lanes, (1 << 56) - 1, np.uint64)
    out = np.zeros((STEPS, lanes), np.int64)
    short = n_ids - (lanes - 1) * STEPS
    for step in range(STEPS):
        n = lanes if step < short else lanes - 1
        if not n:
            break
        candidate, p = model.predict(n)
        co, sp = code[:n], span[:n]
        cut = sp >> _16
        cut *= p.astype(np.uint64)
        hit = co < cut
        co -= cut * ~hit
        sp[:] = np.where(hit, cut, sp - cut)
        now = out[step, :n]
        now[:] = candidate
        miss = np.flatnonzero(~hit)
        if len(miss):
            tried, width = candidate.take(miss, mode="wrap"), sp.take(miss, mode="wrap")
            gone = model.counts.take(tried, mode="wrap")
            r = width // _u(model.total - gone)
            left = co.take(miss, mode="wrap")
            value = np.minimum((left // r).view(np.int64), model.total - gone - 1)
            value += gone * (value >= model.cumulative.take(tried, mode="wrap"))
            got = np.searchsorted(model.cumulative, value, "right") - 1
            first, _ = model.without(tried, got)
            now[miss] = got
            co[miss] = left - r * _u(first)
            sp[miss] = r * _u(model.count.take(got, mode="wrap"))
        todo = np.flatnonzero(sp < _MIN)
        while len(todo):
            to, wide = at.take(todo, mode="wrap"), sp.take(todo, mode="wrap") << _16
            co[todo] = (co.take(todo, mode="wrap") << _16) | following.take(to, mode="clip")
            at[todo] = to + 1
            sp[todo] = wide
            todo = todo[wide < _MIN]
        model.update(now, hit, n)
    return out.T.ravel()[:n_ids]


def pack_block(ids: np.ndarray, documents: np.ndarray, vocabulary: int) -> bytes:
    """documents: (doc_id, ids, null flag) of documents that end in this block."""
    table = zlib.compress(np.ascontiguousarray(documents, "<i8").tobytes(), 1)
    lanes, digits = encode_ids(ids, vocabulary) if len(ids) else (0, b"")
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    head = _HEAD.pack(MAGIC, len(ids), len(documents), lanes, vocabulary, len(table), len(digits), crc, zlib.crc32(digits, zlib.crc32(table)))
    return head + table + digits


def unpack_blocks(data: bytes):
    """(ids, documents) of each block of a file."""
    at, seps = 0, len(SEPARATOR)
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise DamagedBlock(f"byte {at}: no header")
        magic, n, docs, lanes, vocabulary, a, b, crc, rest = _HEAD.unpack_from(data, at)
        body = data[at + _HEAD.size : at + _HEAD.size + a + b]
        if magic != MAGIC or len(body) != a + b or zlib.crc32(body) != rest:
            raise DamagedBlock(f"byte {at}: checksum")
        ids = decode_ids(body[a:], n, lanes, vocabulary) if n else np.zeros(0, np.int64)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise DamagedBlock(f"byte {at}: checksum of ids")
        yield ids, np.frombuffer(zlib.decompress(body[:a]), "<i8").reshape(docs, 3)
        at += _HEAD.size + a + b + seps


# ---------------------------------------------------------------- tokenizing

_CLASS = np.full(256, 3, np.int8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[48:58] = 2
#: Texts that the cutting by bytes cannot judge: apostrophes, and characters
#: beyond ASCII that are not letters. The tokenizer reads them whole.
_HARD = r"'|[^\x00-\x7F\p{L}]"
_CACHE = 1_000_000
_LAST_BITS = 20
_UP = np.arange(1, 257, dtype=np.uint64)


class Pieces:
    """The tokenizer behind a bounded cache of the ids of its pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        # Added tokens are cut out before pre-tokens: a text that may hold one is read whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.hard = "|".join([_HARD, *(re.escape(x) for x in added)])
        # The byte-level alphabet: printable bytes as they are, others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.shown = np.arange(256, dtype="<u4")
        self.shown[others] = 256 + np.arange(len(others))
        self.clear()

    def clear(self):
        self.ids, self.first, self.size, self.used, self.n = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
        # Slots by the lower bits of their hashes, or in the next free place; -1: free.
        self.table = np.full(1 << 17, -1, np.int32)
        # The slot met last for the upper bits of a hash, and the hash of each slot.
        self.last, self.hash = np.zeros(1 << _LAST_BITS, np.int32), np.zeros(1 << 16, np.uint64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it has none."""
        out, left, mask = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), len(self.table) - 1
        place = (hashes & np.uint64(mask)).view(np.int64)
        while len(left):
            slots = self.table[place]
            hit = (slots >= 0) & (self.hash[slots] == hashes[left])
            out[left[hit]] = slots[hit]
            on = (slots >= 0) & ~hit
            left, place = left[on], (place[on] + 1) & mask
        return out

    def enter(self, slots: np.ndarray) -> None:
        """Put slots into the table; their hashes differ from all others."""
        mask = len(self.table) - 1
        place = (self.hash[slots] & np.uint64(mask)).view(np.int64)
        while len(slots):
            free = self.table[place] < 0
            self.table[place[free]] = slots[free]
            on = self.table[place] != slots
            slots, place = slots[on], (place[on] + 1) & mask

    def add(self, hashes, texts) -> None:
        merge = self.tokenizer.model.tokenize
        size = self.used + sum(map(len, texts))  # an id has a byte at least
        if size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(size, len(self.ids)), np.int32)])
        if self.n + len(texts) > len(self.first):
            self.first, self.size, self.hash = (np.concatenate([x, np.zeros(max(len(texts), len(x)), x.dtype)]) for x in (self.first, self.size, self.hash))
        found = [[t.id for t in merge(x)] for x in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        n, used = len(found), int(sizes.sum())
        self.ids[self.used : self.used + used] = np.fromiter((i for x in found for i in x), np.int32, used)
        self.first[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        self.hash[self.n : self.n + n] = hashes
        self.used += used
        self.n += n
        fresh = np.arange(self.n - n, self.n)
        if 2 * self.n > len(self.table):
            self.table, fresh = np.full(1 << (4 * self.n).bit_length(), -1, np.int32), np.arange(self.n)
        self.enter(fresh)

    def slice(self, w) -> list[np.ndarray]:
        """Ids of each text of a slice (Words of bytes alone), without end ids."""
        data, o = w.data, w.offsets
        n = len(data)
        if not n:
            return [np.zeros(0, np.int32)] * (len(o) - 1)
        c = _CLASS.take(data, mode="wrap")
        start = np.zeros(n + 1, bool)
        space = c == 0
        prev, nxt = np.empty(n, np.int8), np.empty(n, np.int8)
        prev[0], prev[1:] = -1, c[:-1]
        nxt[-1], nxt[:-1] = -1, c[1:]
        inner = o[(o > 0) & (o < n)]
        prev[inner] = -1
        nxt[inner - 1] = -1
        blank = np.zeros(n, bool)
        blank[1:] = data[:-1] == 32
        blank[prev == -1] = False
        start[:n] = np.where(space, (prev != 0) | (nxt > 0), (prev != c) & ~blank)
        start[:n][prev == -1] = True
        s = np.flatnonzero(start[:n])
        e = np.append(s[1:], n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_UP.take(data, mode="wrap") * _pow.upto(n), out=sums[1:])
        h = mix64((sums.take(e, mode="wrap") - sums.take(s, mode="wrap")) * _inv.upto(n).take(s, mode="wrap"))
        if self.n > _CACHE:
            self.clear()
        place = (h >> np.uint64(64 - _LAST_BITS)).view(np.int64)
        slots = self.last.take(place, mode="wrap").astype(np.int64)
        left = np.flatnonzero(self.hash.take(slots, mode="wrap") != h) if self.n else np.arange(len(h))
        if len(left):
            known, first, at = np.unique(h[left], return_index=True, return_inverse=True)
            found = self.find(known)
            new = np.flatnonzero(found < 0)
            if len(new):
                base = self.n
                shown = self.shown[data].tobytes().decode("utf-32-le")
                at_new = left[first[new]]
                self.add(known[new], [shown[a:b] for a, b in zip(s[at_new].tolist(), e[at_new].tolist(), strict=True)])
                found[new] = np.arange(base, base + len(new))
            slots[left] = found[at]
            self.last[place[left[first]]] = found
        size = self.size.take(slots, mode="wrap")
        ends = np.cumsum(size)
        flat = self.ids.take(np.repeat(self.first.take(slots, mode="wrap") - ends + size, size) + np.arange(ends[-1]), mode="wrap")
        bounds = np.concatenate([[0], ends])[np.searchsorted(s, o)]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def batch(self, column) -> list[np.ndarray]:
        if column.null_count:
            column = column.fill_null("")
        hard = pc.match_substring_regex(column, self.hard)
        easy = pc.if_else(hard, "", column)
        out = [x for w in text_blocks(easy, None, SMALL_SLICE) for x in self.slice(w)]
        for i in np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.whole(column[i].as_py())
        return out


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One a worker process, so that later tasks find its cache warm."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Token files of docs (doc_id, text) in ascending doc_id order under path, by
    Spark's own writer: rows are blocks, the line separator closes each."""

    def blocks(batches):
        pieces = pieces_of(tokenizer_path)
        waiting, size, table = [], 0, []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, x in zip(ids, pieces.batch(batch.column(1)), strict=True):
                waiting += [x, np.array([end_id], np.int32)]
                size += len(x) + 1
                table.append((doc or 0, len(x) + 1, doc is None))
                if size >= BLOCK:
                    flat = np.concatenate(waiting)
                    for k in range(0, len(flat) - BLOCK + 1, BLOCK):
                        yield pa.RecordBatch.from_arrays([pa.array([pack_block(flat[k : k + BLOCK], np.array(table, np.int64).reshape(-1, 3), pieces.vocabulary)], pa.binary())], ["block"])
                        table = []
                    flat = flat[len(flat) // BLOCK * BLOCK :]
                    waiting, size = [flat], len(flat)
        if size or table:
            yield pa.RecordBatch.from_arrays([pa.array([pack_block(np.concatenate(waiting), np.array(table, np.int64).reshape(-1, 3), pieces.vocabulary)], pa.binary())], ["block"])

    spark = docs.sparkSession
    small_arrow(spark)
    # A range is a file and is read as a whole: ranges follow the bytes of text. The
    # hash lets one doc_id, or none, take several.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    dealt.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), decoded from the files under path."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, known, at, out = [], [], 0, []
                size = 0

                def flush(out=out):
                    nonlocal held, known, at, size
                    flat = np.concatenate(held) if held else np.zeros(0, "<u4")
                    used, done = 0, 0
                    for doc, n, null in known:
                        if used + n > len(flat):
                            break
                        out.append((name, None if null else doc, at, n, zlib.crc32(flat[used : used + n].tobytes())))
                        used += n
                        at += n
                        done += 1
                    known, held, size = known[done:], [flat[used:]], len(flat) - used

                for ids, documents in unpack_blocks(content.as_py()):
                    held.append(ids.astype("<u4"))
                    known += documents.tolist()
                    flush()
                flush()
                if size or known:
                    raise DamagedBlock(f"{name}: ids and documents do not match")
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = durable(files.mapInArrow(parse, "file string, doc_id long, start long, n_tokens long, ids_crc32 long"))
    # A row a file: part numbers follow the order of doc_id.
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(before, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, path)
