"""The training-data operators against brute force, round trips and accuracy."""

import base64
import hashlib
import itertools
import random
import struct
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, language, ngram_join, packing, quality, substring_dedup, tokens, toxicity, url_filter, warc
from quillspark.llm.common import components
from quillspark.llm.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, key int"


def words(r, n, v=5000):
    return " ".join(f"w{r.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    r = random.Random(1)
    base = words(r, 300)
    near = base.split()
    near[10] = "changed"
    passage = words(r, 60)
    rows = [
        (0, base, "en", "a", 1, "x", 1), (1, base, "en", "a", 1, "x", 1), (2, " ".join(near), None, None, None, None, None), (3, None, None, None, None, None, None), (4, "", "en", "a", 0, "x", 1),
        (5, words(r, 20000), "en", "a", 1, "x", 1), (6, words(r, 80) + " " + passage + " " + words(r, 80), "en", "a", 1, "x", 1), (7, words(r, 90) + " " + passage + " " + words(r, 70), "en", "a", 1, "x", 1),
        (8, "few words", "en", "a", 1, "x", 1), (9, "few words", "en", "a", 1, "x", 1), (10, "\x00 \t\n", "en", "a", 1, "x", 1), (None, "nobody", "en", "a", 1, "x", 1), (11, words(r, 100), "en", "a", 1, "x", 1), (11, None, "en", "a", 1, "x", 1),
    ]
    rows.append(rows[6])
    return spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    a, b = QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(a.columns)
    plain = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # noqa: E731  a null makes integers floats
    rows = [x[cols].map(plain).sort_values(cols).reset_index(drop=True) for x in (a, b)]
    assert rows[0].equals(rows[1])


# ------------------------------------------------------------------- 1 tokens


def test_ids_round_trip_and_damage():
    r = np.random.default_rng(0)
    for n in (1, 2, 127, 128, 129, 5000):
        ids = np.minimum(r.geometric(0.01, n), 299) * 7
        data = tokens.pack_block(ids, np.array([[5, n, 0]]), 2100) + tokens.SEPARATOR
        (back, table), = tokens.unpack_blocks(data)
        assert (back == ids).all() and table.tolist() == [[5, n, 0]]
    for at in (0, 20, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 8
        with pytest.raises((tokens.DamagedBlock, struct.error, zlib.error)):
            list(tokens.unpack_blocks(bytes(bad)))
    assert len(data) < 2 * 5000


def test_pieces_are_the_tokenizers():
    import public_tokenizers

    p = tokens.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a  b\n\nc", " x", "x ", "\n", "don't  stop", "a\t b", "été  à 12ab3 !!", "«x» y", None, "a\x00b", "  \n  x  ", "<|endoftext|>"]
    assert [x.tolist() for x in p.batch(pa.array(texts))] == [p.whole(t or "").tolist() for t in texts]


def test_token_files(spark, odd, empty, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.write(odd, str(tmp_path / "a"), path)
    rows = sorted(tokens.read_back(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count() and [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    null = next(r for r in rows if r.doc_id == 3)
    assert (null.n_tokens, null.ids_crc32) == (1, zlib.crc32(struct.pack("<I", 0)))
    tokens.write(empty, str(tmp_path / "b"), path)
    assert tokens.read_back(spark, str(tmp_path / "b")).count() == 0


# ----------------------------------------------------------------- 2 toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_toxicity_edges(spark, odd, empty):
    f = toxicity.features(odd.select("doc_id", "text"))
    scored = toxicity.score(f, toxicity.Model(np.zeros((0, len(toxicity.FEATURES))), np.zeros(0))).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.features(empty.select("doc_id", "text")).count() == 0


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    s = r.random(500)
    _, v = toxicity.isotonic(s, (r.random(500) < s).astype(int))
    assert (np.diff(v) > 0).all()


# ------------------------------------------------- 3 and 5 edges, 4 optimality


def test_decontamination_removes_and_keeps(spark, odd, empty):
    bench = spark.createDataFrame([("i", odd.where("doc_id = 6").first().text[-200:]), ("j", None), ("k", "few words")], "item_id string, text string")
    out = decontaminate.remove(odd, bench)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and 8 not in kept and 9 not in kept and kept.count(6) == 2 and len(kept) == odd.count() - 2
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.remove(odd, bench.limit(0)).count() == odd.count()


def test_many_blocks_equal_one(spark, odd, monkeypatch):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    one = sorted(map(str, decontaminate.scan(docs, bench).select("doc_id", "_spans", "_items").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 300)
    assert sorted(map(str, decontaminate.scan(docs, bench).select("doc_id", "_spans", "_items").collect())) == one


def test_many_blocks_remove_the_same(spark, odd, monkeypatch):
    r = random.Random(8)
    item = words(r, 60)
    docs = odd.union(spark.createDataFrame([(20, f"{words(r, 100)} {item} {words(r, 50)}", "en", "a", 1, "x", 1), (21, f"{words(r, 20)} {item} {words(r, 20)}", None, None, None, None, None)], SCHEMA))
    bench = spark.createDataFrame([("i", item), ("j", odd.where("doc_id = 6").first().text[-200:]), ("k", "few words")], "item_id string, text string")
    one = sorted(map(str, decontaminate.remove(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 20)
    many = decontaminate.remove(docs, bench)
    assert many.columns == docs.columns and sorted(map(str, many.collect())) == one
    assert not any("Row(doc_id=21," in x for x in one) and any("Row(doc_id=20," in x for x in one)


def test_boundaries_are_optimal():
    r = np.random.default_rng(1)
    for _ in range(60):
        c, k = r.integers(0, 6, 9), int(r.integers(1, 5))
        used = [(i + 1) * 8 for i in range(9) if c[i]]
        if not used:
            continue
        cost = lambda bs: sum(c[i] * (min(x for x in bs if x >= (i + 1) * 8) - (i + 1) * 8) for i in range(9) if c[i])  # noqa: B023, E731
        best = min(cost([*s, used[-1]]) for n in range(k) for s in itertools.combinations(used[:-1], n))
        got = packing.boundaries(c, 8, k)
        assert cost(got) == best and len(got) <= k


def test_packing_places(spark, odd, empty):
    path = packing.default_tokenizer()
    pieces = tokens.Pieces(path)
    lengths = packing.token_lengths(odd, path)
    rows = packing.pack(lengths, token_budget=8192).collect()
    own = sorted((r.doc_id is not None, r.doc_id or 0, len(pieces.whole(r.text or "")) + 1) for r in odd.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in rows if not r.segment) == own
    assert sum(r.length for r in rows) == sum(n for *_, n in own) and all(r.length <= 4096 for r in rows)
    assert len({(r.bucket, r.batch, r.place) for r in rows}) == len(rows)
    ends = {r.bucket_length for r in rows}
    for r in rows:
        assert r.bucket_length == min(e for e in ends if e >= r.length) and (r.place + 1) * r.bucket_length <= max(8192, r.bucket_length)
    for b in {r.bucket for r in rows}:
        size = {}
        for r in rows:
            if r.bucket == b:
                size[r.batch] = size.get(r.batch, 0) + 1
        assert sorted(size) == list(range(len(size))) and all(size[k] == size[0] for k in range(len(size) - 1))
    assert packing.pack(packing.token_lengths(empty, path)).count() == 0


def test_packed_batches_hold_the_ids(spark, odd):
    path = packing.default_tokenizer()
    pieces, docs = tokens.Pieces(path), odd.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    out = packing.batch_ids(docs, packing.pack(packing.token_lengths(docs, path), max_len=512), path, max_len=512).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.segment):
        assert len(r.ids) == r.bucket_length and not any(r.ids[r.length :])
        got.setdefault((r.doc_id, r.n_tokens), []).extend(r.ids[: r.length])
    assert got == {(r.doc_id, len(x) + 1): [*x, 0] for r in docs.collect() for x in [pieces.whole(r.text or "").tolist()]}


def test_quality_is_native_and_total(odd, empty):
    out = quality.judge(odd, prefix="_q_")
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.count() == odd.count() and quality.judge(empty).count() == 0
    assert {r.doc_id for r in out.where("_q_n_words = 0").collect()} >= {3, 4}


# ----------------------------------------------------------------- 6 language


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op6_language"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_edges(spark, odd, empty):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "12 !?"), (3, "a\x00b"), (4, "Ü"), (5, "é" * 5000)], "doc_id long, text string")
    model = language.learn(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "x", None)], "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in language.predict(docs, *model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and all(rows[i].lang_pred in ("en", "de") and 0 <= rows[i].score <= 1 for i in (3, 4, 5))
    assert {r.lang_pred for r in language.predict(docs, *language.learn(empty)).collect()} == {"und"}


# --------------------------------------------------------------- 7 and 10


def test_substring_finds_every_long_repeat(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, hit = {}, set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = r.text.lower().split()
        own = {" ".join(w[i : i + 50]) for i in range(len(w) - 49)}
        for g in own:
            if g in seen:
                hit |= {seen[g], r.doc_id}
            seen.setdefault(g, r.doc_id)
    got = {r.doc_id for r in substring_dedup.repeats(docs).collect()}
    assert hit and hit <= got


def test_substring_edges(spark, odd, empty):
    rows = {r.doc_id: r for r in substring_dedup.repeats(odd.select("doc_id", "text")).collect()}
    assert set(rows) == {0, 1, 2, 6, 7} and rows[7].component_id == 6 and rows[7].removed[0][1] - rows[7].removed[0][0] >= 60 and not rows[6].removed
    out = substring_dedup.remove(odd)
    assert out.columns == odd.columns and {6, 7, 5} <= {r.doc_id for r in out.collect()}
    assert substring_dedup.remove(empty).count() == 0


def test_substring_finds_every_copy_in_a_document(spark):
    r, texts, copies = random.Random(5), {}, {}
    for i in range(60):
        passage = words(r, r.randrange(60, 200), 10**6).split()
        a = [words(r, 40, 10**6), " ".join(passage), words(r, 40, 10**6)]
        b = [words(r, 40, 10**6), " ".join(passage), words(r, 70, 10**6), " ".join(passage), words(r, 30, 10**6)]
        if i % 2:  # its shingles in other surroundings first
            b[:2] = [words(r, 3, 10**6).join(["", *(" " + " ".join(passage[k : k + 5]) + " " for k in range(0, len(passage) - 4, 5)), ""])]
        texts[2 * i], texts[2 * i + 1] = " ".join(a), " ".join(b)
        n, w = len(passage), texts[2 * i + 1].split()
        copies[2 * i + 1] = [[k, k + n] for k in range(len(w) - n + 1) if w[k : k + n] == passage]
    got = {x.doc_id: x.removed for x in substring_dedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(map(len, copies.values())) == 90
    assert [(i, c) for i, cs in copies.items() for c in cs if not any(a <= c[0] and c[1] <= b for a, b in got.get(i, []))] == []


def _edited(r, n, kind):
    """Two texts with a passage of n words, the second with one word changed."""
    passage = words(r, n, 10**6).split()
    at, other = r.randrange(1, n - 1), passage[:]
    if kind == "substituted":
        other[at] = "x"
    elif kind == "inserted":
        other.insert(at, "x")
    elif kind == "deleted":
        del other[at]
    elif kind == "moved":
        other[at], other[at + 1] = other[at + 1], other[at]
    return [" ".join([words(r, r.randrange(60), 10**6), *p, words(r, r.randrange(60), 10**6)]) for p in (passage, other)]


def _paragraphs(text):
    w = (text or "").split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return [set(grams[i : i + 46]) for i in range(len(grams) - 45)]


def _alike(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


def test_substring_finds_every_kind_of_edit(spark):
    r, texts, true = random.Random(7), {}, {}
    for kind, n in itertools.product(("substituted", "inserted", "deleted", "moved"), (50, 52, 60, 100)):
        for _ in range(60):
            a, b = _edited(r, n, kind)
            i = len(texts)
            texts |= {i: a, i + 1: b}
            x, y = _paragraphs(a), _paragraphs(b)
            if any(_alike(x[p], y[q]) for p in range(len(x)) for q in range(max(0, len(y))) if x[p] & y[q]):
                true.setdefault((kind, n), []).append(i + 1)
    got = {x.doc_id for x in substring_dedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("size(removed) > 0").collect()}
    assert got <= {i for found in true.values() for i in found} and sum(map(len, true.values())) > 700
    assert {k: len(got & set(v)) / len(v) for k, v in true.items() if len(got & set(v)) < 0.9 * len(v)} == {}


def test_substring_comparison_is_brute_force():
    r, span, found = random.Random(6), 46, 0
    for n in [*range(50, 61)] * 8:
        texts = _edited(r, n, r.choice(("inserted", "substituted", "deleted")))
        if n % 3 == 0:
            texts = [t + " " + " ".join(["again"] * r.randrange(60)) for t in texts]
        number = {}
        own, other = ([number.setdefault(tuple(w[i : i + 5]), 2 + len(number)) for i in range(len(w) - 4)] for w in map(str.split, texts))
        p = r.choice([i for i in range(len(own)) if own[i] in other])
        q = other.index(own[p])
        grids, ends = [], []
        for s, at in ((own, p), (other, q)):
            lo, hi = max(0, at - span + 1), min(at, len(s) - span)
            ends.append((lo - at + span - 1, hi - at + span))
            grids.append(np.full((1, 2 * span - 1), len(grids), np.uint32))
            if hi >= lo:
                grids[-1][0, ends[-1][0] : ends[-1][0] + hi - lo + span] = s[lo : hi + span]
        x, y = (np.array([e]) for e in ends)
        good, _, tokens = substring_dedup._compare(grids[0], x[:, 0], x[:, 1], grids[1], y[:, 0], y[:, 1], np.array([True]), 50, 5, 80)
        for c in range(span):
            inside = all(a <= c < b for a, b in ends)
            u, v = (set(g[0, c : c + span].tolist()) for g in grids)
            assert good[0, c] == (inside and _alike(u, v))
            if len(v) == span and ends[1][0] <= c < ends[1][1]:
                lacks = sorted(v - u) if ends[0][0] <= c < ends[0][1] else sorted(v)
                assert set(lacks[:6]) <= set(tokens[0])
        found += good.any()
    assert found > 50


def test_substring_families_against_brute_force(spark):
    """Texts of many edited copies, common lines and words many times over."""
    r, texts = random.Random(9), {}
    line, base = words(r, 13, 10**6), words(r, 150, 10**6).split()
    for i in range(60):
        w = base[:]
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"e{r.randrange(30)}"
        part = w[r.randrange(60) : r.randrange(90, 150)] if i % 3 else ["the"] * r.randrange(1, 90)
        texts[i] = " ".join([words(r, r.randrange(50), 10**6), line, *part, line, words(r, r.randrange(50), 10**6)])
    pars = {i: _paragraphs(t) for i, t in texts.items()}
    got = {x.doc_id: x for x in substring_dedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    lost, n, seen = 0, 0, {}
    for i, t in texts.items():
        may = [p for p, x in enumerate(pars[i]) if any(_alike(x, y) for j in range(i) for y in pars[j] if x & y)]
        may_words = {q for p in may for q in range(p, p + 50)}
        removed = {q for a, b in (got[i].removed if i in got else []) for q in range(a, b)}
        assert removed <= may_words
        lost, n = lost + len(may_words - removed), n + len(may_words)
        w = t.split()
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            assert key not in seen or seen[key] == i or set(range(p, p + 50)) <= removed
            seen.setdefault(key, i)
    assert n > 2000 and lost < 0.05 * n


def test_repeated_ids_keep_their_links(spark):
    r = random.Random(11)
    a, b, c = (words(r, 120, 10**6).split() for _ in range(3))
    near = b[:]
    near[3] = "x"
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(c)), (3, " ".join(near)), (5, " ".join(c)), (7, words(r, 100, 10**6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in ngram_join.similarity_classes(docs).collect()} == {(1, 1), (3, 1), (5, 1), (7, 7)}
    got = {(x.doc_id, x.component_id) for x in substring_dedup.repeats(docs).collect()}
    assert got == {(1, 1), (3, 1), (5, 1)}
    out = {(x.doc_id, x.text) for x in substring_dedup.remove(docs).collect()}
    assert {t for i, t in out if i == 1} == {t for i, t in rows if i == 1} and not any(i == 5 for i, _ in out) and (7, rows[5][1]) in out


def _brute(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {i: x if v == y else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in texts}


@pytest.mark.parametrize("hot,residual", [(20, 64), (1, 0)])
def test_jaccard_classes_against_brute_force(spark, monkeypatch, hot, residual):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "RESIDUAL", residual)
    r, texts = random.Random(3), {}
    for _ in range(12):
        base = words(r, r.randrange(1, 120), 60).split()
        for _ in range(r.randrange(1, 12)):
            w = base[:]
            for _ in range(r.randrange(0, 1 + len(w) // 20)):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            texts[len(texts)] = " ".join(w)
    texts |= {len(texts): "", len(texts) + 1: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similarity_classes(df).collect()}
    assert got == _brute(texts)


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(4)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 1 << 63, r.integers(0, 900)).astype(np.uint64)) for _ in range(2))
        both = np.unique(r.integers(0, 1 << 63, r.integers(0, 900)).astype(np.uint64))
        x, y = np.union1d(x, both), np.union1d(y, both)
        a, b = (np.unpackbits(np.frombuffer(ngram_join.parity(s), np.uint8)) for s in (x, y))
        assert len(a) == 64 * ngram_join.PARITY and (a != b).sum() <= len(np.setxor1d(x, y))


def test_jaccard_edges(spark, odd, empty):
    rows = ngram_join.similarity_classes(odd).collect()
    assert len(rows) == odd.count()
    label = {r.doc_id: r.component_id for r in rows}
    assert label[1] == label[2] == 0 and label[9] == 8 and label[3] == 3 and label[4] == 4 and label[None] is None
    kept = ngram_join.stage(spark, odd, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 8, 10, 11] and None in ids
    assert ngram_join.stage(spark, empty, "").count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ------------------------------------------------------------------- 8 urls


def test_url_rules(spark):
    rows = [(0, "http://A.Example.org/es/1?x"), (1, "http://x.org"), (2, "https://b.com/de/#t"), (3, None), (4, "no scheme"), (5, "http://example.org/en/12"), (6, "http://notexample.org/es/"), (7, "http://free-casino.example.net/xxx/porn"), (8, "https://docs.library.example.net/guide/intro")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(7)] == [("a.example.org", "/es/1", "example.org/es/"), ("x.org", "", None), ("b.com", "/de/", "com/de/"), ("", "", None), ("", "", None), ("example.org", "/en/12", "example.org/en/1"), ("notexample.org", "/es/", "org/")]
    assert (got[7].verdict, got[8].verdict, got[0].verdict, got[6].verdict) == ("block", "allow", "block", "allow")


def test_url_parts_are_those_of_training(spark):
    urls = ["http://A.Ä.org/X?y", "HTTPS://x?y/z#t", "a://b#c", "no scheme", "http:///p", "x://h/" + "é" * 5000, ""]
    rows = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    assert [f"{got[i].host} {got[i].path}" for i in range(len(urls))] == [url_filter._split(u) for u in urls]
    twice = url_filter.judge(rows.union(rows)).collect()
    assert len(twice) == 2 * len(urls) and {(r.page_id, r.score) for r in twice} == {(r.page_id, r.score) for r in got.values()}
    assert url_filter.judge(rows.limit(0)).count() == 0


# ------------------------------------------------------------------- 9 warc


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "http://c/", "x"), (4, "u", ""), (5, "u\r\nEvil: 1", "<p>WARC/1.1\r\n\r\n" * 50), (None, "n", "x")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), compress)
    got = {r.page_id: r for r in warc.salvage(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 6 and all(r.kind == "record" for r in got.values())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5)] == [("revisit", 3), ("revisit", 4), ("response", None), ("response", None), ("response", None)]
    assert got[1].payload_bytes == 1 and got[1].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"), compress)
    assert warc.salvage(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    sep = warc._EMPTY_MEMBER if compress else b"\r\n\r\n"
    parts = [warc.record(i, "u", f"page {i} " * 30, len(f"page {i} " * 30), warc.digest((f"page {i} " * 30).encode()), None, compress) + sep for i in range(6)]
    bad = bytearray(b"".join(parts))
    cut = len(parts[0]) + len(parts[1]) // 2
    bad[cut : cut + 4] = b"\xff" * 4
    bad = bytes(bad[: -len(parts[5]) // 2])
    found = list(warc.salvage_bytes(bad))
    ids = [f[1]["warc-record-id"] for f in found if f[0] == "record"]
    gaps = [f for f in found if f[0] == "gap"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)] and len(gaps) == 2 and gaps[1][4] == len(bad)
    assert gaps[0][3] == len(parts[0]) and gaps[0][4] >= len(parts[0]) + len(parts[1]) - len(sep)


# ----------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, odd, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == before
    assert docs.count() >= 0
    assert corpus_pipeline.run(spark, DIR).count() > 0


# --------------------------------------------- damage, long texts, plain tokens


@pytest.mark.parametrize("compress", [True, False])
def test_every_damaged_byte_is_a_gap_or_a_record(compress):
    parts = []
    for i, refers in ((1, None), (2, 1), (3, None)):
        parts.append(warc.record(i, "http://u/", f"page {i}", 6, warc.digest(b"page 1" if refers else f"page {i}".encode()), refers, compress) + (warc._EMPTY_MEMBER if compress else b"\r\n\r\n"))
    data = b"".join(parts)
    for at, value in itertools.product(range(len(data)), (0x00, 0x39, 0xFF)):
        bad = bytearray(data)
        bad[at] = value
        found = list(warc.salvage_bytes(bytes(bad)))
        assert all(k in ("record", "gap") for k, *_ in found)
        for k, head, *_ in found:
            assert k == "gap" or (head["_page"] is None or -(1 << 63) <= head["_page"] < 1 << 63) and head["_full"] >= 0
        lost = sum(len(p) for p in parts[: next(i for i in range(3) if at < sum(map(len, parts[: i + 1])))])
        assert sum(k == "record" for k, *_ in found) >= 2 - (lost < 0)


def test_forged_revisits_are_logged(spark, tmp_path):
    path = tmp_path / "w"
    path.mkdir()
    good = warc.record(1, "u", "x", 1, warc.digest(b"x"), None, False)
    same = warc.record(2, "u", "x", 1, warc.digest(b"x"), 1, False)
    forged = warc.record(3, "u", "y", 1, warc.digest(b"y"), 1, False)
    huge = good.replace(b"urn:page:1", b"urn:page:" + b"9" * 20)
    (path / "part-0").write_bytes(b"\r\n\r\n".join([good, same, forged, huge, b""]))
    got = {r.page_id: r.refers_to for r in warc.restore(spark, str(path)).collect()}
    assert got == {1: None, 2: 1}
    assert sorted(r.kind for r in spark.read.parquet(f"{path}-gaps").collect()) == ["gap", "orphan"]


def test_long_mixed_text_in_stretches():
    import tracemalloc

    r = np.random.default_rng(2)
    text = "".join(map(chr, r.integers(0x4E00, 0x9FA5, 300_000))) + " the cat and the dog " * 35_000
    tracemalloc.start()
    got, has = language._bundles([text], language.Vectors(64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert has.all() and np.isfinite(got).all() and peak < 300e6
    parts = ["a b c", "", "12", "xyz" * 10]
    whole = language._bundles(parts, language.Vectors(64))[0]
    assert all(np.allclose(whole[i], language._bundles([t], language.Vectors(64))[0][0]) for i, t in enumerate(parts))


def test_ids_are_the_plain_call(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "", "x" * 3000, "don't", "<|endoftext|>", "ünï «q» 12", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write(docs, str(tmp_path / "p"), path)
    start = 0
    for row in tokens.read_back(spark, str(tmp_path / "p")).orderBy("doc_id").collect():
        ids = [*plain.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_small_groups_settle_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passage, rows = [f"w{i}" for i in range(90)], []
    for d in range(40):
        text = list(passage)
        for at in rng.integers(0, 90, d % 4):
            text[at] = f"x{d}"
        rows.append((d, " ".join([f"a{d}-{i}" for i in range(20)] + text + [f"b{d}-{i}" for i in range(20)])))
    docs = substring_dedup._texts(spark.createDataFrame(rows, "doc_id long, text string"))
    levels, seen = substring_dedup._levels, []

    def counted(*args):
        for table in levels(*args):
            seen.append(table)
            yield table

    monkeypatch.setattr(substring_dedup, "_levels", counted)
    one = sorted(map(tuple, substring_dedup.matches(docs)[0].collect()))
    assert len(seen) == 1 and len(one) > 30


def test_among_keeps_what_a_join_takes_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 7 - 3 AS int) AS v", "'x' AS text")
    wanted = rows.where("doc_id % 50 = 0").select("doc_id", "v")
    got = {r.doc_id for r in common.among(rows, ["doc_id", "v"], wanted).collect()}
    assert got >= set(range(0, 20_000, 50))
    assert len(got) < 3000
    assert common.among(rows, ["doc_id", "v"], wanted.limit(0)).count() == 0


def test_ngram_join_moves_only_texts_that_it_compares(spark, tmp_path, monkeypatch):
    moved = []
    real = ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, texts, *a: moved.append((pairs.count(), texts.count())) or real(pairs, texts, *a))
    # Texts of shared prefixes that are too unlike to be pairs, and two that link.
    texts = [" ".join([f"s{i // 15}x{j}" for j in range(12)] + [f"w{i}x{j}" for j in range(60)]) for i in range(200)] + [" ".join(f"q{j}" for j in range(60)), " ".join(f"q{j}" for j in range(61))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_classes(docs).collect()}
    assert got == {i: min(i, 200) for i in range(202)}
    assert all(t <= 2 * p + 20 for p, t in moved)


def test_matches_of_settled_groups_are_told_once_a_run():
    n = 60
    found = [(i, j, [[0, 3]], [[0, 3]]) for i in range(n) for j in range(i)]
    hits, links = substring_dedup._said(found, *(list(range(n)), [7] * n, list(range(n)), list(range(n)), list(range(n))))
    assert len(hits) == n and len(links) == n - 1
    assert [hits[i, 0, 3] for i in (0, 5, n - 1)] == [(7, 0, 1, n - 1), (7, 5, 0, n - 1), (7, n - 1, 0, n - 2)]


def test_files_of_token_ids_stay_as_they_are():
    ids = np.array([i * i % 997 for i in range(30_000)], np.int64)
    lanes, data = tokens.encode_ids(ids, 1000)
    assert (lanes, len(data), zlib.crc32(data)) == (235, 2868, 1415911204)
    assert (tokens.decode_ids(data, len(ids), lanes, 1000) == ids).all()


def test_pieces_that_were_met_are_found_without_sorting(monkeypatch):
    import public_tokenizers

    pieces = tokens.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = [words(r, 300, 50) for _ in range(20)]
    first = pieces.batch(pa.array(texts))
    sorted_, real = [], np.unique
    monkeypatch.setattr(tokens.np, "unique", lambda x, **k: sorted_.append(len(x)) or real(x, **k))
    again = pieces.batch(pa.array([*texts, "unheard of"]))
    assert sum(sorted_) < 10
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(first, again, strict=False))
    assert all(x.tolist() == pieces.whole(t).tolist() for x, t in zip(again, [*texts, "unheard of"], strict=True))
    pieces.clear()
    assert all((a == b).all() for a, b in zip(again, pieces.batch(pa.array([*texts, "unheard of"])), strict=True))


def test_pieces_take_little_memory_beside_their_ids():
    import public_tokenizers

    pieces = tokens.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"{chr(97 + i % 26)}{i:x}" for i in range(s, s + 500)) for s in range(0, 100_000, 500)]
    tracemalloc.start()
    try:
        got = pieces.batch(pa.array(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(x.tolist() == pieces.whole(t).tolist() for x, t in zip(got[::20], texts[::20], strict=True))
    assert pieces.n > 20_000 and peak < 60e6


def test_slots_of_equal_lower_bits_are_told_apart():
    import public_tokenizers

    pieces = tokens.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    # Hashes that all want one place, the last one of the table included, and enough to let it grow.
    hashes = np.concatenate([np.arange(1, 300, dtype=np.uint64) << np.uint64(40) | np.uint64(low) for low in (0, 7, (1 << 17) - 1)])
    pieces.add(hashes, ["a"] * len(hashes))
    assert pieces.find(hashes).tolist() == list(range(len(hashes)))
    more = common.mix64(np.arange(100_000, dtype=np.uint64))
    pieces.add(more, ["b"] * len(more))
    assert len(pieces.table) >= 2 * pieces.n
    assert pieces.find(np.concatenate([more, hashes])).tolist() == [*range(len(hashes), pieces.n), *range(len(hashes))]
    assert (pieces.find(common.mix64(np.arange(100_000, 101_000, dtype=np.uint64))) == -1).all()


def test_ngram_join_writes_and_shuffles_no_text_for_candidates(spark):
    docs = spark.createDataFrame([(i, 0, words(random.Random(i), 30)) for i in range(200)], "doc_id long, v int, text string")
    reps = docs.where("doc_id % 20 = 0").select("doc_id", "v")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join.candidates(docs, reps, np.zeros(0, np.uint64))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found.columns == ["doc_id", "v", "firsts"]
    assert "hashpartitioning" not in plan
    got = {r.doc_id for r in found.collect()}
    assert set(range(0, 200, 20)) <= got and len(got) < 40


def test_contexts_move_only_texts_that_classes_are_read_from(spark, monkeypatch):
    docs = spark.createDataFrame([(i, 0, words(random.Random(i), 80)) for i in range(200)], "doc_id long, v int, text string")
    classes = spark.createDataFrame([(1, 10 + i, i, 0, 2, 3, 7, 199, 1) for i in (20, 40)], "key long, cls long, lo long, v int, pos int, m int, off int, hi long, n long")
    moved, real = [], substring_dedup.among
    monkeypatch.setattr(substring_dedup, "among", lambda df, *a: moved.append(real(df, *a)) or moved[-1])
    got = {r.cls: r for r in substring_dedup.contexts(classes, docs).collect()}
    assert len(moved) == 1 and 2 <= moved[0].count() < 10
    assert {c: (r.lo, r.hi, r.n, r.off, len(r.ctx)) for c, r in got.items()} == {30: (20, 199, 1, 7, 4 * 48), 50: (40, 199, 1, 7, 4 * 48)}
