"""N-gram Jaccard join with several global orders, and the classes it links.

A document is the set of its distinct k-word shingles (fewer than k words: the
whole sequence; none: empty, linked with nothing). Two documents link when
100 * |intersection| >= percent * |union|.

1. ``sketch``: one pass gives each text's set size and a 128-bit set digest; equal
   sets are one class and need no pairs.
2. ``hot_tokens``: the prefix tokens of all documents are counted; frequent ones
   go to the end of every order. Any set of them keeps the join exact, so the set
   is cut to a size that can be broadcast.
3. ``groups``: the first order's prefixes are dealt by token; a token that only one
   class has leaves no row.
4. Each group proposes its most central member against the others (linear), the links
   are contracted to components, and only pairs of members that are still in
   different components are proposed next. All pairs are thus decided or already
   connected. Sizes, the places of the common token and parity sketches of the
   sets bound what a pair can share; none of these bounds loses a link.
5. A proposed pair must share prefix tokens under every further order: their prefixes
   are compared by 32 bits a token before any text moves. The sets of the rest are
   intersected, from texts of which only those that share a prefix token are held.

Edge cases: null text is empty; null doc_ids are counted but linked with nothing;
rows that repeat a doc_id are one document if their sets are equal, and linked
through their common id otherwise; extra columns are ignored."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, SMALL_SLICE, among, collect_shuffles, components, doc_shingles, durable, mix64, read, release, salted_by_pivot, small_arrow, text_blocks, trim

K = 5
PERCENT = 80
#: Seeds of the orders; each order sorts tokens by (frequent, mixed hash).
ORDERS = (0, 1, 2)
#: A token in more prefixes than this is frequent.
HOT = 20
#: Frequent tokens that are broadcast at most (8 bytes each).
HOT_LIMIT = 1_000_000
#: Pairs of members looked at in one join, per row of the groups; beyond that,
#: another round of pivots comes first, this many at most.
RESIDUAL = 64
PIVOT_ROUNDS = 3
#: Rounds of pivots before members meet each other.
LEAST_ROUNDS = 2
#: 64-bit words of a parity sketch.
PARITY = 8


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Two sets that link share a token among the first this many of each."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _signed(x) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _frequent(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(tokens), bool)
    return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens


def in_order(tokens: np.ndarray, seed: int, hot: np.ndarray, size: int) -> np.ndarray:
    """The first size tokens under the order of this seed, in that order. tokens:
    distinct."""
    key = mix64(tokens, seed)
    if len(hot):
        late = _frequent(tokens, hot)
        key = (key >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    first = np.argpartition(key, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
    return tokens[first[np.argsort(key[first])]]


def parity(s: np.ndarray) -> bytes:
    """Bit b: whether an odd number of the set's tokens fall on b. Sets whose
    parities differ in h bits differ in h tokens at least."""
    return np.packbits((np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)).tobytes()


def sketch(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, v, n_shingles, d1, d2, parity): the size, a digest and the parity
    sketch of each document's set; v tells texts of one doc_id apart."""

    def run(batches):
        for batch in batches:
            n, d1, d2, odd = [], [], [], []
            for w in text_blocks(batch.column(2), NON_SPACE, SMALL_SLICE):
                g = w.grams(k)
                for d in range(len(w.at) - 1):
                    s = doc_shingles(w, k, g, d)
                    n.append(len(s))
                    d1.append(np.sum(s, dtype=np.uint64))
                    d2.append(np.bitwise_xor.reduce(mix64(s, 7)) if len(s) else np.uint64(0))
                    odd.append(np.frombuffer(parity(s), np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(_signed(np.array(d1, np.uint64))), pa.array(_signed(np.array(d2, np.uint64))), pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "v", "n_shingles", "d1", "d2", "parity"])
        trim()

    small_arrow(docs.sparkSession)
    return docs.select("doc_id", "v", "text").mapInArrow(run, "doc_id long, v int, n_shingles long, d1 long, d2 long, parity array<long>")


def _prefixes(docs: DataFrame, k: int, percent: int, hot, tokens_only: bool) -> DataFrame:
    """Prefix tokens under the first order; a class that a task has met before
    gives no further rows. tokens_only: (token); else (token, cls, n, pos, own), pos
    being the place of the token in the order, own the document's tokens that are not
    frequent."""
    hot_sent = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["token"] if tokens_only else ["token", "cls", "n", "pos", "own"]

    def run(batches):
        late, met = hot_sent.value, set()
        for batch in batches:
            for w in text_blocks(batch.column(0), NON_SPACE, SMALL_SLICE):
                g, out = w.grams(k), []
                for d in range(len(w.at) - 1):
                    s = doc_shingles(w, k, g, d)
                    if not len(s) or (c := int(np.sum(s, dtype=np.uint64))) in met:
                        continue
                    met.add(c)
                    out.append((in_order(s, ORDERS[0], late, prefix_length(len(s), percent)), c, len(s), len(s) - _frequent(s, late).sum()))
                if not out:
                    continue
                sizes = [len(x[0]) for x in out]
                columns = [_signed(np.concatenate([x[0] for x in out]))]
                if not tokens_only:
                    columns += [np.repeat(_signed(np.array([x[1] for x in out], np.uint64)), sizes), np.repeat(np.array([x[2] for x in out], np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]), np.repeat(np.array([x[3] for x in out], np.int32), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        trim()

    return docs.select("text").mapInArrow(run, "token long" if tokens_only else "token long, cls long, n int, pos int, own int")


def hot_tokens(docs: DataFrame, k: int = K, percent: int = PERCENT) -> np.ndarray:
    """The most frequent prefix tokens, HOT_LIMIT at most, sorted."""
    counted = _prefixes(docs, k, percent, np.zeros(0, np.uint64), True).groupBy("token").count().where(F.col("count") > HOT)
    table = counted = durable(counted)
    if counted.count() > HOT_LIMIT:
        counted = counted.orderBy(F.desc("count"), "token").limit(HOT_LIMIT)
    out = np.sort(np.array([r.token for r in counted.select("token").toLocalIterator()], np.int64).view(np.uint64))
    release(table)
    return out


def groups(docs: DataFrame, hot: np.ndarray, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(token, cls, n, pos, own): prefix tokens that two classes or more have, one row a
    class. Dealt by token once; runs are found while streaming, never gathered."""
    dealt = _prefixes(docs, k, percent, hot, False).repartition("token").sortWithinPartitions("token", "cls")
    names = ["token", "cls", "n", "pos", "own"]
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)

    def shared(batches):
        held = None  # the last row of the batch before, if its token may go on
        held_shared = False
        for batch in batches:
            if not batch.num_rows:
                continue
            t, c = (batch.column(i).to_numpy() for i in (0, 1))
            rows = [batch.column(i).to_numpy() for i in range(len(names))]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            if held is not None:
                new[0] = held[0] != t[0] or held[1] != c[0]
            rows = [x[new] for x in rows]
            if held is not None:
                rows = [np.concatenate([[h], x]) for h, x in zip(held, rows, strict=True)]
            t = rows[0]
            same = np.zeros(len(t) + 1, bool)
            same[1:-1] = t[1:] == t[:-1]
            same[0] = held is not None and held_shared
            keep = same[:-1] | same[1:]
            held, held_shared = [x[-1] for x in rows], bool(keep[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(ty)) for x, ty in zip(rows, kinds, strict=True)], names)
        if held is not None and held_shared:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([h], ty)) for h, ty in zip(held, kinds, strict=True)], names)

    return dealt.mapInArrow(shared, "token long, cls long, n int, pos int, own int")


def candidates(docs: DataFrame, reps: DataFrame, hot: np.ndarray, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, v, firsts) of the texts that stand for a class in some group, and of a
    few others: firsts holds the prefixes under every further order, 32 bits a token,
    sorted. No text moves and none is written."""
    hot_sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        late = hot_sent.value
        for batch in batches:
            out = []
            for w in text_blocks(batch.column(2), NON_SPACE, SMALL_SLICE):
                g = w.grams(k)
                for d in range(len(w.at) - 1):
                    s = doc_shingles(w, k, g, d)
                    n = prefix_length(len(s), percent)
                    out.append(b"".join(np.sort(in_order(s, o, late, n).astype("<u4")).tobytes() for o in ORDERS[1:]) if n else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "v", "firsts"])
        trim()

    small_arrow(docs.sparkSession)
    return among(docs, ["doc_id", "v"], reps).select("doc_id", "v", "text").mapInArrow(run, "doc_id long, v int, firsts binary")


def share_prefixes(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs that share prefix tokens under every further order. Equal tokens have
    equal 32 bits, so no pair that does is lost; the few bytes of the prefixes move,
    texts do not."""
    schema = pairs.schema
    side = lambda s, v, f: firsts.select(F.col("doc_id").alias(s), F.col("v").alias(v), F.col("firsts").alias(f))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                x, y = (np.frombuffer(z, "<u4").reshape(len(ORDERS) - 1, -1) for z in (x, y))
                keep.append(all(np.isin(a, b).any() for a, b in zip(x, y, strict=True)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], schema=pa.schema(list(batch.schema)[:-2])).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("member", "mv", "_y"), ["member", "mv"]).join(side("pivot", "pv", "_x"), ["pivot", "pv"]).select(*pairs.columns, "_x", "_y").mapInArrow(run, schema)


def verify(pairs: DataFrame, texts: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(u, v, cu, cv) of the pairs (pivot, pv, member, mv, cu, cv) that link."""

    def run(batches):
        pivot, own, size = None, None, 0
        for batch in batches:
            p, pv, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            is_pivot = m.is_null().to_numpy(zero_copy_only=False)
            m = m.fill_null(-1).to_numpy()
            at = []
            for w in text_blocks(batch.column(3), NON_SPACE, SMALL_SLICE):
                g = w.grams(k)
                for d in range(len(w.at) - 1):
                    i = w.first + d
                    s = doc_shingles(w, k, g, d)
                    if is_pivot[i]:
                        pivot, own, size = (p[i], pv[i]), s, len(s)
                        continue
                    if pivot != (p[i], pv[i]) or 100 * min(size, len(s)) < percent * max(size, len(s)) or not len(s):
                        continue
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (size + len(s) - both):
                        at.append(i)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in (0, 2, 4, 5)], ["u", "v", "cu", "cv"])
        trim()

    return salted_by_pivot(pairs, texts).select("pivot", "pv", "member", "text", "cu", "cv").mapInArrow(run, "u long, v long, cu long, cv long")


def _fitting(a: str, i: str, b: str, j: str, percent: int):
    """Whether sets of sizes a and b whose first common token has places i and j
    can link. Other common tokens give a bound too low, but the first one does not,
    and it is in both prefixes: no link is lost."""
    bound = F.least(F.col(a) - F.col(i), F.col(b) - F.col(j))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * bound >= percent * (F.col(a) + F.col(b)))


def _close(a: str, x: str, b: str, y: str, percent: int):
    """Whether sets of sizes a and b with parities x and y can link: the bits that
    differ are a lower bound of the tokens that only one set has. No parity (a
    doc_id of several texts): they can."""
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITY)), F.lit(0))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(a) + F.col(b)), F.lit(True))


def _mixed(labelled: DataFrame) -> int:
    """Pairs of members of a group that are in different components."""
    sizes = labelled.groupBy("token", "comp").count().groupBy("token").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    return int(sizes.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def _members_meet(labelled: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a group that are in different components and can link."""
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    held = labelled.join(mixed, "token").join(parities, ["rep", "v"]).select("token", "rep", "v", "n", "pos", "comp", "parity")
    a, b = (held.select("token", F.col("rep").alias(who), F.col("v").alias(v), F.col("n").alias(f"n{i}"), F.col("pos").alias(f"i{i}"), F.col("comp").alias(c), F.col("parity").alias(f"x{i}")) for i, who, v, c in ((1, "pivot", "pv", "cu"), (2, "member", "mv", "cv")))
    return a.join(b, "token").where((F.struct("pivot", "pv") < F.struct("member", "mv")) & (F.col("cu") != F.col("cv")) & _fitting("n1", "i1", "n2", "i2", percent) & _close("n1", "x1", "n2", "x2", percent))


_PAIR = ["pivot", "pv", "member", "mv"]


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("pivot", "pv").union(pairs.select("member", "mv"))


def links(docs: DataFrame, sketched: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(u, v) between documents that stand for their classes, enough of them that
    their components are those of all links. docs: doc_id, v, text; sketched: durable
    sketch()."""
    docs = docs.where("doc_id is not null and text is not null")
    hot = hot_tokens(docs, k, percent)
    classes = sketched.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "v", "parity")).alias("least"))
    classes = durable(classes.select("d1", "d2", "n_shingles", F.col("least.doc_id").alias("rep"), F.col("least.v").alias("v"), F.col("least.parity").alias("parity")))
    parities = classes.select("rep", "v", "parity")
    # A class stands in its groups by any member; from here on by its smallest.
    shared = durable(groups(docs, hot, k, percent))
    collect_shuffles(docs.sparkSession)
    members = shared.select("token", F.col("cls").alias("d1"), F.col("n").cast("long").alias("n_shingles"), "pos", "own")
    rows = durable(members.join(classes.select("d1", "n_shingles", "rep", "v"), ["d1", "n_shingles"]).select("token", "rep", "v", F.col("n_shingles").alias("n"), "pos", (1000 * F.col("own") / F.col("n_shingles")).cast("int").alias("apart")).distinct())
    size = rows.count()
    release(shared)
    reps = durable(rows.select(F.col("rep").alias("doc_id"), "v").distinct())
    firsts = durable(candidates(docs, reps, hot, k, percent))
    release(reps)
    found, done = [], []
    labelled = rows.withColumn("comp", F.col("rep"))
    for k_round in itertools.count():
        mixed = _mixed(labelled) if k_round else size
        if not mixed:
            break
        last = k_round >= LEAST_ROUNDS and mixed <= max(RESIDUAL * size, 100_000) or k_round == PIVOT_ROUNDS
        heads = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("apart", "rep", "v", "n", "pos", "comp")).alias("first")).where("lo < hi")
        heads = heads.select("token", *[F.col(f"first.{c}").alias(x) for c, x in (("rep", "pivot"), ("v", "pv"), ("n", "n1"), ("pos", "i1"), ("comp", "cu"))])
        if last:
            pairs = _members_meet(labelled, parities, percent)
        else:
            met = labelled.select("token", F.col("rep").alias("member"), F.col("v").alias("mv"), "n", "pos", F.col("comp").alias("cv"))
            pairs = met.join(heads, "token").where((F.col("cv") != F.col("cu")) & _fitting("n1", "i1", "n", "pos", percent))
        pairs = pairs.groupBy(*_PAIR).agg(F.first("cu").alias("cu"), F.first("cv").alias("cv"))
        for old in done:
            pairs = pairs.join(old.select(*_PAIR), _PAIR, "left_anti")
        pairs = durable(pairs)
        kept = durable(share_prefixes(pairs, among(firsts, ["doc_id", "v"], _ends(pairs))))
        new = durable(verify(kept, among(docs, ["doc_id", "v"], _ends(kept)), k, percent))
        release(kept)
        found.append(new)
        done.append(pairs)
        if last:
            break
        # The pivots have met all others of their groups. Only new links are contracted.
        moved = components(new.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        rest = labelled.join(heads.select("token", "pivot", "pv"), "token").where("rep <> pivot or v <> pv").drop("pivot", "pv")
        before, labelled = labelled, durable(rest.join(moved.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component"))
        if k_round:
            release(before)
    out = durable(functools.reduce(DataFrame.union, found).select("u", "v")) if found else docs.sparkSession.createDataFrame([], "u long, v long")
    release(classes, rows, labelled, firsts, *found, *done)
    return out


def similarity_classes(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("v"), "text")
    sketched = durable(sketch(docs, k))
    classes = sketched.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    linked = links(docs, sketched, k, percent)
    comps = components(linked)
    labels = durable(classes.join(comps, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("label")))
    joined = sketched.select("doc_id", "n_shingles", "d1", "d2").join(labels, ["d1", "d2", "n_shingles"], "left")
    # Rows that repeat a doc_id with other texts tie their classes together.
    known = joined.where("doc_id is not null and label is not null").select("doc_id", "label")
    torn = known.groupBy("doc_id").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    ties = durable(known.join(torn, "doc_id").where("label <> least").select(F.col("label").alias("u"), F.col("least").alias("v")).distinct())
    if ties.take(1):
        joined = joined.join(components(ties), F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("component", "label")).drop("node", "component")
    out = durable(joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")))
    release(sketched, linked, labels, ties)
    return out


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class its smallest doc_id stays, and every row that
    has no doc_id; of rows with one doc_id the first by their columns stays."""
    found = similarity_classes(docs.select("doc_id", "text"))
    going = durable(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(going, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not again.take(1):
        return kept
    repeated = kept.join(again.select("doc_id"), "doc_id", "left_semi")
    first = repeated.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("_row"))
    return kept.join(again.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).union(first.select(*[F.col("doc_id") if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns]))


_W = r"[^\x20\x09-\x0D]+"
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reach = e.u)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
