"""Quality rules: one table of thresholds compiled into one Spark projection.

No user function runs: words, lines, symbols, stop words and repeated windows are
counted with built-in expressions inside the scan's stage, without a shuffle.

Edge cases: a null or empty text has no words, all counts 0, and fails. Repeated
rows are judged one by one. Columns of the input other than the text are kept and
may have any name. Repeated 3-word windows are found by 64-bit hashes within one
text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages, as they stand in lower case.
STOP_WORDS = "the of and to in that for is it with as on was be by are a de la le les et des un une que du en est el los se der die und den das nicht ein eine zu von mit".split()
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """value, a SQL expression over the counts, must lie in [low, high]."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Counts: those of ``counts()``.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.2),
    Rule("stop_words", "n_stop_kinds", 2, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.35),
)


def counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words and n_stop_kinds, each name behind prefix."""
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines, grams, ordered = (f"_{p}q_{x}" for x in ("words", "lines", "grams", "ordered"))
    keep = list(docs.columns)
    df = docs.select(
        *keep,
        F.array_remove(F.split(t, SPACE), "").alias(words),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias(f"{p}n_symbols"),
    )
    head = [*keep, f"{p}n_symbols"]
    df = df.select(
        *head,
        F.size(words).cast("long").alias(f"{p}n_words"),
        F.size(lines).cast("long").alias(f"{p}n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias(f"{p}n_stop_kinds"),
        F.length(F.array_join(words, "")).cast("long").alias(f"{p}word_chars"),
        F.expr(f"if(size({words}) < 3, array(), transform(slice({words}, 1, size({words}) - 2), (x, i) -> xxhash64(x, {words}[i + 1], {words}[i + 2])))").alias(grams),
    )
    head += [f"{p}{x}" for x in ("n_words", "n_lines", "n_dup_lines", "n_stop_kinds", "word_chars")]
    # Only a text with a repeated window pays for the ordering of its windows.
    df = df.select(*head, F.expr(f"if(size(array_distinct({grams})) = size({grams}), array(), sort_array(transform({grams}, (h, i) -> struct(h, i))))").alias(ordered))
    df = df.select(*head, F.expr(f"sort_array(transform(filter({ordered}, (x, k) -> x.h <=> get({ordered}, k - 1).h or x.h <=> get({ordered}, k + 1).h), x -> x.i))").alias(ordered))
    return df.select(*head, F.expr(f"aggregate(transform({ordered}, (x, k) -> least(3, coalesce(get({ordered}, k + 1) - x, 3))), 0L, (a, x) -> a + x)").alias(f"{p}n_repeat_words"))


def compile_rules(rules=RULES, prefix: str = "") -> Column:
    """The table as one boolean column; a ratio without a base passes."""
    import re

    out = F.lit(True)
    for r in rules:
        v = F.expr(re.sub(r"(\w+) / (\w+)", lambda m: f"try_divide({prefix}{m[1]}, {prefix}{m[2]})", r.value) if "/" in r.value else prefix + r.value)
        if r.low is not None:
            out &= F.coalesce(v >= r.low, F.lit(True))
        if r.high is not None:
            out &= F.coalesce(v <= r.high, F.lit(True))
    return out


def judge(docs: DataFrame, text: str = "text", rules=RULES, prefix: str = "") -> DataFrame:
    """docs with the counts, base_failed and kept; columns of these names are replaced,
    a prefix keeps those of docs."""
    p = prefix
    df = counts(docs, text, p)
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))
    return df.withColumns({f"{p}base_failed": failed, f"{p}kept": ~failed & compile_rules(rules, p)})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    judged = judge(docs, prefix="_quality_")
    # A verdict that is not deterministic to the optimiser stays above the counts:
    # pushed below them, it would repeat their expressions for every word.
    verdict = F.col("_quality_kept") & (F.monotonically_increasing_id() >= 0)
    return judged.select(*docs.columns, verdict.alias("_quality_kept")).where("_quality_kept").select(*docs.columns)


_W = r"[^\x20\x09-\x0D]+"
OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
), g AS (
  SELECT doc_id, t, w, len(w) AS n,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
  FROM d
), u AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM u) WHERE c > 1),
s AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), l AS (SELECT doc_id, n, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM g),
m AS (
  SELECT l.doc_id, n AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    cast(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(list_distinct(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], x)))) AS n_stop_kinds
  FROM l LEFT JOIN s ON l.doc_id = s.doc_id
)
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols,
  cast(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_stop_kinds >= 2
    AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0 AND n_symbols / n_words <= 0.2
    AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.35) AS kept
FROM m
"""
