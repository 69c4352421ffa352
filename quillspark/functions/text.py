"""Column helpers: whitespace, words, tokens, lines and ordered joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def strip(c) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def strip_ascii(c) -> Column:
    """Without ASCII white space at both ends, as SQL's regular expressions have it."""
    return F.regexp_replace(c, r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")


def words(c) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(words(c)).cast("long")


def token_count(c) -> Column:
    """Four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN)).cast("long")


def paragraphs(c) -> Column:
    """Trimmed, non-empty pieces between blank lines."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != "")


def sentences(c) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def lines(df: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """(keys, i, s): the lines of a text, counted from 0."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "s"))


def ordered_join(position: str, value: str, separator: str) -> Column:
    """Aggregate: the values in order of their position, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x.v), separator)


def matches(c, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")
