"""Structured and noisy documents, derived from flat ones by one expression that
Spark and DuckDB evaluate alike."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, ordered_join
from ..operators import prompts

STRUCTURED = """case when i = 0 then '# ' || left(s, 60)
  when i % 11 = 5 then '## ' || left(s, 50)
  when i % 11 in (7, 8) then cast(cast((i - i % 11) / 11 * 2 + i % 11 - 6 as int) as string) || '. ' || s
  when i % 11 = 9 then '- ' || s
  when i % 11 in (3, 10) then chr(10) || s
  else s end"""

NOISY = """case when doc_id % 10 = 0 and i % 3 > 0 then '| ' || left(s, 20) || ' | x |'
  when doc_id % 10 = 1 then s || ' ' || chr(92) || 'frac{a}{b} $x$ ∑∂'
  when doc_id % 10 = 2 and i % 2 = 0 then s || ' Привет мир, это не латиница'
  when doc_id % 10 = 3 then 'Marx, K. (1997). ' || left(s, 30) || ' University Press, pp. 12'
  when doc_id % 10 = 4 then s || chr(10) || chr(10) || s
  when doc_id % 10 = 5 and i % 2 = 1 then chr(10) || 'The author argues ' || s || chr(10)
  when doc_id % 10 = 6 then '## ' || left(s, 20) || chr(10) || '## ' || left(s, 20) || chr(10) || s
  else s end"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _derived(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    rows = lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "i", F.expr(expression).alias("s"))
    return rows.groupBy("doc_id").agg(ordered_join("i", "s", "\n").alias("text"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, STRUCTURED)


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, NOISY)


def _cte(name: str, expression: str) -> str:
    return f"""{name} AS (SELECT doc_id, string_agg({expression}, chr(10) ORDER BY i) AS text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id)"""


#: DuckDB table expressions.
STRUCTURED_SQL = _cte("structured", STRUCTURED)
NOISY_SQL = _cte("noisy", NOISY)


class RuleProvider:
    """A model by rule, for queries and tests: its answers follow from the request."""

    def generate(self, prompt: str, system: str = "", temperature: float = 0.3, max_tokens: int = 8192) -> str:
        task, _, text = prompt.partition("TEXT:\n")
        rows = [x.partition(": ") for x in text.split("\n")]
        rows = [(int(i), s) for i, c, s in rows if c and i.isdigit()]
        if task.startswith(prompts.FRONT):
            first = text.split("\n")[1]
            n = text.count("=== PAGE ")
            return "Here it is:\n```json\n" + json.dumps({"title": first[:20], "authors": ["ANN LEE", "Bo Ek"], "has_toc": "ontents" in text, "body_starts_at_page": n if len(first) % 2 else 1}) + "\n```"
        if task.startswith(prompts.BACK):
            n = text.count("=== PAGE ")
            return json.dumps({"has_references": n % 2 == 0, "back_matter_starts_at_page": n})
        if task.startswith(prompts.SECTIONS):
            return "The headings: " + json.dumps([s[:12] for i, s in rows if i % 2 == 0] + ["an invented one"])
        if task.startswith(prompts.CORRECT):
            return json.dumps([{"index": k, "from": "BODY", "to": "appendix"} for k, (_, s) in enumerate(rows) if k % 4 == 3] + [{"index": 10**6, "to": "BODY"}])
        if task.startswith(prompts.CLASSIFY):
            labels = task.partition("Labels: ")[2].split("\n")[0].split(", ")
            return json.dumps([labels[len(s) % 2] for _, s in rows])
        if task.startswith((prompts.GLOSSARY, prompts.FOOTNOTES)):
            return json.dumps({text.split(" ")[0]: f"{len(text)} characters"}) if len(text) % 2 else "nothing"
        if task.startswith(prompts.SUMMARY):
            return f"  {len(text)} characters  " if len(text) % 2 else ""
        if task.startswith(prompts.CONCEPTS):
            return "Sure!\n```mermaid\nflowchart TD\n" + "a --> b\n" * (len(text) % 12) + "```"
        if task.startswith(prompts.VERIFY):
            first = task.partition("FIRST:\n")[2].strip()
            return "No issues." if first == text.strip() else "DROPPED: all"
        return text


class FailingProvider:
    """A model that never answers."""

    def generate(self, prompt: str, system: str = "", temperature: float = 0.3, max_tokens: int = 8192) -> str:
        raise RuntimeError("no answer")
