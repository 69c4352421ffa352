"""Model-backed operators: placeholders, prompts, parsers, and rewriting with
resume. A provider is any object with ``generate(prompt, system, temperature,
max_tokens) -> str``; ``provider_factory`` builds it once a partition."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, strip, word_count
from .profile import passthrough
from .quality_checks import inline_issues

SECTION_TYPES = ("BODY", "REFERENCES", "FOOTNOTES", "APPENDIX", "FRONT_MATTER", "VERBATIM")
MIN_RATIO, MAX_RATIO, MAX_RETRIES = 0.85, 1.5, 2


class Provider(Protocol):
    def generate(self, prompt: str, system: str = "", temperature: float = 0.3, max_tokens: int = 8192) -> str: ...


class EchoProvider:
    """A stand-in without a model: it returns the text behind the prompt's last
    marker. Its output says nothing of a model's quality."""

    def generate(self, prompt: str, system: str = "", temperature: float = 0.3, max_tokens: int = 8192) -> str:
        return prompt.rpartition("TEXT:\n")[2]


class RetryingProvider:
    """Retries calls that fail, waiting longer each time; a wait that is too long
    is an exhausted quota."""

    def __init__(self, inner: Provider, retries: int = 5, wait_s: float = 5.0, quota_s: float = 60.0, sleep: Callable[[float], None] | None = None):
        import time

        self.inner, self.retries, self.wait_s, self.quota_s, self.sleep = inner, retries, wait_s, quota_s, sleep or time.sleep

    def generate(self, prompt: str, system: str = "", temperature: float = 0.3, max_tokens: int = 8192) -> str:
        for k in range(self.retries + 1):
            try:
                return self.inner.generate(prompt, system, temperature, max_tokens)
            except Exception:
                if k == self.retries or self.wait_s * (k + 1) > self.quota_s:
                    raise
                self.sleep(self.wait_s * (k + 1))
        raise AssertionError


# ---------------------------------------------------------------- placeholders

_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_BLOCK, _INLINE = re.compile(r"\$\$.+?\$\$", re.DOTALL), re.compile(r"\$[^$\n]+\$")
_ROW = re.compile(r"^\s*\|.*\|\s*$")


def strip_elements(text: str) -> tuple[str, dict[str, str]]:
    """Images, tables (from the last up) and formulas replaced by numbered marks."""
    kept: dict[str, str] = {}
    count = {"IMG": 0, "TABLE": 0, "EQ": 0}

    def mark(kind: str, original: str) -> str:
        count[kind] += 1
        key = f"<<{kind}_{count[kind]}>>"
        kept[key] = original
        return key

    text = _IMAGE.sub(lambda m: mark("IMG", m[0]), text)
    out: list[str] = []
    rows: list[str] = []

    def close():
        # Above in the text but later in the numbering: lines go from the end.
        if len(rows) >= 2:
            out.append(mark("TABLE", "\n".join(reversed(rows))))
        else:
            out.extend(rows)
        rows.clear()

    for line in reversed(text.split("\n")):
        if _ROW.match(line):
            rows.append(line)
        else:
            close()
            out.append(line)
    close()
    text = "\n".join(reversed(out))
    for pattern in (_BLOCK, _INLINE):
        text = pattern.sub(lambda m: mark("EQ", m[0]), text)
    return text, kept


def strip_non_prose(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``prose`` struct<text, marks map>."""

    @F.pandas_udf("text string, marks map<string,string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([strip_elements(x or "") for x in s], columns=["text", "marks"])

    return df.withColumn("prose", run(F.col(text)))


def reinsert(text: str, marks: str) -> Column:
    # A later element may hold marks of earlier ones, so the last comes first.
    return F.aggregate(F.reverse(F.map_entries(marks)), F.col(text), lambda t, e: F.replace(t, e.key, e.value))


def clean_output(text: str, original: str) -> Column:
    """A model's answer without headings, bold lines and remarks that the original
    does not have."""
    own = F.transform(F.split(F.col(original), "\n"), strip)
    titles = F.transform(F.filter(own, lambda x: x.rlike(r"^#{1,6}\s+.+$")), lambda x: strip(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)))
    bold = F.filter(own, lambda x: x.rlike(r"^\*\*.*\*\*$"))

    def keep(line):
        s = strip(line)
        heading = s.rlike(r"^#{1,6}\s+.+$")
        label = s.rlike(r"^\*\*[^*]+\*\*$") & (F.length(s) < 120)
        return F.when(heading, F.array_contains(titles, strip(F.regexp_extract(s, r"^#{1,6}\s+(.+)$", 1)))).when(label, F.array_contains(bold, s)).otherwise(~s.rlike(r"(?i)^(simplified|here is|below is|the simplified)"))

    return F.regexp_replace(F.array_join(F.filter(F.split(F.col(text), "\n", -1), keep), "\n"), "\n{3,}", "\n\n")


# --------------------------------------------------------------------- prompts


def rewrite_prompt(text: str = "text", summary: str = "summary", glossary: str = "glossary", context: str = "context", retry: str = "is_retry") -> Column:
    """The request to rewrite a chunk: its size, its numbered points, what is known
    of the book, then the text."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(r"(?md)^(\d+)[\.\)]"), F.lit(1))
    terms = F.array_join(F.transform(F.map_entries(glossary), lambda e: F.concat(F.lit("* "), e.key, F.lit(" = "), e.value)), "\n")
    n_paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: strip(p) != ""))
    return F.concat_ws(
        "\n\n",
        F.format_string("Rewrite the passage in plain words. Keep every claim, %d paragraphs and about %d words.", n_paragraphs, word_count(text)),
        F.when(F.size(numbers) > 0, F.concat(F.lit("Keep these numbered points in order: "), F.array_join(numbers, ", "))),
        F.when(F.col(summary) != "", F.concat(F.lit("About the book: "), summary)),
        F.when(F.size(F.map_keys(glossary)) > 0, F.concat(F.lit("Terms:\n"), terms)),
        F.when(F.col(context) != "", F.concat(F.lit("What came before: "), context)),
        F.when(F.col(retry), F.lit("The last attempt had the wrong length; stay close to the original's.")),
        F.concat(F.lit("TEXT:\n"), text),
    )


def task_prompt(task: str, text: Column, head: int | None = None, tail: int | None = None) -> Column:
    """A short request about (a piece of) a text. Tasks: ``TASKS``."""
    piece = F.left(text, F.lit(head)) if head else F.right(text, F.lit(tail)) if tail else text
    return F.concat(F.lit(TASKS[task] + "\n\nTEXT:\n"), piece)


TASKS = {
    "paragraph": "Rewrite this one paragraph in plain words; do not describe it.",
    "bridge": "In two sentences, tell what this part has said so far.",
    "smooth": "Make the joints between these paragraphs read well; change nothing else.",
    "verify": "List claims that the second text drops, changes or invents. If there are none, answer: no issues.",
    "glossary": "Give the special terms of this text as a JSON object of term to meaning.",
    "summary": "Describe this book in 300 to 500 words.",
    "footnotes": "Give terms that need a note as a JSON object of term to note, {} if none.",
    "concept_map": "Draw the main ideas as a Mermaid flowchart of 8 to 15 nodes.",
    "sections": "Give the section headings among these lines as a JSON array of strings.",
    "classify": "Label each numbered piece; answer with a JSON array of labels, one a piece.",
}


# --------------------------------------------------------------------- parsers


def parse_object(response: str = "response") -> Column:
    """The JSON object in an answer as a map, empty if there is none."""
    raw = F.regexp_extract(F.regexp_replace(response, "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(F.when(raw != "", raw), "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def parse_labels(response: str, n: str, labels=SECTION_TYPES, default: str | None = None) -> Column:
    """Exactly n labels of a JSON array: unknown ones are the default, missing ones
    are added, further ones cut."""
    d = default or labels[0]
    raw = F.regexp_extract(F.regexp_replace(response, "```(?:json)?", ""), r"(?s)\[.*\]", 0)
    found = F.coalesce(F.from_json(F.when(raw != "", raw), "array<string>"), F.array().cast("array<string>"))
    clean = F.transform(found, lambda x: F.when(F.upper(strip(x)).isin(*labels), F.upper(strip(x))).otherwise(d))
    return F.slice(F.concat(clean, F.array_repeat(F.lit(d), F.col(n).cast("int"))), F.lit(1), F.col(n).cast("int"))


def parse_corrections(response: str, n: str, labels=SECTION_TYPES) -> Column:
    """Valid corrections: array<struct<index, to>>."""
    raw = F.regexp_extract(F.regexp_replace(response, "```(?:json)?", ""), r"(?s)\[.*\]", 0)
    found = F.coalesce(F.from_json(F.when(raw != "", raw), "array<struct<index:int,to:string>>"), F.array().cast("array<struct<index:int,to:string>>"))
    return F.filter(found, lambda x: (x["index"] >= 0) & (x["index"] < F.col(n)) & F.upper(x["to"]).isin(*labels))


def apply_corrections(labelled: DataFrame, corrections: DataFrame) -> DataFrame:
    """labelled: doc_id, idx, label; corrections: doc_id, idx, pos, to; the last wins."""
    last = corrections.groupBy("doc_id", "idx").agg(F.max_by("to", "pos").alias("to"))
    return labelled.join(last, ["doc_id", "idx"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def previews(chunks: DataFrame) -> DataFrame:
    """Short chunks whole, with bars for line ends; others' first 300 characters."""
    short = word_count("text") <= 100
    return chunks.withColumn("preview", F.when(short, F.replace(F.col("text"), F.lit("\n"), F.lit(" | "))).otherwise(F.left("text", F.lit(300))))


def resolve_headings(named: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, name, heading): the line equal to a name, else the first of which
    one is a prefix of the other. named: doc_id, name; lines: doc_id, i, s."""
    both = named.join(lines, "doc_id").where((F.col("s") == F.col("name")) | F.col("s").startswith(F.col("name")) | F.col("name").startswith(F.col("s"))).where("s <> ''")
    return both.groupBy("doc_id", "name").agg(F.min_by("s", F.struct((F.col("s") != F.col("name")).alias("k"), "i")).alias("heading"))


# ------------------------------------------------------------------- rewriting


def call(rows: DataFrame, provider_factory: Callable[[], Provider], prompt: str = "prompt", out: str = "response", temperature: float = 0.3) -> DataFrame:
    """rows with the provider's answer, or its error. Parallelism is that of rows."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` string, `{out}_error` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = provider_factory()
        for pdf in frames:
            answers = []
            for p in pdf[prompt]:
                try:
                    answers.append((provider.generate(p, "", temperature), None))
                except Exception as e:  # a row's failure is the row's
                    answers.append((None, str(e)))
            yield pdf.assign(**{out: [a for a, _ in answers], f"{out}_error": [e for _, e in answers]})

    return rows.mapInPandas(run, schema)


def simplify(chunks: DataFrame, provider_factory: Callable[[], Provider] = EchoProvider, done: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, simplified_text, attempts, final_ratio, was_retried,
    qa_issues, qa_passed, error) of the chunks that done does not have. Chunks that
    are not to be rewritten are passed on; of up to three attempts the one whose
    length is nearest the original's counts, and a failure keeps the original."""
    if done is not None:
        chunks = chunks.join(done.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
    section = "section_type" if "section_type" in chunks.columns else None
    marked = chunks.select("doc_id", "chunk_id", "text", passthrough("text", section).alias("pass"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = provider_factory()
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                bare, marks = strip_elements(r.text)
                best, attempts, error, words = None, 0, None, max(1, len(r.text.split()))
                for k in range(MAX_RETRIES + 1):
                    attempts += 1
                    try:
                        answer = provider.generate(f"Rewrite in plain words.{' Mind the length.' if k else ''}\n\nTEXT:\n{bare}")
                    except Exception as e:
                        error = str(e)
                        break
                    for key, original in reversed(list(marks.items())):
                        answer = answer.replace(key, original)
                    ratio = len(answer.split()) / words
                    if best is None or abs(ratio - 1) < abs(best[1] - 1):
                        best = (answer, ratio)
                    if MIN_RATIO <= ratio <= MAX_RATIO:
                        break
                text, ratio = best or (r.text, 1.0)
                out.append((r.doc_id, r.chunk_id, r.text, text, attempts, ratio, attempts > 1, error if best is None else None))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "text", "answer", "attempts", "final_ratio", "was_retried", "error"])

    asked = marked.where(~F.col("pass")).select("doc_id", "chunk_id", "text").mapInPandas(run, "doc_id long, chunk_id int, text string, answer string, attempts int, final_ratio double, was_retried boolean, error string")
    asked = asked.withColumn("simplified_text", clean_output("answer", "text")).drop("answer")
    passed = marked.where("pass").select("doc_id", "chunk_id", "text", F.lit(0).alias("attempts"), F.lit(1.0).alias("final_ratio"), F.lit(False).alias("was_retried"), F.lit(None).cast("string").alias("error"), F.col("text").alias("simplified_text"))
    both = asked.unionByName(passed).withColumn("qa_issues", inline_issues("text", "simplified_text"))
    return both.withColumn("qa_passed", F.size("qa_issues") == 0).drop("text")


def merge_results(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks with their rewritten text, or their own where there is none."""
    got = results.select("doc_id", "chunk_id", "simplified_text")
    return chunks.join(got, ["doc_id", "chunk_id"], "left").withColumn("text", F.coalesce("simplified_text", "text")).drop("simplified_text")


def verified(verdict: str = "verdict") -> Column:
    return F.lower(verdict).rlike("no issues|all preserved")


def landmarks(lines: DataFrame) -> DataFrame:
    """(doc_id, i, s, kind) of title, byline and heading lines. lines: doc_id, i, s."""
    t = strip(F.col("s"))
    kind = F.when(t.rlike(r"^#\s+"), "TITLE").when(t.rlike(r"^\*+\s*[Bb]y\s+.+\*+$"), "AUTHOR_BYLINE").when(t.rlike(r"^#{2,6}\s+"), "SECTION_HEADING")
    return lines.withColumn("kind", kind).where("kind is not null")


def fix_lines(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """(doc_id, i, s): corrected by index where the content agrees, else at the
    first line of equal content; REMOVE blanks the line. corrections: doc_id, i,
    original, fixed."""
    c = corrections.alias("c").join(lines.alias("l"), (F.col("c.doc_id") == F.col("l.doc_id")) & (F.col("c.original") == F.col("l.s")))
    at = c.groupBy("c.doc_id", "c.i", "c.original").agg(F.min_by("l.i", F.struct((F.col("l.i") != F.col("c.i")).alias("k"), "l.i")).alias("line"), F.first("c.fixed").alias("fixed"))
    fixes = at.groupBy("doc_id", "line").agg(F.max_by("fixed", "i").alias("fixed"))
    return lines.join(fixes.withColumnRenamed("line", "i"), ["doc_id", "i"], "left").select("doc_id", "i", F.when(F.col("fixed") == "REMOVE", "").otherwise(F.coalesce("fixed", "s")).alias("s"))


def label_prompt(pieces: list[str], labels=SECTION_TYPES) -> str:
    return TASKS["classify"] + "\nLabels: " + ", ".join(labels) + "\n" + json.dumps(pieces, ensure_ascii=False)


def counts_of_numbers(text: str = "text") -> Column:
    return matches(text, r"(?md)^\d+[\.\)]\s")
