"""Requests to a model, as columns. Each ends with the text it is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import paragraphs, word_count

# How much of a text a request holds, in characters.
PAGE_CHARS, SEGMENT_CHARS, EDGE_CHARS, BRIDGE_CHARS, SUMMARY_CHARS, MAP_CHARS = 800, 200, 80, 1500, 500, 8000

FRONT = "These are the first pages of a document. Answer with a JSON object: title, subtitle, authors (a list of names), has_toc, has_abstract, body_starts_at_page. Copy what is printed; use null for what is not there."
BACK = "These are the last pages of a document. Answer with a JSON object: has_references, has_endnotes, has_appendix, back_matter_starts_at_page (null if the text goes on to the end)."
SECTIONS = "Which of these numbered lines are section headings? Answer with a JSON array of lines, copied as they stand; [] if none is."
CLASSIFY = "Give each numbered piece one of the labels. Answer with a JSON array of labels, one a piece, in order."
CORRECT = "Look at the labels of these numbered pieces again. Answer with a JSON array of {index, from, to} for those that are wrong; [] if none is."
PARAGRAPH = "Rewrite this one paragraph in plain words; do not describe it."
BRIDGE = "In two sentences, tell what this part has said so far."
SMOOTH = "Make the joints between these paragraphs read well; change nothing else."
VERIFY = "List claims that the second text drops, changes or invents. If there are none, answer: no issues."
GLOSSARY = "Give the special terms of this text as a JSON object of term to meaning."
SUMMARY = "Describe this book in 300 to 500 words."
FOOTNOTES = "Give terms that need a note as a JSON object of term to note, {} if none."
CONCEPTS = "Draw the main ideas of this text as a Mermaid flowchart of 8 to 15 nodes."


def _text(c) -> Column:
    return F.concat(F.lit("TEXT:\n"), c)


def _bullets(terms) -> Column:
    return F.array_join(F.transform(F.map_entries(terms), lambda e: F.concat(F.lit("* "), e.key, F.lit(" = "), e.value)), "\n")


def request(task: str, text) -> Column:
    return F.concat_ws("\n\n", F.lit(task), _text(text))


def paragraph(text, summary, glossary, context) -> Column:
    """The paragraph's words, the start of the book's summary, terms and what was before."""
    return F.concat_ws(
        "\n\n",
        F.lit(PARAGRAPH),
        F.format_string("About %d words.", word_count(text)),
        F.when(summary != "", F.concat(F.lit("About the book: "), F.left(summary, F.lit(SUMMARY_CHARS)))),
        F.when(F.size(F.map_keys(glossary)) > 0, F.concat(F.lit("Terms:\n"), _bullets(glossary))),
        F.when(context != "", F.concat(F.lit("What came before: "), context)),
        _text(text),
    )


def bridge(text) -> Column:
    return request(BRIDGE, F.right(text, F.lit(BRIDGE_CHARS)))


def smoothing(text) -> Column:
    return F.concat_ws("\n\n", F.lit(SMOOTH), F.format_string("Keep %d paragraphs and about %d words.", F.size(paragraphs(text)), word_count(text)), _text(text))


def verification(original, result) -> Column:
    return F.concat_ws("\n\n", F.lit(VERIFY), F.concat(F.lit("FIRST:\n"), original), _text(result))


def concepts(text) -> Column:
    return request(CONCEPTS, F.left(text, F.lit(MAP_CHARS)))


def numbered(items) -> Column:
    """array<string> as lines ``0: ...``."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)), "\n")


def labelling(items, labels, task: str = CLASSIFY) -> Column:
    return F.concat_ws("\n\n", F.lit(task), F.lit("Labels: " + ", ".join(labels)), _text(numbered(items)))
