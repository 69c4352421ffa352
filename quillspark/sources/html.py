"""HTML to Markdown with the standard parser, batch by batch."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "title"}
_BLOCKS = {"p", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "div", "section", "article", "nav", "footer", "header", "main", "aside", "table", "body"}


class _Markdown(HTMLParser):
    """Text by blocks. ``kinds`` holds the open blocks, so that a paragraph inside an
    item or a quote is still one; a block that is not closed ends with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.kinds: list[str] = []
        self.skip = ""

    def flush(self):
        words = " ".join(x for x in (t.strip() for t in self.text) if x)
        self.text.clear()
        if not words:
            return
        head = next((k for k in reversed(self.kinds) if re.fullmatch("h[1-6]", k)), "")
        outer = next((k for k in reversed(self.kinds) if k in ("li", "blockquote")), "")
        mark = "#" * int(head[1]) + " " if head else {"li": "- ", "blockquote": "> "}.get(outer, "")
        gap = "\n" if head or (not mark and self.kinds[-1:] == ["p"]) else ""
        self.out.append(f"{gap}{mark}{words}{gap}")

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip = self.skip or tag
        elif tag in _BLOCKS:
            self.skip = ""
            self.flush()
            if self.kinds and self.kinds[-1] == "p" or self.kinds[-1:] == [tag] == ["li"]:
                self.kinds.pop()  # their end tags may be left out
            self.kinds.append(tag)

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = ""
        elif tag in _BLOCKS:
            self.flush()
            if tag in self.kinds:
                while self.kinds.pop() != tag:
                    pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def markdown(html: str | None) -> str:
    """Headings, paragraphs, list items and quotes; scripts and styles are left out."""
    p = _Markdown()
    p.feed(html or "")
    p.close()
    p.flush()
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(p.out)).strip()


def html_to_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(markdown)

    return pages.withColumn("text", run(F.col(html)))
