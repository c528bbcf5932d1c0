"""HTML pages to text with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements without content, elements that end a line.
SILENT = {"script", "style", "noscript", "header", "footer", "nav", "aside", "form", "svg", "template"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "blockquote", "title"}


class _Reader(HTMLParser):
    def __init__(self, only: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.only, self.inside, self.quiet, self.parts = only, 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == self.only
        self.quiet += tag in SILENT
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.inside -= tag == self.only and self.inside > 0
        self.quiet -= tag in SILENT and self.quiet > 0
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.quiet and (self.only is None or self.inside):
            self.parts.append(data)


def page_text(html: str | None) -> str:
    """The text of an article or main element if it has 200 characters, else of the whole page, one line per block."""
    best = ""
    for only in ("article", "main", None):
        reader = _Reader(only)
        reader.feed(html or "")
        reader.close()
        lines = (" ".join(x.split()) for x in "".join(reader.parts).split("\n"))
        best = "\n".join(x for x in lines if x)
        if len(best) >= 200:
            break
    return best


def extracted(pages: DataFrame, key: str, html: str, least: int = 200, most: int = 8000) -> DataFrame:
    """(key, text, text_len, failure): texts of at most ``most`` characters; shorter ones than ``least`` are failures."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [page_text(h) for h in pdf[html]]
            failure = ["no_html" if h is None else "too_short" if len(t) < least else None for h, t in zip(pdf[html], texts)]
            yield pd.DataFrame({key: pdf[key], "text": [None if f else t[:most] for t, f in zip(texts, failure)], "text_len": [len(t) for t in texts], "failure": failure})

    return pages.select(key, html).mapInPandas(go, f"{key} {dict(pages.dtypes)[key]}, text string, text_len int, failure string")
