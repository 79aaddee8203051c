"""Content regions and links of HTML, as Arrow UDFs over the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import MIN_DESCRIBABLE

# Where a page's content is looked for, in this order.
SELECTORS = ("main", "[role=main]", "article", "#content", ".content")
#: A region must be longer than this to be taken.
LEAST_REGION = 80
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "header", "footer", "nav", "aside", "pre", "blockquote", "br"}


class Page(HTMLParser):
    """Collects the text of the first match of each selector, of the body, and the links."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.parts: dict[str, list[str]] = {"body": []}
        self.live: dict[str, int] = {}
        self.links: list[str] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BLOCK:
            self.handle_data("\n")
        if tag in VOID:
            return
        self.open.append(tag)
        self.hidden += tag in HIDDEN
        fits = {"main": tag == "main", "[role=main]": a.get("role") == "main", "article": tag == "article", "#content": a.get("id") == "content", ".content": "content" in (a.get("class") or "").split()}
        for selector, ok in fits.items():
            if ok and selector not in self.parts:
                self.parts[selector] = []
                self.live[selector] = len(self.open)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.handle_data("\n")
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.hidden -= last in HIDDEN
            self.live = {s: d for s, d in self.live.items() if d <= len(self.open)}
            if last == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            for s in ("body", *self.live):
                self.parts[s].append(data)

    def text(self, part: str) -> str:
        """Rendered-like text: runs of blanks become one, lines are trimmed, empty lines go."""
        lines = (re.sub(r"[ \t\r\f]+", " ", x).strip() for x in "".join(self.parts.get(part, [])).split("\n"))
        return "\n".join(x for x in lines if x)


def content_of(html: str | None, strict: bool = False) -> str:
    """Text of the first region with substance, else of the body, or nothing if strict."""
    page = Page(html or "")
    for s in SELECTORS:
        if len(text := page.text(s)) > LEAST_REGION:
            return text
    return "" if strict else page.text("body")


def content_region(html: str | Column, strict: bool = False) -> Column:
    @F.pandas_udf("string")
    def region(values):
        import pandas as pd

        return pd.Series([content_of(v, strict) for v in values], dtype=object)

    return region(html)


def links(html: str | Column) -> Column:
    """All hrefs of a page in order."""

    @F.pandas_udf("array<string>")
    def found(values):
        import pandas as pd

        return pd.Series([Page(v or "").links for v in values], dtype=object)

    return found(html)


def content_size(text: Column) -> Column:
    """Code points without outer white space."""
    return F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def is_describable(size: Column, least: int = MIN_DESCRIBABLE) -> Column:
    return size >= least
