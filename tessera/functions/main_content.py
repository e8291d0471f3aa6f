"""Main content of pages from the spans of their elements.

A page is cut into tags and texts.  Each start tag gets a span: up to the end tag
that closes it, to the end tag of an element around it, or to the end of the page.
The spans of main elements are painted over the page, and so are those of elements
that are left out; a text counts where the first paint lies and the second does not.
Nested elements, unclosed ones and stray end tags need no further rule.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "title string, lines array<string>, links array<struct<href: string, label: string>>"
#: Elements that have no content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(frozen=True)
class Rules:
    """What is main, what is left out, and what ends a line."""

    main_tags: frozenset = frozenset({"main", "article"})
    main_ids: frozenset = frozenset({"main", "main-content", "content"})
    left_out: frozenset = frozenset("script style noscript template svg nav header footer aside form button".split())
    #: words of an id or a class
    markers: frozenset = frozenset("ad ads advert breadcrumb cookie menu sidebar share".split())
    blocks: frozenset = frozenset("address article blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split())

    def is_main(self, tag: str, attributes: dict[str, str]) -> bool:
        return tag in self.main_tags or attributes.get("role", "").lower() == "main" or attributes.get("id", "").lower() in self.main_ids

    def is_left_out(self, tag: str, attributes: dict[str, str]) -> bool:
        words = re.split(r"[^a-z0-9]+", f"{attributes.get('id', '')} {attributes.get('class', '')}".lower())
        return tag in self.left_out or not self.markers.isdisjoint(words)


def folded(text: str) -> str:
    """White space of any kind, wide spaces too, as one space."""
    return " ".join(text.split())


def attributes_of(source: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def pieces(html: str) -> list[tuple[str, str, str]]:
    """(kind, tag or text, attributes): kinds are ``<``, ``/`` and ``text``; comments and declarations are passed over."""
    out, at = [], 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            out.append(("text", unescape(text), ""))
        if not m:
            break
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = bool(m[1] or m[4])
        out.append(("/" if ends else "<", tag, m[3] or m[6] or ""))
        if tag in RAW and not ends:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            until = close.start() if close else len(html)
            inside = html[at:until]
            if inside:
                out.append(("text", unescape(inside) if tag in ("title", "textarea") else inside, ""))
            at = until
    return out


def spans(parts: list[tuple[str, str, str]]) -> dict[int, int]:
    """End of each element's span by the place of its start tag."""
    ends, standing, count = {}, [], Counter()
    for i, (kind, tag, _) in enumerate(parts):
        if kind == "<" and tag not in VOID:
            standing.append(i)
            count[tag] += 1
        elif kind == "/" and count[tag]:
            closed = None
            while closed != tag:
                start = standing.pop()
                closed = parts[start][1]
                count[closed] -= 1
                ends[start] = i
    return ends | dict.fromkeys(standing, len(parts))


def extract(html: str | None, rules: Rules = Rules()) -> tuple[str, list[str], list[tuple[str, str]]]:
    """(title, lines, links with their labels); links and lines are those of main elements, a line that repeats the one before is left out."""
    parts = pieces(html or "")
    ends = spans(parts)
    main, out = [0] * (len(parts) + 1), [0] * (len(parts) + 1)
    anchors, title = {}, ""
    for start, end in ends.items():
        _, tag, source = parts[start]
        attributes = attributes_of(source)
        for paint, hit in ((main, rules.is_main(tag, attributes)), (out, rules.is_left_out(tag, attributes))):
            if hit:
                paint[start] += 1
                paint[end] -= 1
        if tag == "a" and attributes.get("href", "").strip():
            anchors[start] = (attributes["href"].strip(), end)
    shown = [a > 0 and b == 0 for a, b in zip(accumulate(main), accumulate(out))]
    titles = [(s, e) for s, e in ends.items() if parts[s][1] == "title"]
    if titles:
        s, e = min(titles)
        title = folded(" ".join(p[1] for p in parts[s:e] if p[0] == "text"))

    lines, line, words, links, anchor = [], [], [], [], None
    for i, (kind, value, _) in enumerate(parts):
        if kind == "text":
            if shown[i] and (text := folded(value)):
                line.append(text)
                if anchor is not None:
                    words.append(text)
            continue
        if anchor is not None and i >= anchors[anchor][1]:
            links.append((anchors[anchor][0], " ".join(words)))
            anchor, words = None, []
        # a block ends the line before it and its own, whether or not it is shown
        if value in rules.blocks and line:
            lines.append(" ".join(line))
            line = []
        if i in anchors and shown[i]:
            if anchor is not None:
                links.append((anchors[anchor][0], " ".join(words)))
            anchor, words = i, []
    if anchor is not None:
        links.append((anchors[anchor][0], " ".join(words)))
    if line:
        lines.append(" ".join(line))
    return title, [x for i, x in enumerate(lines) if i == 0 or x != lines[i - 1]], links


def main_content(html: Column, rules: Rules = Rules()) -> Column:
    """struct(title, lines, links) of a page; null and empty pages have none of them."""

    @F.pandas_udf(SCHEMA)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = [extract(page, rules) for page in pages]
        return pd.DataFrame({"title": [r[0] for r in rows], "lines": [r[1] for r in rows], "links": [[{"href": h, "label": x} for h, x in r[2]] for r in rows]})

    return run(html)
