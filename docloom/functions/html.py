"""Markdown of an HTML page's main part, as an Arrow UDF over a small tag handler."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is dropped from a page.
DROPPED_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript"}
DROPPED_CLASSES = {"sphx-glr-download-link-note", "sphx-glr-footer", "sphx-glr-timing", "sphx-glr-signature", "bd-sidebar-secondary"}
DROPPED_IDS = {"fixed-sidebar", "docs-sidebar", "docs-top-navigation-container", "narrow-index-nav", "docs-narrow-top-navigation"}

_SIGN = re.compile(r"\[¶\]\([^)]*\)|¶")
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_MAIN = (re.compile(r"<main\b[^>]*>(.*?)</main>", re.S | re.I), None, re.compile(r"<article\b[^>]*>(.*?)</article>", re.S | re.I), re.compile(r"<body\b[^>]*>(.*)</body>", re.S | re.I))
_ROLE = re.compile(r"<(\w+)\b[^>]*\brole\s*=\s*[\"']?main\b", re.I)


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.pre = False
        self.href: list[str | None] = []
        self.cells: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip:
            if tag == self.skip[0] and tag not in _VOID:
                self.skip.append(tag)
            return
        if tag in DROPPED_TAGS or DROPPED_CLASSES & set((a.get("class") or "").split()) or a.get("id") in DROPPED_IDS:
            if tag not in _VOID:
                self.skip = [tag]
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "blockquote", "table"):
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" * (2 if len(self.lists) == 1 else 1))
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = "-" if not self.lists or self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
            self.out.append("\n" + "  " * (len(self.lists) - 1) + mark + " ")
        elif tag == "a":
            self.href.append(a.get("href"))
            self.out.append("[")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        if tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.out.append(f"]({href})" if href else "]")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in ("p", "div", "section", "table") or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str) -> str:
    """Main element, element of role main, article or body, whichever comes first in this order."""
    part = html
    for pattern in _MAIN:
        if pattern is None:
            m = _ROLE.search(html)
            if m:
                part = html[m.start() :]
                depth = 0
                for t in re.finditer(rf"<(/?){m[1]}\b[^>]*>", part, re.I):
                    depth += -1 if t[1] else 1
                    if depth == 0:
                        part = part[: t.end()]
                        break
                break
        else:
            m = pattern.search(html)
            if m:
                part = m[1]
                break
    w = _Writer()
    w.feed(part)
    w.close()
    lines: list[str] = []
    for line in "".join(w.out).split("\n"):
        line = _SIGN.sub("", line).rstrip(" \t")
        if line or lines and lines[-1]:  # a run of blank lines is one
            lines.append(line)
    return "\n".join(lines).strip()


@F.pandas_udf(StringType())
def html_to_markdown(pages: pd.Series) -> pd.Series:
    """Markdown of each page; null stays null."""
    return pages.map(lambda h: None if h is None else markdown_of(h))
