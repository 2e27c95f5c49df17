"""Structural chunks of Markdown: top-level blocks are found line by line, and sections and blocks are where a text may be cut."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ITEM = re.compile(r"( {0,3}(?:([-+*])|(\d{1,9})([.)])))(?:[ \t]+|$)")
_INDENTED = re.compile(r"(?: {4}| {0,3}\t)\s*\S")
_QUOTE = re.compile(r" {0,3}>")
_HTML = re.compile(r" {0,3}<(?:[a-zA-Z/!?])")

Block = tuple[str, int, int, object]


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    if _HEADING.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _RULE.match(line):
        return True
    item = _ITEM.match(line)
    return bool(item) and bool(line[item.end() :].strip()) and item[3] in (None, "1")


def blocks(lines: list[str]) -> list[Block]:
    """Top-level blocks ``(kind, first line, line behind the last, more)``.

    ``more`` is the level and text of a heading, and the first lines of a list's items.  Kinds: heading, fence, code
    (indented), list, quote, html, rule, text.  Headings inside lists and quotes are not looked for.
    """
    out: list[Block] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        first = line.lstrip()[:1]
        if not first:
            i += 1
            continue
        start = i
        if _INDENTED.match(line):
            end = i + 1
            i += 1
            while i < n and (not lines[i].strip() or _INDENTED.match(lines[i])):
                i += 1
                if lines[i - 1].strip():
                    end = i
            out.append(("code", start, end, None))
            i = end
            continue
        m = _FENCE.match(line) if first in "`~" else None
        if m:
            close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*\r?$")
            i += 1
            while i < n and not close.match(lines[i]):
                i += 1
            i = min(n, i + 1)
            out.append(("fence", start, i, None))
            continue
        m = _HEADING.match(line.rstrip("\r")) if first == "#" else None
        if m:
            i += 1
            out.append(("heading", start, i, (len(m[1]), (m[2] or "").strip())))
            continue
        if _RULE.match(line):
            i += 1
            out.append(("rule", start, i, None))
            continue
        m = _ITEM.match(line)
        if m:
            kind, starts, blank = m[2] or m[4], [i], False
            inside = len(m[1]) + 1
            i, end = i + 1, i + 1
            fence = None
            while i < n:
                x = lines[i]
                if not x.strip():
                    blank = True
                    i += 1
                    continue
                depth = len(x) - len(x.lstrip(" \t"))
                deep = x[:depth].expandtabs(4)
                if fence:
                    if fence.match(x):
                        fence = None
                elif len(deep) >= inside:  # belongs to the item
                    f = _FENCE.match(x.lstrip())
                    if f:
                        fence = re.compile(rf"[ \t]*{re.escape(f[1][0])}{{{len(f[1])},}}[ \t]*\r?$")
                else:
                    item = _ITEM.match(x)
                    if item and not _RULE.match(x):
                        if (item[2] or item[4]) != kind:
                            break
                        starts.append(i)
                        inside = len(item[1]) + 1
                    elif blank or _interrupts(x):
                        break
                blank = False
                i += 1
                end = i
            out.append(("list", start, end, starts))
            i = end
            continue
        if first == ">":
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or not _interrupts(lines[i])):
                i += 1
            out.append(("quote", start, i, None))
            continue
        if first == "<" and _HTML.match(line):
            while i < n and lines[i].strip():
                i += 1
            out.append(("html", start, i, None))
            continue
        i += 1
        under = None
        while i < n and lines[i].strip():
            under = _UNDERLINE.match(lines[i])
            if under or _interrupts(lines[i]):
                break
            i += 1
        if under and i < n:
            text = "\n".join(x.strip() for x in lines[start:i])
            i += 1
            out.append(("heading", start, i, (1 if under[1][0] == "=" else 2, text)))
        else:
            out.append(("text", start, i, None))
    return out


def chunks_of(text: str, prefix: str | None, max_tokens: int, min_tokens: int) -> list[dict[str, str]]:
    """Chunks of one document; every line is looked at a bounded number of times."""
    lines = text.split("\n")
    before = [0, *accumulate(len(x) + 1 for x in lines)]
    path, levels = ([prefix] if prefix else []), []
    out: list[dict[str, str]] = []
    start = 0

    def tokens(a: int, b: int) -> int:
        return max(0, before[b] - before[a] - 1) // 4

    def close(end: int) -> None:
        nonlocal start
        content = "\n".join(lines[start:end]).strip()
        if content:
            out.append({"heading_path": " / ".join(path), "content": content})
        start = end

    for kind, a, b, more in blocks(lines):
        if kind == "heading":
            if tokens(start, a) >= min_tokens and len("\n".join(lines[start:a]).strip()) // 4 >= min_tokens:
                close(a)
            level, said = more
            while levels and levels[-1] >= level:
                levels.pop()
                path.pop()
            levels.append(level)
            path.append(said)
            continue
        if tokens(a, b) > max_tokens:
            if kind == "code":
                places = [n for n in range(a, b) if not lines[n].strip()]
            else:
                places = range(a + 1, b) if kind == "text" else more if kind == "list" else []
            for n in places:
                if tokens(start, n) > max_tokens:
                    close(n)
        if tokens(start, b) > max_tokens:
            close(b)
    rest = [x.strip() for x in lines[start:] if x.strip()]
    if any(not x.startswith("#") for x in rest) or len("\n".join(lines[start:]).strip()) // 4 >= min_tokens:
        close(len(lines))
    return out


_TYPE = pa.list_(pa.struct([("heading_path", pa.string()), ("content", pa.string())]))


def chunk_markdown(content: Column, prefix: Column, max_tokens: int = 800, min_tokens: int = 20) -> Column:
    """Chunks of a document at its structure: ``array<struct<heading_path, content>>``; null gives none.

    A heading closes the chunk before it, unless that is smaller than ``min_tokens`` and flows on; the path is
    the prefix and the headings above, of either kind.  Within a section a chunk is closed at the end of the block
    that takes it over ``max_tokens``.  A block too large itself is cut too: a paragraph at its lines, a list at its
    items, indented code at its blank lines; fences are not.  Sizes are code points div 4.
    """

    @F.arrow_udf("array<struct<heading_path:string,content:string>>")
    def cut(texts: pa.Array, prefixes: pa.Array) -> pa.Array:
        return pa.array([chunks_of(t, p, max_tokens, min_tokens) if t else [] for t, p in zip(texts.to_pylist(), prefixes.to_pylist())], _TYPE)

    return cut(F.regexp_replace(content, "\r\n", "\n"), prefix)
