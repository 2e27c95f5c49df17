"""Sentence units of documents in any language and script.

Layout is read first: headings, fenced code and list items open units, blank lines end them.  Within a unit
a linear-chain model tags characters as boundary or inside.  Only characters that can end a sentence (a
terminal mark with what closes behind it, or white space beside a script that writes no sentence ends) get
a score; every other character is inside with certainty, so that Viterbi decoding steps from one of these
to the next.  Scores are sums of hashed features of the context; transitions depend on the distance.

The weights in ``models/sentences.npz`` are fitted by ``training/fit_sentences.py``.
"""

from __future__ import annotations

import io
import pkgutil
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "models/sentences.npz"
BUCKETS = 1 << 16
DISTANCES = (4, 12)

MARKS = ".!?…。！？｡।॥۔؟;;։။៕។" + "\u0f0d\u0f0e\u1362\u1367"  # the last ones Tibetan, Ethiopic
_MARK = re.compile(rf"[{MARKS}]+")
_BARE = "฀-๿຀-໿"  # Thai, Lao
_HAS_BARE = re.compile(f"[{_BARE}]")
_BARE_GAP = re.compile(rf"(?<=[{_BARE}])\s+(?=\S)|(?<=\S)\s+(?=[{_BARE}])")
_CLOSERS = "\"'”“’»)]」』）"
_SPAN = re.compile(r"`[^`\n]*`|“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\"[^\"]*\"|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")
_HAS_SPAN = re.compile(r"[`“«„「『\"(（\[]")
_GLUED = re.compile(r".{3,}[.!?…](?=[^\W\d_])([^.!?…]+)$")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣·]|(\d{1,9})[.)])[ \t]+(?=\S)")


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, where prose begins) of the layout units; the last is the end for headings and code, which stay whole."""
    out: list[list[int]] = []
    at, fence, open_, listed = 0, "", False, False
    for line in text.split("\n"):
        end = at + len(line)
        bare = line.strip()
        if fence:
            out[-1][1] = out[-1][2] = end
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
        elif not bare:
            open_ = listed = False
        else:
            first = line[len(line) - len(line.lstrip())]
            m = _FENCE.match(line) if first in "`~" else None
            item = None
            if m:
                fence = m[1]
                out.append([at, end, end])
                open_ = listed = False
            elif first == "#" and _HEADING.match(line):
                out.append([at, end, end])
                open_ = listed = False
            else:
                # a number opens an item inside a paragraph only if it is 1: anything else may be a wrapped line
                if first in "-*+•‣·" or first.isdigit():
                    item = _ITEM.match(line)
                if item and (not item[1] or not open_ or listed or item[1] == "1"):
                    out.append([at, end, at + item.end()])
                    open_ = listed = True
                elif open_:
                    out[-1][1] = end
                else:
                    out.append([at, end, at])
                    open_ = True
        at = end + 1
    return [tuple(u) for u in out]


@lru_cache(maxsize=20_000)
def script(c: str) -> str:
    """A character's class: digit, l and U for cased letters, the script's name for others, p for the rest."""
    if c.isdigit():
        return "0"
    if c.islower():
        return "l"
    if c.isupper():
        return "U"
    if c.isalpha() or unicodedata.category(c)[0] == "M":
        return unicodedata.name(c, "?").split(" ")[0]
    return "p"


def _shape(token: str) -> str:
    """What a token before a mark looks like."""
    if not token:
        return ""
    last = token[-1]
    if last in "`)" and "`" in token:
        return "`"
    kind = script(last)
    if kind == "U":
        return "A" if len(token) == 1 else "AA"
    if kind == "l" and token[0].isupper():
        return "Aa" if len(token) > 1 else "A"
    return kind


def _opens(token: str) -> str:
    """How the text after a mark begins."""
    if not token:
        return ""
    c = token[0]
    if c in "`(（“„«「『\"¿¡[‘":
        return c
    if "_" in token and c.isalpha() or c.islower() and not token.islower():  # commit_page, macOS
        return "id"
    return script(c) if script(c) != "p" else c


def features(before: str, marks: str, closers: str, gap: str, after: str, inside: str) -> list[str]:
    """Names of the active features of a place where a sentence may end."""
    if not marks:  # white space beside a script without sentence marks
        left, right = before[-8:], after[:8]
        ls, rs = script(left[-1:]) if left else "", script(right[:1]) if right else ""
        if left.endswith("`"):
            ls = "`"
        if right.startswith("`"):
            rs = "`"
        grams = [f"tl{k}{left[-k:]}|{rs}" for k in (2, 3, 4, 5, 6)] + [f"tr{k}{right[:k]}|{ls}" for k in (2, 3, 4, 5, 6)]
        return ["tb", f"ts{ls}|{rs}", f"ti{inside}", f"tg{gap}|{ls}|{rs}", *grams]
    low, nlow = before.lower()[-12:], after.lower()[:10].rstrip(".,:;!?")
    p, n, m = _shape(before), _opens(after), marks if len(marks) < 3 else marks[0] * 3
    g = "" if not gap else "s"
    return [
        f"b{m}",
        f"i{inside}|{m[0]}",
        f"g{m}|{g}|{n}",
        f"p{low}|{m[0]}",
        f"q{low}|{m[0]}|{n}",
        f"r{p}|{m}|{g}|{n}",
        f"n{m[0]}|{nlow}",
        f"o{p}|{m[0]}|{nlow}",
        f"c{closers}|{m[0]}|{g}|{n}",
        f"e{closers}|{low}",
        f"d{inside}|{closers}|{n}",
    ]


def hashed(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) % BUCKETS for x in names], "int64")


def candidates(text: str, start: int, end: int) -> list[tuple[int, tuple[str, str, str, str, str, str]]]:
    """(place where a sentence would end, context) of the characters of ``text[start:end]`` that may end one."""
    unit = text[start:end]
    spans = [(m.start(), m.end(), unit[m.start()]) for m in _SPAN.finditer(unit)] if _HAS_SPAN.search(unit) else []
    closing = {b - 1 for _, b, c in spans if c != "`"}
    small = "l" if unit.islower() else ""  # written without capitals, which begin no sentence then
    out = []
    k, size = 0, len(unit)
    for m in _MARK.finditer(unit):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        held = spans[k] if k < len(spans) and spans[k][0] < a else None
        if held and held[2] == "`":
            continue
        e = b
        while e < size:
            c = unit[e]
            if c in _CLOSERS and e in closing:
                e += 1
            elif c in "   " and unit[e + 1 : e + 2] == "»" and e + 1 in closing:
                e += 2
            else:
                break
        tail = unit[e : e + 40]
        after = tail.lstrip()
        if not after:
            if not unit[e:].strip():
                continue  # the unit ends here anyway
            after = unit[e:].lstrip()[:24]
        gap = "\n" if "\n" in tail[: len(tail) - len(after)] else " " if tail[:1].isspace() else ""
        head = unit[max(0, a - 32) : a].rstrip()
        before = head.split()[-1].lstrip("(“„«「『\"（[¿¡‘") if head else ""
        glued = _GLUED.match(before)
        if glued:
            before = glued[1]  # a sentence that began without a space
        inside = small + ("" if held is None or e >= held[1] else "(" if held[2] in "(（[" else "q")
        out.append((start + e, (before[-16:], m[0][:4], unit[b:e].strip(), gap, after.split(None, 1)[0][:16], inside)))
    if _HAS_BARE.search(unit):
        for m in _BARE_GAP.finditer(unit):
            a, b = m.span()
            if any(s < a < t and c == "`" for s, t, c in spans) or unit[a - 1] in MARKS:
                continue
            inside = "q" if any(s < a and b < t for s, t, _ in spans) else ""
            out.append((start + a, (unit[max(0, a - 12) : a], "", "", "\n" if "\n" in m[0] else " ", unit[b : b + 12], inside)))
        out.sort(key=lambda c: c[0])
    return out


def distance(step: int) -> int:
    return 0 if step <= DISTANCES[0] else 1 if step <= DISTANCES[1] else 2


def decode(scores: list[float], steps: list[int], trans: np.ndarray) -> list[bool]:
    """Viterbi: the best tags (True: boundary) of a chain of places; ``trans[distance, tag before, tag]``."""
    inside, bound = 0.0, float("-inf")  # a unit begins after something that ended
    first = True
    back: list[tuple[bool, bool]] = []
    for s, d in zip(scores, steps):
        t = trans[distance(d)]
        if first:
            inside, bound, first = 0.0, s, False
            back.append((False, False))
            continue
        i0, i1 = inside + t[0][0], bound + t[1][0]
        b0, b1 = inside + t[0][1], bound + t[1][1]
        back.append((i1 > i0, b1 > b0))
        inside, bound = max(i0, i1), max(b0, b1) + s
    tag = bound > inside
    tags = [False] * len(scores)
    for k in range(len(scores) - 1, -1, -1):
        tags[k] = tag
        tag = back[k][1] if tag else back[k][0]
    return tags


class Tagger:
    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights.astype("float64"), trans.astype("float64").tolist()
        self.score = lru_cache(maxsize=300_000)(self._score)

    @classmethod
    @lru_cache(maxsize=1)
    def shipped(cls) -> Tagger:
        with np.load(io.BytesIO(pkgutil.get_data(__package__, MODEL))) as z:  # also from a zipped package
            return cls(z["weights"], z["trans"])

    def _score(self, context: tuple) -> float:
        return float(self.weights[hashed(features(*context))].sum())

    def ends(self, text: str, start: int, end: int) -> list[int]:
        found = candidates(text, start, end)
        if not found:
            return []
        at = [p for p, _ in found]
        tags = decode([self.score(c) for _, c in found], [p - q for p, q in zip(at, [start, *at])], self.trans)
        return [p for p, t in zip(at, tags) if t]

    def sentences(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every sentence unit, without white space at either end."""
        out = []
        for start, end, prose in units(text):
            a = start
            for b in [*(self.ends(text, prose, end) if prose < end else ()), end]:
                piece = text[a:b]
                left = piece.lstrip()
                if left:
                    s = a + len(piece) - len(left)
                    out.append((s, s + len(left.rstrip())))
                a = b
        return out


def sentences(df: DataFrame, *, item_id: str, text: str, with_text: bool = False) -> DataFrame:
    """Distinct ``(doc_id, sent_start, sent_end[, sentence])``, offsets in code points, one row a sentence unit.

    Null, empty and blank texts have no units.  Rows repeated as a whole give one set of rows; an id with
    different texts gives the units of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.shipped()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [tagger.sentences(t) if t else [] for t in texts]
            count = np.fromiter(map(len, found), "int64", len(found))
            flat = np.array([x for f in found for x in f], "int64").reshape(-1, 2)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), count))), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
            if with_text:
                columns.append(pa.array([t[a:b] for t, f in zip(texts, found) for a, b in f], "string"))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(item_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "sent_start", "sent_end", *(["sentence"] if with_text else [])]
    ddl = "doc_id long, sent_start long, sent_end long" + (", sentence string" if with_text else "")
    return rows.mapInArrow(run, ddl).distinct()
