"""Main body of a page: every line is labelled furniture or content by a small recurrent network.

A text becomes a sequence of leaf blocks: a line, or a whole fenced block or table.  A block is read as the
mean of its hashed words' vectors plus vectors of its tag path (kind of leaf, list mark, depth, links,
length, ending, its place in the text, whether a heading of the text says the same).  A bidirectional LSTM,
in numpy, runs over the sequence, so that a block is judged in the light of the whole text.  Spark splits
the table into Arrow batches; texts of one batch advance together, longest first, without padding.

The weights in ``models/boilerplate.npz`` are fitted by ``training/fit_boilerplate.py``.
"""

from __future__ import annotations

import io
import pkgutil
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4096
MODEL = "models/boilerplate.npz"
#: scripts without spaces are read in pairs of characters
_DENSE = "\u3040-\u30ff\u3400-\u9fff"
_TOKEN = re.compile(rf"[{_DENSE}]{{1,2}}|[^\W\d_{_DENSE}]+|\d+|[^\w\s]")
_KIND = re.compile(r"(#{1,6}(?=\s))|([-*+•]\s)|(\d+[.)]\s)|(>)|(\|.*\|$)|([\[☰‹←])")
_LINK = re.compile(r"\]\((.)")
#: sizes of the tag path's parts, in the order block_tags() fills them
PARTS = {"kind": 14, "indent": 3, "length": 9, "end": 9, "link": 6, "tokens": 8, "before": 4, "after": 4, "start": 7, "rest": 7, "echo": 2}
OFFSETS = np.cumsum([WORDS, *PARTS.values()])[:-1]
ROWS = WORDS + sum(PARTS.values())
_ENDS = {c: 1 for c in ".。．"} | {c: 2 for c in "!?！？؟।…"} | {c: 3 for c in ":："} | {c: 4 for c in "*_"} | {c: 5 for c in ")]）"} | {"`": 6, "›": 7}


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(("0" * len(word) if word.isdigit() else word).encode()) % WORDS


@lru_cache(maxsize=50_000)
def _buckets(part: str) -> tuple[int, ...]:
    return tuple(map(_bucket, _TOKEN.findall(part)))


def word_buckets(text: str) -> tuple[int, ...]:
    """Buckets of the tokens of ``text``; no token holds white space, so that what stands between it is read once."""
    parts = text.split()
    if len(text) > 16 * len(parts):  # scripts without spaces, addresses: parts that hardly recur
        return tuple(map(_bucket, _TOKEN.findall(text)))
    return tuple(chain.from_iterable(map(_buckets, parts)))


@lru_cache(maxsize=50_000)
def read_line(line: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Word buckets and the tag-path parts that depend on the line alone."""
    bare = line.strip()
    m = None if bare[0].isalpha() else _KIND.match(bare)
    kind = 0
    if m:
        kind = {1: 1 + min(2, len(m[1] or "") - 1), 2: 4 + "-*+•".find(bare[0]), 3: 8, 4: 9, 5: 10, 6: 11}[m.lastindex]
    elif bare[0] in "*_" and bare[-1] in "*_":
        kind = 12
    indent = len(line) - len(line.lstrip())
    first = _LINK.search(bare) if "](" in bare else None
    link = 0 if not first else {"#": 1, "/": 2, ".": 3}.get(first[1], 4)
    if link == 4 and bare.endswith(")"):
        link = 5
    words = word_buckets(bare.lower())
    end = _ENDS.get(bare[-1], 8 if bare[-1].isdigit() else 0)
    parts = (kind, min(2, (indent + 1) // 2), min(8, len(bare).bit_length()), end, link, min(7, len(words).bit_length()))
    return words, parts


#: kinds that are never furniture: headings, tables, code
NEVER = {1, 2, 3, 10, 13}
#: how far from either end of a text a block is, by powers of two
_PLACE = [i.bit_length() - 1 for i in range(1, 64)]
CODE = ((_bucket("```"),), (13, 0, 0, 0, 0, 0))


def blocks(text: str) -> tuple[list[tuple[int, int]], list, list]:
    """Line spans (from 0, end exclusive), line readings and context parts of the leaf blocks of ``text``."""
    lines = text.split("\n")
    spans, read, echo, gaps = [], [], [], []
    heads, fence, gap, table = set(), -1, 1, -1
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            if fence < 0:
                gap, table = gap + 1, -1
            continue
        first = bare[0]
        if first == "`" and bare.startswith("```"):
            if fence < 0:
                fence = i
            else:
                spans.append((fence, i + 1)), read.append(CODE), echo.append(""), gaps.append(gap)
                fence, gap = -1, 0
            table = -1
            continue
        if fence >= 0:
            continue
        if first == "|" and bare[-1] == "|":
            if table >= 0:
                spans[-1] = (spans[-1][0], i + 1)
                continue
            table = i
        else:
            table = -1
        spans.append((i, i + 1))
        read.append(read_line(line.rstrip()))
        gaps.append(gap)
        gap = 0
        word = bare if first.isalpha() else bare.lstrip("#-*+•>[ ")
        word = (word.partition("]")[0] if "]" in word else word).lower()
        if first == "#":
            heads.add(word)
            word = ""
        echo.append(word)
    if fence >= 0:
        spans.append((fence, len(lines))), read.append(CODE), echo.append(""), gaps.append(gap)
    n = len(spans)
    before = [g if g < 3 else 3 for g in gaps]
    place = _PLACE[:n] + [6] * (n - len(_PLACE))
    context = list(zip(before, [*before[1:], 3], place, reversed(place), [int(e in heads) for e in echo]))
    return spans, read, context


class Labeller:
    """The network; ``w`` holds E (vectors), and for each direction W (input), U (state), b, and the output layer."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, "float32") for k, v in w.items()}

    @classmethod
    @lru_cache(maxsize=1)
    def shipped(cls) -> Labeller:
        with np.load(io.BytesIO(pkgutil.get_data(__package__, MODEL))) as z:  # also from a zipped package
            return cls({k: z[k] for k in z.files})

    def embed(self, read: list, context: list) -> np.ndarray:
        """Input vectors of blocks; equal readings are embedded once."""
        seen: dict = {}
        which = np.fromiter((seen.setdefault(r, len(seen)) for r in read), "int64", len(read))
        flat = np.fromiter(chain.from_iterable(r[0] for r in seen), "int64")
        sizes = np.fromiter((len(r[0]) for r in seen), "int64", len(seen))
        E = self.w["E"]
        sums = np.zeros((len(seen), E.shape[1]), "float32")
        full = sizes > 0
        if len(flat):
            starts = (np.cumsum(sizes) - sizes)[full]
            for a in range(0, len(starts), 4096):  # in slices, to keep the gathered vectors small
                s = starts[a : a + 4096]
                e = starts[a + 4096] if a + 4096 < len(starts) else len(flat)
                sums[np.flatnonzero(full)[a : a + 4096]] = np.add.reduceat(E[flat[s[0] : e]], s - s[0], axis=0)
            sums[full] /= sizes[full, None]
        own = np.array([r[1] for r in seen], "int64").reshape(-1, 6) + OFFSETS[:6]
        sums += E[own].sum(1)
        around = np.array(context, "int64").reshape(-1, 5) + OFFSETS[6:]
        return sums[which] + E[around].sum(1)

    def _run(self, x: np.ndarray, active: np.ndarray, first: np.ndarray, side: str) -> np.ndarray:
        """Hidden states; step t of text k is row ``first[t] + k`` for the ``active[t]`` longest texts."""
        U, H = self.w["U" + side], self.w["U" + side].shape[0]
        z = x @ self.w["W" + side] + self.w["b" + side]
        out = np.empty((len(x), H), "float32")
        h, c = np.zeros((active[0], H), "float32"), np.zeros((active[0], H), "float32")
        steps = range(len(active)) if side == "f" else range(len(active) - 1, -1, -1)
        for t in steps:
            n, a = active[t], first[t]
            g = z[a : a + n] + h[:n] @ U
            gate = 1 / (1 + np.exp(-g[:, : 3 * H]))
            c[:n] = gate[:, H : 2 * H] * c[:n] + gate[:, :H] * np.tanh(g[:, 3 * H :])
            h[:n] = gate[:, 2 * H :] * np.tanh(c[:n])
            out[a : a + n] = h[:n]
        return out

    def scores(self, texts: list[tuple[list, list]]) -> list[np.ndarray]:
        """Log odds of furniture for each block of each ``(read, context)``."""
        sizes = np.array([len(r) for r, _ in texts], "int64")
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        result = [np.zeros(0, "float32")] * len(texts)
        if not len(order):
            return result
        x = self.embed([b for k in order for b in texts[k][0]], [b for k in order for b in texts[k][1]])
        n = sizes[order]
        active = (n[None, :] > np.arange(n[0])[:, None]).sum(1) if n[0] * len(n) < 5_000_000 else np.searchsorted(-n, -np.arange(n[0]), "left")
        first = np.cumsum(active) - active
        row = first[np.concatenate([np.arange(k) for k in n])] + np.repeat(np.arange(len(n)), n)
        packed = np.empty_like(x)
        packed[row] = x
        h = np.concatenate([self._run(packed, active, first, "f"), self._run(packed, active, first, "b")], 1)
        y = (h @ self.w["V"] + packed @ self.w["S"] + self.w["c"])[row, 0]
        for k, part in zip(order, np.split(y, np.cumsum(n)[:-1])):
            result[k] = part
        return result


def furniture_lines(texts: list[str | None], group: int = 512) -> list[list[int]]:
    """Line numbers, from 1, of the non-blank lines of each text that are site furniture."""
    net = Labeller.shipped()
    out: list[list[int]] = []
    for a in range(0, len(texts), group):
        cut = [blocks(t or "") for t in texts[a : a + group]]
        for (spans, read, _), y in zip(cut, net.scores([c[1:] for c in cut])):
            out.append([n + 1 for k in np.flatnonzero(y > 0) if read[k][1][0] not in NEVER for n in range(*spans[k])])
    return out


def furniture(df: DataFrame, *, row_id: str, content: str, src_table: str) -> DataFrame:
    """Distinct ``(src_table, row_id, line_no)`` of the lines of ``content`` that are site furniture.

    A null or empty text has no lines.  Rows repeated with one text give one result; if an id comes with
    different texts, the lines of all of them are returned.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = furniture_lines(batch.column(1).to_pylist())
            count = np.fromiter(map(len, found), "int64", len(found))
            ids = np.repeat(np.arange(len(found)), count)
            lines = np.fromiter((n for x in found for n in x), "int64", int(count.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(lines)], ["row_id", "line_no"])

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(content).alias("content"))
    return rows.mapInArrow(run, "row_id long, line_no long").distinct().select(F.lit(src_table).alias("src_table"), "row_id", "line_no")


def main_body(df: DataFrame, *, content: str, into: str = "main_body") -> DataFrame:
    """``df`` with a column holding the text without its furniture lines; null texts stay null."""

    @F.pandas_udf("string")
    def strip(texts):
        import pandas as pd

        out = []
        for text, drop in zip(texts, furniture_lines(list(texts))):
            if text is None or not drop:
                out.append(text)
                continue
            gone = set(drop)
            kept = "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in gone)
            out.append(re.sub(r"\n(?:[ \t\r]*\n){2,}", "\n\n", kept).strip("\r\n"))
        return pd.Series(out, dtype=object)

    return df.withColumn(into, strip(F.col(content)))
