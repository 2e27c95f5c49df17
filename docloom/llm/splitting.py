"""Cutting oversized items at natural boundaries, with overlap, inside the SQL engine.

One bounded-quantifier pattern does the work: its alternatives are ordered by the strength of the boundary
(before a heading, blank line, line end, sentence end, clause, white space) and each consumes greedily up to
the limit; what offers no boundary falls back to characters.  Code fences are kept whole where they fit: before the
pattern runs, everything in a fence that looks like a boundary is replaced by stand-ins, which only its last
alternatives, for fences that are over the limit themselves, take for boundaries.  The matches tile the text.  The
overlap is looked back for in the piece before with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 800, 80, 4
#: characters that make a boundary, and noncharacters that stand for them inside fences
BOUNDARY = "\n \r\t.!?…,;:。！？।۔።，；：、"
STAND_IN = "".join(chr(0xFDD0 + i) for i in range(len(BOUNDARY)))
_LINE_IN, _SPACE_IN = STAND_IN[0], STAND_IN[:4]
_MARK = r"[ \t]{0,3}(?:`{3,}|~{3,})"
_FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})(?s:.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*\r?$|\z)"


def protected(content: Column) -> Column:
    """``content`` with stand-ins in its fences; a text that holds such noncharacters itself stays as it is."""
    segments = F.regexp_extract_all(content, F.lit(rf"(?m)({_FENCE}|(?s:.+?)(?=^{_MARK}|\z))".replace(r"\1", r"\2")), F.lit(1))
    joined = F.array_join(F.transform(segments, lambda s: F.when(s.rlike(f"^{_MARK}"), F.translate(s, BOUNDARY, STAND_IN)).otherwise(s)), "")
    return F.when(content.rlike("```|~~~") & ~content.rlike(f"[{STAND_IN[0]}-{STAND_IN[-1]}]"), joined).otherwise(content)


def unprotected(text: Column, content: Column) -> Column:
    return F.when(content.rlike(f"[{STAND_IN[0]}-{STAND_IN[-1]}]"), text).otherwise(F.translate(text, STAND_IN, BOUNDARY))


def boundary_pattern(limit: int, least: int = 1) -> str:
    """Pattern whose matches tile any text in parts of ``least`` (the rest: 1) to ``limit`` code points."""
    half, quarter = max(1, limit // 2), max(1, limit // 4, least)
    take, early = rf".{{{half},{limit}}}", rf".{{{quarter},{limit}}}"
    heading, blank = r"(?<=\n)(?=#{1,6}[ \t])", r"(?<=\n\n|\n\r\n)(?!\r?\n)"
    return "(?s)" + "|".join(
        [
            rf".{{1,{limit}}}\z",  # the rest fits
            take + heading,
            early + heading,
            take + blank,
            rf"{take}(?<=\n)",  # after a line
            early + blank,
            rf"{take}(?<=[.!?…][\"'”’»)\]]?\s)|{take}(?<=[。！？।۔።])(?![」』”’）])",  # after a sentence
            rf"{take}(?<=[,;:，；：、]\s?)(?!\s)",  # after a clause
            rf"{take}(?<=\s)(?!\s)",  # after white space
            rf".{{{least},{limit}}}(?<=\n)(?=[^\n]*{_LINE_IN})",  # before a fence that does not fit beside what is held
            rf"{take}(?<={_LINE_IN}{_LINE_IN})(?!{_LINE_IN})|{take}(?<={_LINE_IN})|{take}(?<=[{_SPACE_IN}])(?![{_SPACE_IN}])",  # inside a fence
            rf".{{{half},{limit}}}(?!\p{{M}}|\n|[\x{{FE0F}}\x{{200D}}])(?<![\x{{200D}}])",  # between characters
            rf".{{1,{limit}}}",
        ]
    )


def split_pieces(content: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Array of the pieces of a text: at most ``max_tokens`` each, consecutive ones overlapping exactly.

    Tokens are code points div 4.  A text within the limit is its only piece; empty gives ``[]``, null gives null.
    """
    size = max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    overlap = overlap_tokens * CHARS_PER_TOKEN
    if not 0 <= overlap * 3 <= size:
        raise ValueError("the overlap must be at most a third of the size")

    def cut(text: Column) -> Column:
        head = F.regexp_extract(text, boundary_pattern(size, max(1, overlap)), 0)
        rest = F.regexp_extract_all(F.substr(text, F.length(head) + 1), F.lit(boundary_pattern(size - overlap, max(1, overlap))), F.lit(0))
        return F.transform(F.concat(F.array(head), rest), lambda x: unprotected(x, content))

    cores = F.transform(F.array(protected(content)), cut)[0]  # a lambda's variable is evaluated once, an expression in a lambda for each element

    def overlapped(parts: Column) -> Column:
        return F.transform(parts, lambda core, i: F.when(i == 0, core).otherwise(F.concat(F.right(F.element_at(parts, i), F.lit(overlap)), core)))

    pieces = F.transform(F.array(cores), overlapped)[0]
    whole = F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.array(content))
    return F.when(F.length(content) <= size, whole).otherwise(pieces)


def split_oversized(
    df: DataFrame,
    *,
    row_id: str,
    content: str,
    src_table: str,
    heading_path: str = "heading_path",
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Pieces of the items above ``max_tokens``: ``src_table, row_id, piece_no, heading_path, piece, n_tokens``.

    ``piece_no`` counts from 1.  Items within the limit, empty and null ones have no rows: they stay as they
    are.  Rows repeated as a whole give their pieces once; an id with different texts has the pieces of each.
    """
    size = max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    big = (
        df.select(F.col(row_id).cast("long").alias("row_id"), F.col(heading_path).alias("heading_path"), F.col(content).alias("content"))
        .where(F.length("content") > size)
        .distinct()
    )
    return (  # the outer form, as of the other the engine infers a filter that cuts every text a second time
        big.withColumn("pieces", split_pieces(F.col("content"), max_tokens, overlap_tokens))
        .select(F.lit(src_table).alias("src_table"), "row_id", "heading_path", F.posexplode_outer("pieces").alias("pos", "piece"))
        .select("src_table", "row_id", (F.col("pos") + 1).alias("piece_no"), "heading_path", "piece", F.expr(f"length(piece) div {CHARS_PER_TOKEN}").alias("n_tokens"))
    )
