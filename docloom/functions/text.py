"""Text functions as column expressions; the few that Spark has no function for are small Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StringType

#: Latin letters with marks and what they fold to in the index
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
# Words left out of queries.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should "
    "of in on at to for with by from as this that these those it its"
).split()
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_SEPARATORS = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_FENCE = re.compile(r"^```[^\n]*\n(?:.*?^```[^\n]*$|.*\Z)", re.S | re.M)


def tokens(text: Column) -> Column:
    """Index tokens in order: runs of letters and digits, lower case, Latin marks folded; null gives []."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO), F.lit(TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """Index tokens of a query less the stopwords; a repeated word stays repeated and counts as often."""
    return F.filter(tokens(query), lambda t: ~t.isin(STOPWORDS))


def term_set(text: Column) -> Column:
    """Distinct words of three or more ASCII letters and digits, the tokenizer of the difficulty tiers."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-z][a-z0-9]{2,}$")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Prose with space separators as spaces, tags out, and composed; fenced code as it is."""

    def prose(s: str) -> str:
        return unicodedata.normalize("NFC", re.sub(r"<[^>]+>", "", _SEPARATORS.sub(" ", s)))

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        out, at = [], 0
        for m in _FENCE.finditer(s):
            out += [prose(s[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, prose(s[at:])])

    return texts.map(one)


def normalize_text(text: Column | str) -> Column:
    """Prose: space separators to spaces, tags out, composed Unicode; fenced code as it is; blank runs to one; stripped.

    Only texts beyond ASCII leave the engine: the others have no separators and are composed.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(text, r"(?md)(^```[^\n]*\n(?s:.*?^```[^\n]*$|.*\z))|<[^>]+>", "$1")
    clean = F.when(text.rlike(r"[^\x00-\x7f]"), _composed(F.when(text.rlike(r"[^\x00-\x7f]"), text))).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(clean, r"\n(?:[ \t]*\n){2,}", "\n\n"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


@F.arrow_udf(ArrayType(ByteType()))
def line_states(texts: pa.Array) -> pa.Array:
    """For each line of a text: 0 outside fences, 1 inside, 2 a mark that opens one, 3 a mark that closes one."""
    out = []
    for text in texts.to_pylist():
        states, open_ = None, False
        if text is not None:
            states = []
            for line in text.split("\n"):
                if line.lstrip(" ").startswith("```"):
                    states.append(3 if open_ else 2)
                    open_ = not open_
                else:
                    states.append(int(open_))
        out.append(states)
    return pa.array(out, pa.list_(pa.int8()))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def anchor(text: Column) -> Column:
    """First 80 characters with white space collapsed: what a stored reference is checked against."""
    return F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, 80)


def title_of(text: Column) -> Column:
    """Text of the first level-one heading line; null without one."""
    found = F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def embedding_text(heading: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (heading, summary, content)])


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: x / norm)


def without_comment_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).startswith("<!--")), "\n")


def code_blocks(reply: Column) -> Column:
    """Bodies of all python and unlabelled fences, joined; the whole reply where there is none."""
    found = F.regexp_extract_all(reply, F.lit(r"(?s)```(?:python|py)?[ \t]*\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(reply)


#: a fenced block; put before a pattern as its first alternative, it passes over code
_CODE = r"(?ms)(^```.*?^```[^\n]*$)|"
# Component tags whose body is kept.
COMPONENTS = "Note Warning Tip Tabs Tab Callout Info Check Error AccordionGroup Accordion Frame CodeGroup".split()


def strip_mdx(text: Column) -> Column:
    """Outside fences: import, export and lone component lines out; a quoted expression leaves its text, any other one nothing."""
    lines = r"^(?:(?:import|export)\s[^\n]*|[ \t]*</?[A-Z][^>\n]*/?>[ \t]*)$\n?"
    quoted = r"\{(?:`([^`\n]*)`|\"([^\"\n]*)\"|'([^'\n]*)')\}"
    out = F.regexp_replace(F.regexp_replace(text, _CODE + lines, "$1"), _CODE + quoted, "$1$2$3$4")
    return F.regexp_replace(out, _CODE + r"\{[^{}\n]*\}", "$1")


def unwrap_components(text: Column) -> Column:
    """Bodies of known components in their place, however deep they stand, a tab's title as a heading; frames of only an image go."""
    out = F.regexp_replace(text, _CODE + r"<Frame\b[^>]*>\s*<img\b[^>]*/?>(?:</img>)?\s*</Frame>", "$1")
    out = F.regexp_replace(out, _CODE + r"<Tab\s[^>]*?title\s*=\s*[\"']([^\"']*)[\"'][^>]*>", "$1\n### $2\n\n")
    out = F.regexp_replace(out, r"(?m)^### \n\n", "")
    out = F.regexp_replace(out, _CODE + rf"</?(?:{'|'.join(COMPONENTS)})\b[^>]*>", "$1")
    return F.when(text.rlike("<[A-Z]"), out).otherwise(text)


def process_mdx(text: Column) -> Column:
    """Component documents as Markdown: components unwrapped, expressions gone, headings clean, blank runs one."""
    out = clean_headings(strip_mdx(unwrap_components(text)))
    return F.btrim(F.regexp_replace(out, r"\n(?:[ \t]*\n){2,}", "\n\n"), F.lit(" \n\t\r"))


def clean_headings(text: Column) -> Column:
    """Superscript marks out of heading lines."""
    return F.regexp_replace(text, r"(?m)^(#{1,6} .*?)<sup>.*?</sup>", "$1")


def first_sentence(text: Column, limit: int = 200) -> Column:
    found = F.regexp_extract(text, r"(?s)^([^.!?]*[.!?])", 1)
    s = F.when(found != "", found).otherwise(text)
    head = F.substring(s, 1, limit)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1))  # after the last space
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.when(at - 1 > 100, F.substring(head, F.lit(1), at - 1)).otherwise(head), F.lit("...")))


def heuristic_summary(content: Column, heading_path: Column) -> Column:
    """One line about a chunk: a definition of mostly-code chunks, else the first sentence under its heading.

    A chunk is mostly code if more than half of its lines, fence marks apart, stand in fences.
    """

    def summary(both: Column) -> Column:
        lines, states = both["lines"], both["states"]
        flagged = F.transform(lines, lambda x, i: F.struct(F.trim(x).alias("t"), F.get(states, i).alias("s"), i.alias("i")))
        kept = F.filter(flagged, lambda x: x["s"] < 2)
        code = F.filter(kept, lambda x: x["s"] == 1)
        last = F.array_size(states) - F.coalesce(F.array_position(F.reverse(states), F.lit(2).cast("tinyint")), F.lit(0))  # of the last opening mark
        define = F.get(F.filter(code, lambda x: (x["i"] > last) & x["t"].rlike(r"^(?:def |class |function |export )")), F.lit(0))["t"]
        prose = F.filter(kept, lambda x: (x["s"] == 0) & ~x["t"].startswith("#") & ~x["t"].rlike(r"^(?:[-*+]|\d+\.)\s+"))
        said = F.trim(F.array_join(F.transform(prose, lambda x: x["t"]), " "))
        heading = F.get(F.filter(kept, lambda x: x["t"].startswith("# ")), F.lit(0))["t"]
        whole = F.trim(F.array_join(lines, "\n"))
        spare = F.coalesce(F.substring(heading, F.lit(3), F.length(heading)), F.when(F.length(whole) > 200, F.concat(F.substring(whole, 1, 200), F.lit("..."))).otherwise(whole))
        text = F.when(said != "", first_sentence(said)).otherwise(spare)
        parts = F.split(F.coalesce(heading_path, F.lit("")), " / ")
        leaf = F.element_at(parts, -1)
        named = (
            F.when((F.size(parts) < 2) | (leaf == ""), text)
            .when(F.length(leaf) > 60, leaf)
            .when(F.startswith(text, leaf), text)
            .otherwise(F.concat(leaf, F.lit(": "), text))
        )
        return F.when((F.size(code) * 2 > F.size(kept)) & define.isNotNull(), define).otherwise(named)

    return F.transform(F.array(F.struct(F.split(content, "\n").alias("lines"), line_states(content).alias("states"))), summary)[0]  # the lines are split once
