"""Line checks over Markdown, outside fenced code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_states

# What a clean page does not have, line by line.
CHECKS = {
    "html tag": r"</?(?:div|span|p|br|table|tr|td|img)\b[^>]*>",
    "component tag": r"</?[A-Z][A-Za-z]*\b[^>]*>",
    "import line": r"^(?:import|export)\s",
    "pilcrow": "¶",
    "empty link": r"\[[^\]]*\]\(\s*\)",
    "expression": r"\{[^{}]*\}",
    "entity": r"&(?:[a-z]+|#\d+);",
    "tab": r"\t",
}


def lint(docs: DataFrame, item_id: str, text: str, checks: dict[str, str] | None = None) -> DataFrame:
    """``item_id, line_no, finding`` for every line outside fences that a check finds; lines count from 1."""
    split = docs.select(F.col(item_id).alias("item_id"), F.split(F.col(text), "\r?\n").alias("lines"), line_states(F.col(text)).alias("states")).where("lines is not null")
    prose = F.transform("lines", lambda x, i: F.when(F.get("states", i) == 0, x))
    each = split.select("item_id", F.posexplode(prose).alias("i", "line")).where("line is not null")
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in (checks or CHECKS).items()]))
    return each.select("item_id", (F.col("i") + 1).alias("line_no"), F.explode(found).alias("finding"))
