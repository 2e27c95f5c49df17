"""Documentation files in a folder as a table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_to_markdown
from ..functions.text import strip_mdx
from ..functions.urls import HTML_TYPES


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown and HTML files below ``folder``: ``path`` (relative), ``text`` (HTML as Markdown).

    Files are read as UTF-8; one that is not valid has a null text.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^.*?" + root.replace(".", r"\.") + "/", "")
    found = files.select(path.alias("path"), F.col("content").alias("raw")).where(F.lower("path").rlike(r"\.(md|html?)$"))
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string"))
    decoded = found.select("path", text.alias("text"))
    return decoded.select("path", F.when(F.lower("path").endswith(".md"), F.col("text")).otherwise(html_to_markdown("text")).alias("text"))


def routed_pages(fetched: DataFrame, url: str, text: str, content_type: str) -> DataFrame:
    """Fetched pages as Markdown: component syntax stripped from ``.md`` URLs and plain text, HTML converted; other types out."""
    md = F.lower(F.regexp_replace(F.col(url), r"[?#].*$", "")).endswith(".md") | (F.col(content_type) == "text/plain")
    kept = fetched.where(md | F.coalesce(F.col(content_type), F.lit(HTML_TYPES[0])).isin(HTML_TYPES))
    return kept.withColumn("markdown", F.when(md, strip_mdx(F.col(text))).otherwise(html_to_markdown(F.col(text))))
