"""From pages to the records of a pack: chunks with dense ids, hashes, sizes and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import chunk_markdown
from ..functions.text import content_hash, heuristic_summary, normalize_text
from ..operators.ranks import numbered_in_order
from ..session import written


def build_chunks(pages: DataFrame, max_tokens: int = 800, min_tokens: int = 20, latest: tuple[str, ...] = ()) -> DataFrame:
    """Chunk records of ``pages (package, version, url, label, text)``; ids count from 1 in each pack, by URL and place.

    Of pages repeated under one URL the text that is last by the columns ``latest`` holds, the largest among equals;
    null and blank texts give no chunks and replace no text.  Rows without a package belong to no pack and give no
    chunks: name one for them before.
    """
    held = pages.where("package is not null").where(F.col("text").rlike(r"\S"))
    once = held.groupBy("package", "version", "url").agg(F.max(F.struct(*latest, "text", "label")).alias("p"))
    cut = once.select("package", "version", "url", F.posexplode_outer(chunk_markdown(F.col("p.text"), F.col("p.label"), max_tokens, min_tokens)).alias("seq", "c")).where("c is not null")
    clean = written(cut.select("package", "version", "url", "seq", "c.heading_path", normalize_text(F.col("c.content")).alias("content")))
    ids = numbered_in_order(clean, ["package", "version"], ["url"], "seq", "id")
    return ids.select(
        "package",
        "version",
        "id",
        F.col("url").alias("source_url"),
        "heading_path",
        "content",
        content_hash(F.col("content")).alias("content_hash"),
        F.expr("length(content) div 4").alias("token_count"),
        heuristic_summary(F.col("content"), F.col("heading_path")).alias("summary"),
    )


def with_cached_summaries(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` with a missing summary taken from ``cache (content_hash, cached)``; of several the smallest."""
    one = cache.where("content_hash is not null and cached is not null").groupBy("content_hash").agg(F.min("cached").alias("cached"))
    return chunks.join(one, "content_hash", "left").withColumn("summary", F.coalesce("summary", "cached")).drop("cached")


def enriched(chunks: DataFrame, cache: DataFrame, make: Callable[[list[str]], list[str]]) -> DataFrame:
    """New cache rows ``(content_hash, cached)`` for the contents the cache lacks, each content once.

    ``make`` turns a batch of texts into as many summaries, a model's client, say; it runs in the tasks.  An
    empty one fails the job.
    """

    def run(batches):
        for batch in batches:
            made = make(batch["content"].tolist())
            if len(made) != len(batch) or not all(made):
                raise ValueError("a summary is missing or empty")
            yield batch.assign(cached=made)[["content_hash", "cached"]]

    missing = chunks.where("content_hash is not null").join(cache.select("content_hash"), "content_hash", "left_anti")
    todo = missing.groupBy("content_hash").agg(F.min("content").alias("content"))
    return todo.mapInPandas(run, "content_hash string, cached string")
