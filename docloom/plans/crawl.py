"""Breadth-first crawl over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import dedup_key, in_scope, is_asset, is_noise, links, resolved
from ..session import written


def link_table(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Distinct ``(from_key, to_url, to_key)`` of the links between pages that lead to documentation pages."""
    raw = pages.select(F.col(url).alias("base"), F.explode(links(F.col(html))).alias("href"))
    out = raw.select("base", resolved(F.col("base"), F.col("href")).alias("to_url"))
    return (
        out.select(dedup_key(F.col("base")).alias("from_key"), "to_url", dedup_key(F.col("to_url")).alias("to_key"))
        .where(F.col("to_key").isNotNull() & F.col("from_key").isNotNull() & ~is_noise(F.col("to_url")) & ~is_asset(F.col("to_url")))
        .distinct()
    )


def crawl(
    pages: DataFrame, seeds: DataFrame, *, url: str, html: str | None = None, table: DataFrame | None = None, fetched_only: bool = True, max_pages: int | None = None
) -> DataFrame:
    """Pages reached from ``seeds (url[, start])`` inside each start's folder: ``start, key, depth`` (of the first reach), ``truncated``.

    A seed without a start is its own.  One join a level, until a level reaches nothing new; the frontier is what the
    level reached for the first time.  Levels are written to the shared folder, so that a level's plan does not
    hold those before it.  ``pages`` is what can be fetched, and what is reached if ``fetched_only``; ``table`` its links,
    taken from ``html`` if not given.  ``max_pages`` is a limit on each start's pages, taken in order of depth and key;
    ``truncated`` says that a start had more.
    """
    known = pages.select(dedup_key(F.col(url)).alias("key")).where("key is not null").distinct()
    links_ = table if table is not None else link_table(pages, url, html)
    links_ = written(links_.join(known.withColumnRenamed("key", "to_key"), "to_key", "left_semi") if fetched_only else links_)
    start = F.col("start") if "start" in seeds.columns else F.col(url)
    first = seeds.select(start.alias("start"), dedup_key(F.col(url)).alias("key")).where("key is not null").distinct()

    def accepted(new: DataFrame, before: DataFrame | None) -> DataFrame:
        """The level's pages within the limit; the first one beyond it is kept too, to tell that there are more."""
        if max_pages is None:
            return written(new)
        have = before.groupBy("start").agg(F.count(F.lit(1)).alias("have")) if before is not None else None
        left = new.join(have, "start", "left").withColumn("have", F.coalesce("have", F.lit(0))) if have is not None else new.withColumn("have", F.lit(0))
        ranked = left.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("key"))).where(F.col("n") <= max_pages + 1)
        return written(ranked.where(F.col("n") + F.col("have") <= max_pages + 1).drop("n", "have"))

    frontier = accepted(first.join(known, "key", "left_semi").select("start", "key").withColumn("depth", F.lit(0)), None)
    seen = frontier
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(links_, frontier["key"] == links_["from_key"]).where(in_scope(F.col("to_url"), F.col("start")))
        new = step.select("start", F.col("to_key").alias("key")).distinct().join(seen, ["start", "key"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = accepted(new, seen)
        seen = seen.unionByName(frontier)
    if max_pages is None:
        return seen.withColumn("truncated", F.lit(False))
    n = F.row_number().over(Window.partitionBy("start").orderBy("depth", "key"))
    over = seen.groupBy("start").agg((F.count(F.lit(1)) > max_pages).alias("truncated"))
    return seen.withColumn("n", n).where(F.col("n") <= max_pages).drop("n").join(over, "start")
