"""Text indexes of documentation sites: link lists, concatenated pages, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def index_links(text: Column) -> Column:
    """``[label](http...)`` entries in order, repeats kept: ``array<struct<label, url>>``."""
    pattern = F.lit(r"\[([^\]]*)\]\((https?://[^)\s]+)\)")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("url"))


def split_concatenated(docs: DataFrame, item_id: str, text: str) -> DataFrame:
    """Pages of concatenated texts, ``Source: <url>`` lines between them: ``item_id, seq, url, content``.

    What stands before the first marker is dropped, as are pages left empty.  A URL that comes again keeps
    its first place and takes its last content.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\r?\n(?=Source: https?://\S+[ \t]*(?:\r?\n|$))")
    marked = docs.select(F.col(item_id).alias("item_id"), F.posexplode(parts).alias("pos", "part")).where("pos > 0")
    pages = marked.select(
        "item_id", "pos", F.regexp_extract("part", r"^Source: (https?://\S+)", 1).alias("url"), F.btrim(F.regexp_replace("part", r"^Source: https?://\S+[ \t]*\r?\n?", ""), F.lit(" \n\t\r")).alias("content")
    ).where("content != ''")
    best = pages.groupBy("item_id", "url").agg(F.min("pos").alias("pos"), F.max_by("content", "pos").alias("content"))
    w = Window.partitionBy("item_id").orderBy("pos")
    return best.select("item_id", F.row_number().over(w).alias("seq"), "url", "content")


def sitemap_urls(xml: Column) -> Column:
    """Locations of a sitemap or of an index of sitemaps, whatever its namespace."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc\s*>\s*(.*?)\s*</(?:\w+:)?loc\s*>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"<(?:\w+:)?sitemapindex[\s>]")


def collected_sitemap_pages(sitemaps: DataFrame, starts: DataFrame, max_fetches: int = 100) -> DataFrame:
    """Pages ``(start, page)`` that the sitemaps ``(start, url)`` of each start list, those in indexes of sitemaps followed.

    ``sitemaps (url, xml)`` is what can be fetched; others and blank ones are passed over.  A start reads each sitemap
    once, and ``max_fetches`` of them at most, level by level in order of URL.
    """
    held = written(sitemaps.where("xml is not null").select("url", is_sitemap_index(F.col("xml")).alias("nested"), F.explode(F.array_distinct(sitemap_urls(F.col("xml")))).alias("loc")))
    frontier = written(starts.select("start", "url").distinct())
    seen = frontier
    pages = None
    while True:
        listed = written(frontier.join(held, "url").select("start", "nested", "loc"))
        found = listed.where("not nested").select("start", F.col("loc").alias("page"))
        pages = found if pages is None else pages.union(found)
        have = seen.groupBy("start").agg(F.count(F.lit(1)).alias("have"))
        new = listed.where("nested").select("start", F.col("loc").alias("url")).distinct().join(seen, ["start", "url"], "left_anti")
        n = F.row_number().over(Window.partitionBy("start").orderBy("url"))
        frontier = written(new.withColumn("n", n).where(F.col("n") <= max_fetches).join(have, "start").where(F.col("n") + F.col("have") <= max_fetches).select("start", "url"))
        if frontier.isEmpty():
            return pages.distinct()
        seen = seen.union(frontier)


def preferred_sitemap_pages(sitemaps: DataFrame, starts: DataFrame) -> DataFrame:
    """Pages ``(start, page)`` of the first of each start's ``candidates`` (an array of URLs in order of preference) that lists any."""
    each = starts.select("start", F.posexplode("candidates").alias("pos", "url")).withColumn("at", F.struct("start", "pos"))
    got = collected_sitemap_pages(sitemaps, each.select(F.col("at").alias("start"), "url"))
    best = got.groupBy("start.start").agg(F.min("start.pos").alias("pos"))
    return got.select("start.start", "start.pos", "page").join(best, ["start", "pos"]).select("start", "page")
