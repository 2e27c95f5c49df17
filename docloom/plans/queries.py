"""Queries of the engine's own operators over the given tables, with the SQL that checks them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.chunks import chunk_markdown
from ..functions.html import html_to_markdown
from ..operators import evaluation, fusion, packs, search
from ..operators.lint import CHECKS, lint
from ..operators.ranks import order_statistics
from ..session import shared_dir, table, written
from ..sources.indexes import preferred_sitemap_pages, split_concatenated
from ..sources import archives
from ..sources.files import routed_pages
from .build import build_chunks, with_cached_summaries
from .crawl import crawl, link_table

STEP = 50  # queries are the rows whose id this divides, searched against all rows


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    return c.select(F.col("id").alias("chunk_id"), "package", "version", "heading_path", "summary", "content", "content_hash", "source_url")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks once each: rows delivered again are equal but for the time."""
    return _chunk_rows(spark, sf_dir).distinct()


def _leaf() -> F.Column:
    return F.element_at(F.split("heading_path", " / "), -1)


#: indexes built by this application and their queries, by the table's files: built once, searched many times
_BUILT: dict[tuple, tuple[search.Index, DataFrame]] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(at)))


def _index(spark: SparkSession, sf_dir: str) -> tuple[search.Index, DataFrame]:
    key = (spark.sparkContext.applicationId, _files(spark, f"{sf_dir}/chunks.parquet"))
    if key not in _BUILT:
        rows = _chunk_rows(spark, sf_dir)
        own = rows.where(F.col("chunk_id") % STEP == 0).select(F.col("chunk_id").alias("query_id"), _leaf().alias("query")).distinct()
        _BUILT[key] = (search.stored_index(rows), written(own))
    return _BUILT[key]


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "packages")


# -- index and search ---------------------------------------------------------------------------------------


def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vocabulary(_index(spark, sf_dir)[0])


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    return search.best(index, queries, 10)


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    return search.best(index, queries, 10, "all")


def search_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    return search.best(index, queries, 10, without=queries.withColumn("query", F.lit("python release")))


def search_governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    packages = _packages(spark, sf_dir)
    found = search.best(index, queries, 10, among=search.permitted(index, packages))
    return search.governed(found, index, packages).select("query_id", "chunk_id", "score", "rank", "package", "version", "lifecycle_warning")


def search_in_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    packages, only = _packages(spark, sf_dir), ["harborkit", "quillbase"]
    found = search.best(index, queries, 10, among=search.permitted(index, packages, only))
    return search.governed(found, index, packages, only).select("query_id", "chunk_id", "score", "rank", "package")


def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    best = search.best(index, queries, 10).join(index.chunks.select("chunk_id", "summary"), "chunk_id")
    return search.within_budget(best, F.expr("length(summary) div 4"), 60).select("query_id", "chunk_id", "rank", "spent")


def fetch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    got = search.fetch(index, queries.select(F.col("query_id").alias("chunk_id")), _packages(spark, sf_dir))
    return got.select("chunk_id", "package", "version", "lifecycle_state", "heading_path", F.sha2("content", 256).alias("content_sha"), "score")


def packages_not_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.not_indexed(table(spark, sf_dir, "pages").select("package").where("package is not null"), _packages(spark, sf_dir))


# -- vectors and fusion -------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return fusion.cosine_top(
        e.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), fusion.DEPTH
    )


def cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("rank <= 10")


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked chunks by vector: the n vectors of the table belong to the chunks by id modulo n."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    rows = _index(spark, sf_dir)[0].chunks.select(F.col("chunk_id").alias("id"), F.pmod("chunk_id", F.lit(n)).alias("vec"))
    queries = rows.where(F.col("id") % STEP == 0).withColumnRenamed("id", "query_id")
    return fusion.cosine_top_shared(queries, rows, e.withColumnRenamed("vec_id", "vec"), fusion.DEPTH)


def _lexical(spark: SparkSession, sf_dir: str, mode: str = "any", k: int = fusion.DEPTH) -> DataFrame:
    return search.best(*_index(spark, sf_dir), k, mode).select("query_id", F.col("chunk_id").alias("id"), "rank")


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rank_fusion([(_lexical(spark, sf_dir), 1.0), (_chunk_vectors(spark, sf_dir), 1.0)]).where("rank <= 20")


def rank_fusion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rank_fusion([(_lexical(spark, sf_dir), 3.0), (_chunk_vectors(spark, sf_dir), 1.0)]).where("rank <= 20")


def gated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rank_fusion([(_lexical(spark, sf_dir), 1.0), (_chunk_vectors(spark, sf_dir), 1.0)])
    return fusion.gated(written(_lexical(spark, sf_dir, "all")), fused).where("rank <= 20")


def fusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of each way to rank, and how many queries the strict search settles alone.

    All ways are ranked and scored in one pass: a plan for each way shuffles the same lists again and takes more of the driver's memory.
    """
    lists = _lexical(spark, sf_dir), _lexical(spark, sf_dir, "all"), _chunk_vectors(spark, sf_dir)
    lexical, strict, vectors = (written(x.select("query_id", "id", "rank")) for x in lists)
    own, classes = _classes(spark, sf_dir)
    own = written(own)
    gold = written(classes.join(own.select("class").distinct(), "class", "left_semi").select("id", "class"))
    settled = strict.select("query_id").distinct().withColumn("settled", F.lit(True))
    counts = gold.groupBy("class").agg(F.count(F.lit(1)).alias("n_gold"))
    sizes = written(own.join(counts, "class").join(settled, "query_id", "left").select("query_id", "n_gold", "settled"))

    ranked = fusion.fused_ranks({"lexical": lexical, "vector": vectors}, {f"fused {w}": (w, 1.0) for w in (1, 2, 3)})
    ranked = ranked.unionByName(strict.withColumnRenamed("rank", "strict"), allowMissingColumns=True)
    hits = written(evaluation.class_hits(ranked, own, gold)).join(sizes.select("query_id", "settled"), "query_id")
    ways = {way: F.col(way) for way in ("lexical", "vector", "fused 1", "fused 2", "fused 3")} | {"gated": F.when(F.col("settled"), F.col("strict")).otherwise(F.col("fused 1"))}
    each = F.explode(F.array(*[F.struct(F.lit(way).alias("way"), rank.alias("rank")) for way, rank in ways.items()]))
    names = F.explode(F.array(*map(F.lit, ways))).alias("way")
    found = hits.select("query_id", each.alias("w")).select("query_id", "w.*").where("rank is not null")
    scored = evaluation.metrics_of(found, sizes.select("query_id", "n_gold", names), by=("way", "query_id"))
    kinds = ("recall_1", "recall_5", "recall_20", "mrr", "ndcg_10")
    means = scored.groupBy("way").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in kinds])
    n_gated = settled.count()
    rows = spark.range(1).select(names).join(means, "way", "left")  # a row a way, whatever the tables hold
    return rows.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), *kinds, "way", F.when(F.col("way") == "gated", F.lit(n_gated).cast("long")).alias("n_gated"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", T.unit_vector(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.posexplode("u").alias("pos", "u")).select("vec_id", "pos", F.round("u", 6).alias("u"))


# -- evaluation ---------------------------------------------------------------------------------------------


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Content classes of the queries' chunks and of all chunks: gold is every chunk with the content of the query's chunk."""
    classes = _index(spark, sf_dir)[0].chunks.select(F.col("chunk_id").alias("id"), F.sha2("content", 256).alias("class"))
    return classes.where(F.col("id") % STEP == 0).withColumnRenamed("id", "query_id"), classes


def _scored(spark: SparkSession, sf_dir: str, mode: str = "any") -> DataFrame:
    return evaluation.class_metrics(_lexical(spark, sf_dir, mode, 20), *_classes(spark, sf_dir))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs_of = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "package")
    scored = _scored(spark, sf_dir).join(packs_of, "query_id").withColumn("rounded", (F.col("n_gold") > 1).cast("string"))
    return evaluation.slices(scored.withColumnRenamed("rounded", "has_copies"), ["package", "has_copies"], ["recall_5", "mrr", "ndcg_10"])


def question_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _index(spark, sf_dir)
    ranks = search.best(index, queries, 50).where("chunk_id = query_id").select("query_id", "rank")
    own = index.chunks.where(F.col("chunk_id") % STEP == 0).select(
        F.col("chunk_id").alias("query_id"), F.round(T.jaccard(T.term_set(_leaf()), T.term_set(F.col("content"))), 9).alias("overlap")
    )
    return own.join(ranks, "query_id", "left").select("query_id", "rank", "overlap", evaluation.tier(F.col("rank"), F.col("overlap")).alias("tier"))


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _index(spark, sf_dir)[0].chunks.select(F.col("chunk_id").alias("query_id"), "source_url", "heading_path")
    return question_tiers(spark, sf_dir).where("tier is not null").join(places, "query_id").select("query_id", "source_url", "heading_path", "tier")


def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.question_set(written(_tiered(spark, sf_dir)), "query_id").select("question_id", "query_id", "tier")


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_ids(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def tier_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 by tier, of any-of and of all-of search, and the gap between them."""
    tiers = written(question_tiers(spark, sf_dir).where("tier is not null").select("query_id", "tier"))
    by = lambda mode, name: _scored(spark, sf_dir, mode).join(tiers, "query_id").groupBy("tier").agg(F.round(F.avg("recall_5"), 4).alias(name))
    return by("any", "any_5").join(by("all", "all_5"), "tier").withColumn("gap", F.round(F.col("any_5") - F.col("all_5"), 4))


def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks fetched by id, thirty-two ids a request, in order of id, as many whole ones as fit a budget."""
    index, queries = _index(spark, sf_dir)
    got = search.fetch(index, queries.select(F.col("query_id").alias("chunk_id")), _packages(spark, sf_dir))
    sized = got.select(F.floor(F.col("chunk_id") / (32 * STEP)).alias("query_id"), "chunk_id", F.expr("length(content) div 4").alias("cost")).withColumn("rank", F.col("chunk_id"))
    return search.within_budget(sized, F.col("cost"), 2000).select(F.col("query_id").alias("request"), "chunk_id", "spent")


def imported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the ids their pages get in a store of all packs."""
    pages = packs.latest(table(spark, sf_dir, "pages").where("package is not null").select("id", "package", "version", "url", "ingested_at"), ["id"], "ingested_at")
    chunks = table(spark, sf_dir, "chunks").select("id", "package", "version", "page_id").distinct()
    return packs.remapped(chunks, pages).select("id", "package", "version", "page_id", "store_page_id")


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the sections cut from them, held against each other both ways."""
    return packs.reconciled(table(spark, sf_dir, "raw_chunks").select("page_id"), table(spark, sf_dir, "pages").select(F.col("id").alias("page_id")), ["page_id"])


def summary_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.statement_findings(_chunks(spark, sf_dir).where("summary is not null"), "chunk_id", "summary", "package")


def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each pack, different ones, and the first five with how many more there are."""
    c = _chunks(spark, sf_dir).where("heading_path is not null")
    counts = c.groupBy("package", "version").agg(F.count(F.lit(1)).alias("n_headings"), F.count_distinct("heading_path").alias("n_different"))
    first = packs.first_of(c.select("package", "version", "heading_path").distinct(), ["package", "version"], "heading_path", 5)
    return counts.join(first, ["package", "version"]).select("package", "version", "n_headings", "n_different", F.array_join("first", " | ").alias("first"), "more")


def links_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target of a page's links once, at its first place."""
    return page_links(spark, sf_dir).where("target is not null").groupBy("fetch_id", "target").agg(F.min("pos").alias("pos"))


def verified_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs as archives in the shared folder, and what the checks of these say."""
    fields = ["id", "page_id", "heading_path", "content", "content_hash", "summary", "token_count", "source_url", "source_commit"]
    pages = packs.latest(table(spark, sf_dir, "pages").select("id", "package", "version", "url", "title", F.col("content_hash"), "ingested_at"), ["id"], "ingested_at")
    folder = f"{shared_dir(spark).rstrip('/').removeprefix('file://').removeprefix('file:')}/packs-{uuid.uuid4().hex}"
    os.makedirs(folder)
    made = written(archives.write_packs(table(spark, sf_dir, "chunks"), folder, fields, pages))
    found = archives.verified(spark, "file://" + folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.coalesce("reason", F.lit("passed")).alias("state"))
    return made.join(found.withColumn("file", F.url_decode("file")), "file", "left").select("package", "version", "n_chunks", F.coalesce("error", "state").alias("state"))


def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of what a document's chunks hold, without white space and headings that nothing follows."""
    per = markdown_chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["content"]), "\n")
    bare = F.regexp_replace(F.regexp_replace(text, _TAIL, ""), _BLANK, "")
    return per.select("doc_id", bare.alias("b")).where("b != ''").select("doc_id", F.sha2("b", 256).alias("sha"))


_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: heading lines at the very end
_TAIL = rf"(?:(?:^|\n){_BLANK}*#{{1,6}}(?:[ \t][^\n]*)?)+{_BLANK}*\z"


def reference_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' own places as stored references, held against all chunks, with every seventh hash forgotten."""
    c = _chunks(spark, sf_dir).withColumn("anchor", T.anchor(F.col("content")))
    stored = F.when(F.col("chunk_id") % 7 == 0, F.lit("sha256:gone")).otherwise(F.col("content_hash"))
    heading = F.when(F.col("chunk_id") % 9 == 0, F.concat("heading_path", F.lit("?"))).otherwise(F.col("heading_path"))
    gold = c.select(F.col("chunk_id").alias("ref_id"), "source_url", heading.alias("heading_path"), stored.alias("content_hash"), "anchor")
    return evaluation.reference_drift(gold, c)


def _moved_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks, and their places as references stored under another host, without a version prefix, or under a URL that is gone."""
    c = written(_chunks(spark, sf_dir))
    n, url = F.col("chunk_id"), F.col("source_url")
    moved = (
        F.when(n % 5 == 1, F.regexp_replace(url, "^https?://[^/]+", "http://old.example"))
        .when(n % 5 == 2, F.regexp_replace(url, "^(https?://[^/]+)/[^/]+/", "$1/"))
        .when(n % 5 == 3, F.lit("https://gone.example/nowhere/at/all"))
        .otherwise(url)
    )
    gold = c.select(
        n.alias("ref_id"),
        moved.alias("source_url"),
        F.when(n % 9 == 0, F.concat("heading_path", F.lit("?"))).otherwise(F.col("heading_path")).alias("heading_path"),
        F.when(n % 4 > 0, F.col("package")).alias("package"),
        F.when(n % 7 == 0, "sha256:gone").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(n % 11 == 0, "no such words").otherwise(T.anchor(F.col("content"))).alias("anchor"),
    )
    return gold, c


def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reference_cascade(*_moved_references(spark, sf_dir))


def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same references by package, heading and the path behind the host."""
    gold, c = _moved_references(spark, sf_dir)
    return evaluation.gold_chunks(gold.withColumn("source_path", F.regexp_replace("source_url", "^https?://[^/]+/", "")), c)


# -- packs --------------------------------------------------------------------------------------------------


def pack_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.pack_hashes(table(spark, sf_dir, "chunks"))


def pack_tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.pack_tree_hashes(table(spark, sf_dir, "chunks"))


def pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.pack_counts(table(spark, sf_dir, "chunks"))


def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _chunks(spark, sf_dir).select("package", F.expr("length(content) div 4").alias("tokens"))
    return packs.size_stats(sizes, ["package"], "tokens", warn=800)


def oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.oversized(table(spark, sf_dir, "chunks"))


def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.duplicate_contents(table(spark, sf_dir, "chunks"))


def hash_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.hash_mismatches(_chunks(spark, sf_dir), "content", "content_hash").select("chunk_id", "package", "version")


def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").select("id", "page_id", "heading_path", "content", "content_hash", "token_count", "source_url").distinct()
    checks = {
        "page_id": F.col("page_id") >= 1,
        "heading_path": F.length("heading_path") > 0,
        "content": F.length("content") > 0,
        "content_hash": F.col("content_hash").rlike("^sha256:[a-f0-9]{64}$"),
        "token_count": F.col("token_count") == F.expr("length(content) div 4"),
        "source_url": F.col("source_url").rlike("^https?://"),
    }
    return packs.violations(c, checks, ["id"])


def latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("id", "package", "version", "url", "title", "ingested_at", "deleted_at")
    last = packs.latest(p, ["id"], "ingested_at")
    return last.select("id", "package", "version", "url", "title", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("ingested_at", "deleted_at")])


def lock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _packages(spark, sf_dir)
    lock = table(spark, sf_dir, "chunks").select(F.col("package").alias("name"), "version").distinct().join(p.select("name", "version", F.col("normalized_content_hash").alias("pack_digest")).distinct(), ["name", "version"], "left")
    digests = p.groupBy("name", "version").agg(F.max("pack_digest").alias("d"))
    lock = lock.join(digests, ["name", "version"], "left").select("name", "version", F.when(F.length("name") % 2 == 0, F.col("d")).otherwise(F.col("pack_digest")).alias("pack_digest"))
    return packs.lock_state(lock, p)


# -- text and URLs ------------------------------------------------------------------------------------------


def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", T.title_of(t).alias("heading"), T.token_estimate(t).alias("tokens"), T.content_hash(t).alias("hash"), F.sha2(T.embedding_text(F.col("title"), F.col("source"), t), 256).alias("embedding_sha"))


def mdx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crawled_pages")
    return c.select("crawl_id", F.sha2(T.clean_headings(T.strip_mdx(T.without_comment_lines(F.col("content")))), 256).alias("sha")).distinct()


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("normal"))
    return d.select("doc_id", T.content_hash(F.col("normal")).alias("hash"), F.length("normal").alias("n_chars"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", T.heuristic_summary(F.col("content"), F.col("heading_path")).alias("summary"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cut = d.select("doc_id", F.posexplode_outer(chunk_markdown(F.col("text"), F.col("source"))).alias("seq", "c")).where("c is not null")
    return cut.select("doc_id", "seq", "c.heading_path", "c.content", T.content_hash(F.col("c.content")).alias("content_hash"))


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "fetched_html").where(F.coalesce(F.col("content_type"), F.lit(U.HTML_TYPES[0])).isin(U.HTML_TYPES))
    return h.select("fetch_id", html_to_markdown("text").alias("markdown"))


def html_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the letters of each page's Markdown, without link targets."""
    shown = F.regexp_replace(F.regexp_replace("markdown", r"\]\([^)]*\)", ""), "[^A-Za-z]+", "")
    return html_markdown(spark, sf_dir).select("fetch_id", F.sha2(shown, 256).alias("sha"))


def url_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select("url").where("url is not null").distinct()
    return p.select(
        "url",
        U.canonical_url(u).alias("canonical"),
        U.dedup_key(u).alias("dedup_key"),
        U.scope_of(u).alias("scope"),
        U.label_of(u).alias("label"),
        U.is_noise(u).alias("noise"),
        U.is_asset(u).alias("asset"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "fetched_html").select("fetch_id", F.posexplode(U.links(F.col("text"))).alias("pos", "href"), F.col("final_url"))
    return h.select("fetch_id", "pos", "href", U.resolved(F.col("final_url"), F.col("href")).alias("target"))


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_table(table(spark, sf_dir, "fetched_html"), "final_url", "text")


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fetched and crawled pages, the hosts' fetched pages as seeds under the host's root, and the links of both kinds of text."""
    h, c = table(spark, sf_dir, "fetched_html"), table(spark, sf_dir, "crawled_pages")
    pages = h.select(F.col("final_url").alias("url")).union(c.select("url"))
    seeds = h.select(F.concat(F.lower(F.regexp_extract("final_url", "^(?i)(https?://[^/?#]+)", 1)), F.lit("/")).alias("start"), F.col("final_url").alias("url"))
    marked = c.select("url", F.array_join(F.transform(F.regexp_extract_all("content", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)), lambda u: F.concat(F.lit("<a href=\""), u, F.lit("\">"))), "").alias("text"))
    return pages, seeds, link_table(h.select(F.col("final_url").alias("url"), "text").union(marked), "url", "text")


def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, seeds, links = _site(spark, sf_dir)
    return crawl(pages, seeds, url="url", table=links, fetched_only=False).select("start", "key", "depth")


def crawl_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, seeds, links = _site(spark, sf_dir)
    return crawl(pages, seeds, url="url", table=links, fetched_only=False, max_pages=12)


def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages listed by the sitemaps of each host: its pages found by sitemap, a sitemap a folder and an index of them, as the site would serve them."""
    c = table(spark, sf_dir, "crawled_pages").where("discovered_via = 'sitemap'").select("url").distinct()
    host, folder = F.regexp_extract("url", "^(https?://[^/]+)/([^/?#]*)", 1), F.regexp_extract("url", "^(https?://[^/]+)/([^/?#]*)", 2)
    loc = lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    parts = c.select(host.alias("host"), folder.alias("folder"), "url")
    maps = parts.groupBy("host", "folder").agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_set(loc(F.col("url")))), ""), F.lit("</urlset>")).alias("xml"))
    maps = maps.select("host", F.concat("host", F.lit("/"), "folder", F.lit("/sitemap.xml")).alias("url"), "xml")
    index = maps.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))), "").alias("x"))
    every = maps.select("url", "xml").union(index.select(F.concat("host", F.lit("/sitemap.xml")), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>"))))
    starts = index.select(F.concat("host", F.lit("/")).alias("start"), F.array(F.concat("host", F.lit("/nowhere/sitemap.xml")), F.concat("host", F.lit("/sitemap.xml"))).alias("candidates"))
    return preferred_sitemap_pages(every, starts)


def concatenated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crawled_pages").select("crawl_id", "url", "content").distinct()
    text = F.concat(F.lit("About\nSource: "), "url", F.lit("\nold text\nSource: https://other.example/\nmore\nSource: "), "url", F.lit("\n"), "content")
    got = split_concatenated(c.select("crawl_id", text.alias("text")), "crawl_id", "text")
    return got.select("item_id", "seq", "url", F.sha2("content", 256).alias("content_sha"))


# -- building and checking ----------------------------------------------------------------------------------


def built_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk records of the crawled pages, each package as one pack; pages without a package are a pack named by their host.

    Of a page fetched again the last text holds, by time, then by crawl_id.
    """
    c = table(spark, sf_dir, "crawled_pages")
    url = U.canonical_url(F.col("url"))
    pack = F.coalesce("package", F.concat(F.lit("host:"), F.coalesce(F.regexp_extract(url, "^https?://([^/]+)", 1), F.lit(""))))
    pages = c.select(pack.alias("package"), F.lit("crawl").alias("version"), url.alias("url"), U.label_of(F.col("url")).alias("label"), T.process_mdx(F.col("content")).alias("text"), "fetched_at", "crawl_id")
    return build_chunks(pages, latest=("fetched_at", "crawl_id"))


def built_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have chunk records, and whether the ids of their pack run from 1 without a gap."""
    built = written(built_chunks(spark, sf_dir).select("package", "source_url", "id"))
    dense = built.groupBy("package").agg(((F.min("id") == 1) & (F.max("id") == F.count_distinct("id")) & (F.count_distinct("id") == F.count(F.lit(1)))).alias("dense"))
    return built.select("package", "source_url").distinct().join(dense, "package")


def routed_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = routed_pages(table(spark, sf_dir, "fetched_html"), "final_url", "text", "content_type")
    return got.select("fetch_id", T.content_hash(T.normalize_text(F.col("markdown"))).alias("hash"), F.length("markdown").alias("n_chars"))


def cached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing summaries from other chunks with the same content."""
    c = _chunks(spark, sf_dir)
    got = with_cached_summaries(c, c.select("content_hash", F.col("summary").alias("cached")))
    return got.select("chunk_id", F.md5(F.coalesce("summary", F.lit(""))).alias("summary_md5"))


def sampled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.sampled(_chunks(spark, sf_dir), 200).select("chunk_id", "package", F.substring("content", 1, 2000).alias("content"))


def markdown_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint(table(spark, sf_dir, "crawled_pages").select("crawl_id", "content").distinct(), "crawl_id", "content")
    return found.groupBy("finding").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("item_id").alias("n_pages"))


def event_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of the events' values by type, by the index rules of the latency report."""
    e = table(spark, sf_dir, "events")
    n = F.col("n")
    return order_statistics(e, ["event_type"], "value", {"least": F.lit(0), "p50": F.floor(n / 2), "p95": F.ceil(n * 95 / 100) - 1, "most": n - 1})


def event_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("stdev"))


def query_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that would make no good query: empty, of several lines, or of other than two to four terms."""
    q = _index(spark, sf_dir)[1]
    terms = F.size(T.query_terms(F.col("query")))
    return packs.violations(q, {"empty": F.length(F.trim("query")) > 0, "lines": ~F.col("query").contains("\n"), "terms": terms.between(2, 4)}, ["query_id"])


# -- SQL ----------------------------------------------------------------------------------------------------



def _tok(column: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({column}, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '{T.TOKEN}')"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CH = "ch AS (SELECT DISTINCT id AS chunk_id, package, version, heading_path, summary, content, content_hash, source_url FROM chunks)"
_MOVED = r"""c AS (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM ch),
g AS (SELECT chunk_id AS ref_id, CASE chunk_id % 5 WHEN 1 THEN regexp_replace(source_url, '^https?://[^/]+', 'http://old.example')
    WHEN 2 THEN regexp_replace(source_url, '^(https?://[^/]+)/[^/]+/', '\1/') WHEN 3 THEN 'https://gone.example/nowhere/at/all' ELSE source_url END AS source_url,
  CASE WHEN chunk_id % 9 = 0 THEN heading_path || '?' ELSE heading_path END AS heading_path, CASE WHEN chunk_id % 4 > 0 THEN package END AS package,
  CASE WHEN chunk_id % 7 = 0 THEN 'sha256:gone' ELSE content_hash END AS content_hash,
  CASE WHEN chunk_id % 11 = 0 THEN 'no such words' ELSE substring(regexp_replace(trim(content), '\s+', ' ', 'g'), 1, 80) END AS anchor FROM ch)"""
_LEAF = "string_split(heading_path, ' / ')[-1]"
_INDEX = f"""{_CH},
tok AS ({' UNION ALL '.join(f"SELECT chunk_id, unnest({_tok(c)}) AS term, {w} AS w FROM ch" for c, w in search.WEIGHTS.items())}),
dl AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY 1),
post AS (SELECT term, chunk_id, sum(w)::DOUBLE AS f, any_value(dl) AS dl FROM tok JOIN dl USING (chunk_id) GROUP BY 1, 2),
stats AS (SELECT (SELECT count(*) FROM ch) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM ch) AS avgdl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, avgdl FROM df, stats),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT chunk_id AS query_id, unnest({_tok(_LEAF)}) AS term FROM ch WHERE chunk_id % {STEP} = 0)
  WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
need AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1),
m AS (SELECT query_id, chunk_id, sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS hits
  FROM qt JOIN idf USING (term) JOIN post USING (term) GROUP BY 1, 2)"""


def _words(column: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9]{{2,}}')))"


def _top(source: str, k: int, more: str = "") -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(score, 6) AS score{more} FROM {source})) WHERE rank <= {k})"""


_STATE = """(SELECT * FROM (SELECT name, version, arg_max(lifecycle_state, indexed_at || ' ' || lifecycle_state) AS lifecycle_state FROM packages GROUP BY 1, 2)
  WHERE lifecycle_state <> 'revoked')"""
_GOV = f"""(SELECT m.*, c.package, c.version, CASE WHEN k.lifecycle_state = 'deprecated' THEN 'This package is deprecated' END AS lifecycle_warning
  FROM m JOIN ch c USING (chunk_id) JOIN {_STATE} k
  ON k.name = c.package AND k.version = c.version)"""
_VEC = f"""vec AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % {STEP} = 0)) WHERE rank <= 100)"""


_CHUNK_VEC = f"""cv AS (SELECT chunk_id AS id, embedding::DOUBLE[] AS e FROM ch JOIN embeddings ON vec_id = chunk_id % (SELECT count(*) FROM embeddings)),
vec AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM cv a, cv b WHERE a.id % {STEP} = 0)) WHERE rank <= 100)"""


def _fused_sql(name: str, weight: float) -> str:
    return f"""{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank, id) AS rank FROM (
  SELECT query_id, id, round(sum(w::DOUBLE / (60 + rank)), 9) AS score, arg_min(rank, list) AS first_rank FROM (
    SELECT query_id, id, rank, 0 AS list, {weight} AS w FROM lex UNION ALL SELECT query_id, id, rank, 1, 1.0 FROM vec) GROUP BY 1, 2))"""


_LISTS = f"""{_INDEX}, {_CHUNK_VEC},
lex AS (SELECT query_id, chunk_id AS id, rank FROM {_top('m', 100)}),
strict AS (SELECT query_id, chunk_id AS id, rank FROM {_top('(SELECT m.* FROM m JOIN need USING (query_id) WHERE hits = n_terms)', 100)})"""


def _rrf(weight: float) -> str:
    return f"{_LISTS}, {_fused_sql('fused', weight)}"


def _means(way: str, ranked: str) -> str:
    """Mean metrics of a CTE of ranked lists, over all queries."""
    per = f"""SELECT g.query_id, n_gold, {', '.join(f'round(count(*) FILTER (rank <= {c}) / n_gold, 9) AS recall_{c}' for c in (1, 5, 20))}, round(coalesce(1 / min(rank), 0), 9) AS mrr,
      round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg_10
      FROM sized g LEFT JOIN (SELECT r.query_id, rank FROM {ranked} r JOIN cls q ON q.id = r.query_id JOIN cls c ON c.id = r.id WHERE q.k = c.k) h ON h.query_id = g.query_id GROUP BY 1, 2"""
    return f"SELECT '{way}' AS way, count(*) AS n, {', '.join(f'round(avg({x}), 4) AS {x}' for x in ('recall_1', 'recall_5', 'recall_20', 'mrr', 'ndcg_10'))} FROM ({per})"


_CLASSES = f"""cls AS (SELECT chunk_id AS id, sha256(content) AS k FROM ch),
sized AS (SELECT id AS query_id, n AS n_gold FROM cls JOIN (SELECT k, count(*) AS n FROM cls GROUP BY 1) USING (k) WHERE id % {STEP} = 0)"""
_METRICS = f"""{_INDEX},
res AS (SELECT query_id, chunk_id AS id, rank FROM {_top('m', 20)}),
gold AS (SELECT a.chunk_id AS query_id, b.chunk_id AS id FROM ch a JOIN ch b ON sha256(a.content) = sha256(b.content) WHERE a.chunk_id % {STEP} = 0),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
hit AS (SELECT query_id, rank FROM res JOIN gold USING (query_id, id)),
per AS (SELECT query_id, n_gold,
  {', '.join(f'round(count(*) FILTER (rank <= {c}) / n_gold, 9) AS recall_{c}' for c in evaluation.CUTS)},
  round(coalesce(1 / min(rank), 0), 9) AS mrr,
  round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg_10
  FROM ng LEFT JOIN hit USING (query_id) GROUP BY query_id, n_gold)"""

_PATH = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '(?i)^https?://[^/]+(/.*)$', 1)"
_CANON = r"""CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) ||
  CASE WHEN regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(?i)^https?://[^/]+(.*)$', 1), '/index\.html?$', '/') = '' THEN '/'
  ELSE regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(?i)^https?://[^/]+(.*)$', 1), '/index\.html?$', '/') END END"""
_NAMES = ", ".join(f"'{w}'" for w in U.CRAWL_NOISE)
_ASSET = ", ".join(f"'{w}'" for w in U.ASSETS)

_LINKS = r"""WITH l AS (SELECT final_url, regexp_extract_all(text, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM fetched_html),
  x AS (SELECT final_url, unnest(hrefs) AS href FROM l),
  r AS (SELECT final_url AS base, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(final_url, '(?i)^(https?://[^/?#]+)', 1) || href END AS url FROM x)"""
_LINT = ", ".join(f"('{n}', '{p}')" for n, p in CHECKS.items())

_TIERS = rf"""{_INDEX}, r AS (SELECT query_id, rank FROM {_top('m', 50)} WHERE chunk_id = query_id),
        w AS (SELECT chunk_id AS query_id, {_words(f"coalesce({_LEAF}, '')")} AS a, {_words("content")} AS b FROM ch WHERE chunk_id % {STEP} = 0),
        o AS (SELECT query_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS overlap FROM w),
        tiers AS (SELECT o.query_id, rank, overlap, CASE WHEN rank <= 5 OR overlap >= 0.15 THEN 'direct' WHEN rank <= 20 OR overlap >= 0.04 THEN 'paraphrase' WHEN rank <= 50 THEN 'vocabulary_mismatch' END AS tier
        FROM o LEFT JOIN r USING (query_id))"""
_QUESTIONS = """firsts AS (SELECT query_id, tier FROM tiers JOIN ch ON ch.chunk_id = query_id WHERE tier IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY source_url, heading_path, tier ORDER BY query_id) = 1),
        questions AS (SELECT 'r' || lpad(row_number() OVER (ORDER BY query_id)::VARCHAR, 4, '0') AS question_id, query_id, tier FROM firsts)"""
_RECALL = """SELECT g.query_id, count(h.query_id) / n_gold AS r FROM sized g LEFT JOIN (SELECT r.query_id FROM {} r JOIN cls q ON q.id = r.query_id JOIN cls c ON c.id = r.id WHERE q.k = c.k AND rank <= 5) h
        ON h.query_id = g.query_id GROUP BY g.query_id, n_gold"""
_CRAWL = rf"""x AS (SELECT final_url AS base, unnest(regexp_extract_all(text, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM fetched_html
          UNION ALL SELECT url, unnest(regexp_extract_all(content, '\]\(([^)\s]+)\)', 1)) FROM crawled_pages),
        y AS (SELECT base, href, regexp_extract(base, '(?i)^(https?://[^/?#]+)', 1) AS root, regexp_replace(regexp_replace(base, '[?#].*$', ''), '/[^/]*$', '/') AS folder FROM x),
        z AS (SELECT base, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '(?i)^(https?:)', 1) || href WHEN starts_with(href, '/') THEN root || href
          WHEN starts_with(href, '#') OR regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR href = '' THEN NULL
          WHEN starts_with(href, '../') THEN (CASE WHEN length(regexp_replace(folder, '[^/]+/$', '')) > length(root) THEN regexp_replace(folder, '[^/]+/$', '') ELSE folder END) || substring(href, 4)
          ELSE folder || regexp_replace(href, '^\./', '') END AS url FROM y),
        t AS (SELECT base, url, regexp_replace({_CANON}, '/+$', '') AS to_key, string_split(lower({_PATH}), '/') AS seg, lower(string_split({_PATH}, '/')[-1]) AS last FROM z WHERE url IS NOT NULL),
        f AS (SELECT DISTINCT base AS url, url AS to_url, to_key FROM t WHERE to_key IS NOT NULL
          AND NOT list_has_any(list_concat(seg, list_transform(seg, lambda x: regexp_replace(x, '(.)\.[^.]+$', '\1'))), [{_NAMES}])
          AND NOT (regexp_extract(last, '\.([^.]+)$', 1) IN ({_ASSET}) OR last = 'objects.inv')),
        edge AS (SELECT DISTINCT regexp_replace({_CANON}, '/+$', '') AS from_key, lower(regexp_extract(to_url, '(?i)^https?://([^/?#]+)', 1)) AS host, to_key FROM f WHERE {_CANON} IS NOT NULL),
        u AS (SELECT DISTINCT final_url AS url FROM fetched_html),
        seed AS (SELECT DISTINCT lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) || '/' AS start, regexp_replace({_CANON}, '/+$', '') AS key FROM u WHERE {_CANON} IS NOT NULL),
        reached(start, key, depth) AS (SELECT start, key, 0 FROM seed UNION SELECT r.start, e.to_key, r.depth + 1 FROM reached r JOIN edge e ON e.from_key = r.key
          WHERE e.host = regexp_extract(r.start, '^https?://([^/]+)', 1) AND r.depth < 8)"""

ORACLES = {
    "link_graph": rf"""{_LINKS}, t AS (SELECT base, url, regexp_replace({_CANON}, '/+$', '') AS to_key, string_split(lower({_PATH}), '/') AS seg, lower(string_split({_PATH}, '/')[-1]) AS last FROM r),
        f AS (SELECT DISTINCT base AS url, url AS to_url, to_key FROM t WHERE to_key IS NOT NULL
          AND NOT list_has_any(list_concat(seg, list_transform(seg, lambda x: regexp_replace(x, '(.)\.[^.]+$', '\1'))), [{_NAMES}])
          AND NOT (regexp_extract(last, '\.([^.]+)$', 1) IN ({_ASSET}) OR last = 'objects.inv'))
        SELECT DISTINCT regexp_replace({_CANON}, '/+$', '') AS from_key, to_url, to_key FROM f WHERE {_CANON} IS NOT NULL""",
    "markdown_lint": rf"""WITH c AS (SELECT DISTINCT crawl_id, content FROM crawled_pages), s AS (SELECT crawl_id, content, regexp_split_to_array(content, '\r?\n') AS l FROM c),
        e AS (SELECT crawl_id, content, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM s),
        m AS (SELECT *, starts_with(ltrim(line), '```') AS mark, count(*) FILTER (starts_with(ltrim(line), '```')) OVER (PARTITION BY crawl_id, content ORDER BY i) AS n FROM e),
        k AS (SELECT * FROM (VALUES {_LINT}) v(finding, pattern))
        SELECT finding, count(DISTINCT (crawl_id, i)) AS n_lines, count(DISTINCT crawl_id) AS n_pages FROM m, k WHERE NOT mark AND n % 2 = 0 AND regexp_matches(line, pattern) GROUP BY 1""",
    "normalized_text": r"""WITH a AS (SELECT doc_id, nfc_normalize(regexp_replace(regexp_replace(text, '[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g'),
          '(?ms)(^```[^\n]*\n(?:.*?^```[^\n]*$|.*\z))|<[^>]+>', '\1', 'g')) AS t FROM documents),
        b AS (SELECT doc_id, trim(regexp_replace(t, '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM a)
        SELECT doc_id, 'sha256:' || sha256(t) AS hash, length(t) AS n_chars FROM b""",
    "summaries": rf"""WITH {_CH}, s AS (SELECT chunk_id, heading_path, content, string_split(content, chr(10)) AS l FROM ch),
        e AS (SELECT chunk_id, generate_subscripts(l, 1) AS i, trim(unnest(l), ' ') AS t FROM s),
        m AS (SELECT *, starts_with(t, '```') AS mark, count(*) FILTER (starts_with(t, '```')) OVER (PARTITION BY chunk_id ORDER BY i) AS n FROM e),
        o AS (SELECT chunk_id, max(i) FILTER (mark AND n % 2 = 1) AS opened FROM m GROUP BY 1),
        a AS (SELECT m.chunk_id, count(*) FILTER (NOT mark) AS kept, count(*) FILTER (NOT mark AND n % 2 = 1) AS code,
          trim(coalesce(string_agg(t, ' ' ORDER BY i) FILTER (NOT mark AND n % 2 = 0 AND NOT starts_with(t, '#') AND NOT regexp_matches(t, '^(?:[-*+]|\d+\.)\s+')), ''), ' ') AS said,
          arg_min(t, i) FILTER (NOT mark AND n % 2 = 1 AND i > opened AND regexp_matches(t, '^(?:def |class |function |export )')) AS define,
          arg_min(t, i) FILTER (NOT mark AND starts_with(t, '# ')) AS heading FROM m JOIN o USING (chunk_id) GROUP BY 1),
        f AS (SELECT *, CASE WHEN regexp_extract(said, '(?s)^([^.!?]*[.!?])', 1) <> '' THEN regexp_extract(said, '(?s)^([^.!?]*[.!?])', 1) ELSE said END AS st FROM a),
        g AS (SELECT *, substring(st, 1, 200) AS head, length(substring(st, 1, 200)) - length(string_split(substring(st, 1, 200), ' ')[-1]) AS at_ FROM f),
        h AS (SELECT g.*, string_split(coalesce(s.heading_path, ''), ' / ') AS parts, CASE WHEN said <> '' THEN CASE WHEN length(st) <= 200 THEN st WHEN at_ - 1 > 100 THEN substring(head, 1, at_ - 1) || '...' ELSE head || '...' END
          ELSE coalesce(substring(heading, 3), CASE WHEN length(trim(content, ' ')) > 200 THEN substring(trim(content, ' '), 1, 200) || '...' ELSE trim(content, ' ') END) END AS txt FROM g JOIN s USING (chunk_id))
        SELECT chunk_id, CASE WHEN code * 2 > kept AND define IS NOT NULL THEN define WHEN len(parts) < 2 OR parts[-1] = '' THEN txt WHEN length(parts[-1]) > 60 THEN parts[-1]
          WHEN starts_with(txt, parts[-1]) THEN txt ELSE parts[-1] || ': ' || txt END AS summary FROM h""",
    "cached_summaries": f"""WITH {_CH}, k AS (SELECT content_hash, min(summary) AS cached FROM ch WHERE content_hash IS NOT NULL GROUP BY 1)
        SELECT chunk_id, md5(coalesce(summary, cached, '')) AS summary_md5 FROM ch LEFT JOIN k USING (content_hash)""",
    "sampled_chunks": f"""WITH {_CH} SELECT chunk_id, package, substring(content, 1, 2000) AS content FROM ch WHERE length(content) >= 100
        AND NOT regexp_matches(coalesce(heading_path, ''), '(?i)changelog|index$|release notes') ORDER BY md5('1:' || chunk_id), chunk_id LIMIT 200""",
    "event_latency": """WITH a AS (SELECT event_type, list_sort(list(value)) AS l, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, n, l[1] AS least, l[n // 2 + 1] AS p50, l[(n * 95 + 99) // 100] AS p95, l[n] AS most FROM a""",
    "event_spread": """SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stdev FROM events GROUP BY 1""",
    "query_violations": f"""WITH q AS (SELECT DISTINCT id AS query_id, {_LEAF} AS query FROM chunks WHERE id % {STEP} = 0),
        t AS (SELECT query_id, query, len(list_filter({_tok('query')}, lambda x: x NOT IN ({_STOP}))) AS n FROM q)
        SELECT query_id, 'empty' AS violation FROM t WHERE NOT coalesce(length(trim(query)) > 0, false)
        UNION ALL SELECT query_id, 'lines' FROM t WHERE NOT coalesce(NOT contains(query, chr(10)), false)
        UNION ALL SELECT query_id, 'terms' FROM t WHERE NOT n BETWEEN 2 AND 4""",
    "index_vocabulary": f"WITH {_INDEX} SELECT term, df FROM df",
    "index_statistics": f"WITH {_INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "search_any": f"WITH {_INDEX} SELECT query_id, chunk_id, score, rank FROM {_top('m', 10)}",
    "search_all": f"WITH {_INDEX} SELECT query_id, chunk_id, score, rank FROM {_top('(SELECT m.* FROM m JOIN need USING (query_id) WHERE hits = n_terms)', 10)}",
    "search_excluding": f"WITH {_INDEX} SELECT query_id, chunk_id, score, rank FROM {_top('''(SELECT * FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM post WHERE term IN ('python', 'release')))''', 10)}",
    "search_governed": f"WITH {_INDEX} SELECT query_id, chunk_id, score, rank, package, version, lifecycle_warning FROM {_top(_GOV, 10, ', package, version, lifecycle_warning')}",
    "search_in_packages": f"""WITH {_INDEX} SELECT query_id, chunk_id, score, rank, package FROM {_top(f"(SELECT * FROM {_GOV} WHERE package IN ('harborkit', 'quillbase'))", 10, ', package')}""",
    "search_budget": f"""WITH {_INDEX} SELECT query_id, chunk_id, rank, spent FROM (SELECT t.*, sum(coalesce(length(summary) // 4, 0)) OVER (PARTITION BY query_id ORDER BY rank) AS spent
        FROM {_top('m', 10)} t JOIN ch USING (chunk_id)) WHERE spent <= 60""",
    "fetch_chunks": f"""WITH {_CH} SELECT DISTINCT chunk_id, package, ch.version, lifecycle_state, heading_path, sha256(content) AS content_sha, 0.0::DOUBLE AS score
        FROM ch JOIN {_STATE} k ON k.name = package AND k.version = ch.version WHERE chunk_id % {STEP} = 0""",
    "packages_not_indexed": "SELECT DISTINCT package FROM pages WHERE package IS NOT NULL AND package NOT IN (SELECT name FROM packages)",
    "cosine_top": f"WITH {_VEC} SELECT * FROM vec WHERE rank <= 10",
    "rank_fusion": f"WITH {_rrf(1.0)} SELECT * FROM fused WHERE rank <= 20",
    "rank_fusion_weighted": f"WITH {_rrf(3.0)} SELECT * FROM fused WHERE rank <= 20",
    "gated_fusion": f"""WITH {_rrf(1.0)}
        SELECT query_id, id, rank FROM strict WHERE rank <= 20 UNION ALL
        SELECT query_id, id, rank FROM fused WHERE rank <= 20 AND query_id NOT IN (SELECT query_id FROM strict)""",
    "unit_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
        p AS (SELECT vec_id, n, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM v) SELECT vec_id, pos, round(x / n, 6) AS u FROM p""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM per",
    "metric_slices": f"""WITH {_METRICS}, s AS (SELECT per.*, package, (n_gold > 1)::VARCHAR AS has_copies FROM per JOIN ch ON ch.chunk_id = query_id)
        SELECT package, has_copies, count(*) AS n, round(avg(recall_5), 4) AS recall_5, round(avg(mrr), 4) AS mrr, round(avg(ndcg_10), 4) AS ndcg_10
        FROM s GROUP BY GROUPING SETS ((), (package), (has_copies))""",
    "question_tiers": f"WITH {_TIERS} SELECT * FROM tiers",
    "question_ids": f"""WITH {_TIERS}, {_QUESTIONS} SELECT question_id, query_id, tier FROM questions""",
    "tier_counts": f"WITH {_TIERS}, {_QUESTIONS} SELECT tier, count(*) AS n FROM questions GROUP BY 1",
    "tier_gaps": f"""WITH {_TIERS}, {_CLASSES}, lex AS (SELECT query_id, chunk_id AS id, rank FROM {_top('m', 20)}),
        strict AS (SELECT query_id, chunk_id AS id, rank FROM {_top('(SELECT m.* FROM m JOIN need USING (query_id) WHERE hits = n_terms)', 20)}),
        a AS (SELECT tier, round(avg(r), 4) AS any_5 FROM tiers JOIN ({_RECALL.format('lex')}) USING (query_id) WHERE tier IS NOT NULL GROUP BY 1),
        b AS (SELECT tier, round(avg(r), 4) AS all_5 FROM tiers JOIN ({_RECALL.format('strict')}) USING (query_id) WHERE tier IS NOT NULL GROUP BY 1)
        SELECT tier, any_5, all_5, round(any_5 - all_5, 4) AS gap FROM a JOIN b USING (tier)""",
    "fusion_matrix": f"""WITH {_LISTS}, {_fused_sql('f1', 1.0)}, {_fused_sql('f2', 2.0)}, {_fused_sql('f3', 3.0)},
        gate AS (SELECT query_id, id, rank FROM strict UNION ALL SELECT query_id, id, rank FROM f1 WHERE query_id NOT IN (SELECT query_id FROM strict)), {_CLASSES},
        ways AS ({' UNION ALL '.join(_means(w, r) for w, r in (('lexical', 'lex'), ('vector', 'vec'), ('fused 1', 'f1'), ('fused 2', 'f2'), ('fused 3', 'f3'), ('gated', 'gate')))})
        SELECT *, CASE WHEN way = 'gated' THEN (SELECT count(DISTINCT query_id) FROM strict) END AS n_gated FROM ways""",
    "fetch_budget": f"""WITH {_CH}, f AS (SELECT DISTINCT chunk_id // {32 * STEP} AS request, chunk_id, length(content) // 4 AS cost FROM ch JOIN {_STATE} k ON k.name = package AND k.version = ch.version WHERE chunk_id % {STEP} = 0)
        SELECT request, chunk_id, spent FROM (SELECT *, sum(cost) OVER (PARTITION BY request ORDER BY chunk_id) AS spent FROM f) WHERE spent <= 2000""",
    "imported_pages": """WITH p AS (SELECT id, package, version FROM pages WHERE package IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, package DESC, version DESC NULLS LAST, url DESC NULLS LAST) = 1),
        s AS (SELECT *, row_number() OVER (ORDER BY package, version NULLS FIRST, id) AS store_page_id FROM p)
        SELECT c.id, c.package, c.version, c.page_id, store_page_id FROM (SELECT DISTINCT id, package, version, page_id FROM chunks) c
        LEFT JOIN s ON s.package = c.package AND s.version = c.version AND s.id = c.page_id""",
    "page_references": """WITH r AS (SELECT page_id, count(*) AS n FROM raw_chunks WHERE page_id IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT id AS page_id FROM pages WHERE id IS NOT NULL)
        SELECT page_id, 'unknown' AS state, n FROM r WHERE page_id NOT IN (SELECT page_id FROM t)
        UNION ALL SELECT page_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END, coalesce(n, 0) FROM t LEFT JOIN r USING (page_id) WHERE n IS NULL OR n > 1""",
    "summary_capabilities": rf"""WITH {_CH}, a AS (SELECT chunk_id, package, trim(summary, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM ch WHERE summary IS NOT NULL),
        b AS (SELECT *, len(regexp_extract_all(t, '\S+')) AS n FROM a)
        SELECT chunk_id, 'failure' AS severity, 'empty' AS finding FROM b WHERE t = ''
        UNION ALL SELECT chunk_id, 'failure', 'lines' FROM b WHERE t <> '' AND contains(t, chr(10))
        UNION ALL SELECT chunk_id, 'failure', 'words' FROM b WHERE t <> '' AND n NOT BETWEEN 8 AND 35
        UNION ALL SELECT chunk_id, 'warning', 'words' FROM b WHERE n BETWEEN 8 AND 35 AND n NOT BETWEEN 10 AND 30
        UNION ALL SELECT chunk_id, 'failure', 'name' FROM b WHERE t <> '' AND list_contains(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'), lower(package))""",
    "heading_counts": f"""WITH {_CH}, h AS (SELECT package, version, list_sort(list(DISTINCT heading_path)) AS l, count(*) AS n FROM ch WHERE heading_path IS NOT NULL GROUP BY 1, 2)
        SELECT package, version, n AS n_headings, len(l) AS n_different, array_to_string(l[1:5], ' | ') AS first, greatest(0, len(l) - 5) AS more FROM h""",
    "links_first_seen": r"""WITH l AS (SELECT fetch_id, final_url, regexp_extract_all(text, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM fetched_html),
        x AS (SELECT fetch_id, final_url, generate_subscripts(hrefs, 1) - 1 AS pos, unnest(hrefs) AS href FROM l)
        SELECT fetch_id, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(final_url, '(?i)^(https?://[^/?#]+)', 1) || href END AS target, min(pos) AS pos
        FROM x GROUP BY 1, 2 HAVING target IS NOT NULL""",
    "verified_packs": "SELECT package, version, count(DISTINCT id) AS n_chunks, CASE WHEN bool_or(page_id < 1) THEN 'records: page_id' ELSE 'passed' END AS state FROM chunks GROUP BY 1, 2",
    "chunk_cover": rf"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '{_TAIL}', ''), '{_BLANK}', '', 'g') AS b FROM documents)
        SELECT doc_id, sha256(b) AS sha FROM b WHERE b <> ''""",
    "crawl_levels": f"WITH RECURSIVE {_CRAWL} SELECT start, key, min(depth) AS depth FROM reached GROUP BY 1, 2",
    "crawl_capped": f"""WITH RECURSIVE {_CRAWL}, r AS (SELECT start, key, min(depth) AS depth FROM reached GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, key) AS n, count(*) OVER (PARTITION BY start) > 12 AS truncated FROM r)
        SELECT start, key, depth, truncated FROM n WHERE n <= 12""",
    "sitemap_pages": """SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) || '/' AS start, url AS page FROM crawled_pages WHERE discovered_via = 'sitemap'""",
    "reference_drift": rf"""WITH {_CH}, c AS (SELECT *, substring(regexp_replace(trim(content), '\s+', ' ', 'g'), 1, 80) AS anchor FROM ch),
        g AS (SELECT chunk_id AS ref_id, source_url, CASE WHEN chunk_id % 9 = 0 THEN heading_path || '?' ELSE heading_path END AS heading_path,
          CASE WHEN chunk_id % 7 = 0 THEN 'sha256:gone' ELSE content_hash END AS content_hash, anchor FROM c),
        j AS (SELECT ref_id, c.chunk_id, coalesce(c.content_hash = g.content_hash, false) AS same, c.anchor = g.anchor AS anchored,
          row_number() OVER (PARTITION BY ref_id ORDER BY coalesce(c.content_hash = g.content_hash, false) DESC, c.chunk_id) AS n
          FROM g LEFT JOIN c ON c.source_url = g.source_url AND c.heading_path = g.heading_path)
        SELECT ref_id, CASE WHEN chunk_id IS NULL THEN 'missing' WHEN same THEN 'ok' WHEN anchored THEN 'hash mismatch' ELSE 'anchor drift' END AS state FROM j WHERE n = 1""",
    "reference_cascade": rf"""WITH {_CH}, {_MOVED},
        j AS (SELECT g.ref_id, c.chunk_id, CASE WHEN c.source_url = g.source_url THEN 1
            WHEN ends_with(lower(c.source_url), lower('/' || regexp_replace(regexp_replace(g.source_url, '^https?://', ''), '^[^/]*/', ''))) THEN 2
            WHEN g.package IS NULL OR c.package = g.package THEN 3 END AS step,
          c.content_hash AS now_hash, g.content_hash AS old_hash, g.anchor, c.flat FROM g JOIN c ON c.heading_path = g.heading_path),
        b AS (SELECT * FROM j WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY step, coalesce(now_hash = old_hash, false) DESC, chunk_id) = 1),
        s AS (SELECT *, coalesce(now_hash <> old_hash, false) AS moved, anchor <> '' AND NOT contains(flat, anchor) AS lost FROM b)
        SELECT g.ref_id, CASE step WHEN 1 THEN 'url' WHEN 2 THEN 'suffix' WHEN 3 THEN 'heading' END AS found_by, s.chunk_id,
          CASE WHEN s.chunk_id IS NULL THEN 'missing' WHEN moved AND lost THEN 'hash mismatch, anchor drift' WHEN moved THEN 'hash mismatch' WHEN lost THEN 'anchor drift' ELSE 'ok' END AS state
        FROM g LEFT JOIN s ON s.ref_id = g.ref_id""",
    "reference_chunks": rf"""WITH {_CH}, {_MOVED}, m AS (SELECT g.ref_id, c.chunk_id FROM g JOIN c ON c.package = g.package AND c.heading_path = g.heading_path
          AND ends_with(coalesce(c.source_url, ''), regexp_replace(g.source_url, '^https?://[^/]+/', '')))
        SELECT g.ref_id, m.chunk_id FROM g LEFT JOIN m ON m.ref_id = g.ref_id""",
    "pack_hash_chain": """SELECT package, version, 'sha256:' || sha256(string_agg(content, chr(10) ORDER BY id, content)) AS pack_hash
        FROM (SELECT DISTINCT package, version, id, coalesce(content, '') AS content FROM chunks) GROUP BY 1, 2""",
    "pack_tree_hashes": """WITH r AS (SELECT DISTINCT package, version, id AS o, sha256(coalesce(content, '')) AS h FROM chunks),
        a AS (SELECT package, version, o // 4096 AS o, sha256(string_agg(h, chr(10) ORDER BY r.o, h)) AS h FROM r GROUP BY 1, 2, 3),
        b AS (SELECT package, version, o // 4096 AS o, sha256(string_agg(h, chr(10) ORDER BY a.o)) AS h FROM a GROUP BY 1, 2, 3)
        SELECT package, version, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY b.o)) AS tree_hash FROM b GROUP BY 1, 2""",
    "pack_counts": """SELECT package, version, count(DISTINCT id) AS n_chunks, count(DISTINCT page_id) AS n_pages, sum(tokens)::BIGINT AS n_tokens
        FROM (SELECT DISTINCT package, version, id, page_id, length(content) // 4 AS tokens FROM chunks) GROUP BY 1, 2""",
    "chunk_size_stats": f"""WITH {_CH}, s AS (SELECT package, length(content) // 4 AS v FROM ch), a AS (SELECT package, list_sort(list(v)) AS l, count(*) AS n FROM s GROUP BY 1)
        SELECT a.package, n, list_sum(l)::BIGINT AS total, l[-1] AS largest, len(list_filter(l, lambda x: x > 800)) AS n_over,
        l[least(n * 95 // 100, n - 1) + 1] AS p95, l[least(n * 99 // 100, n - 1) + 1] AS p99 FROM a""",
    "oversized_chunks": "SELECT DISTINCT id, package, version, heading_path, length(content) // 4 AS tokens FROM chunks WHERE length(content) // 4 > 1600",
    "duplicate_contents": """SELECT sha256(content) AS hash, count(DISTINCT id) AS n_ids, count(DISTINCT package) AS n_packages, min(id) AS first_id
        FROM chunks GROUP BY 1 HAVING count(DISTINCT id) > 1""",
    "hash_mismatches": f"WITH {_CH} SELECT chunk_id, package, version FROM ch WHERE content_hash <> 'sha256:' || sha256(content)",
    "chunk_violations": """WITH c AS (SELECT DISTINCT id, page_id, heading_path, content, content_hash, token_count, source_url FROM chunks)
        SELECT id, 'page_id' AS violation FROM c WHERE NOT coalesce(page_id >= 1, false)
        UNION ALL SELECT id, 'heading_path' FROM c WHERE NOT coalesce(length(heading_path) > 0, false)
        UNION ALL SELECT id, 'content' FROM c WHERE NOT coalesce(length(content) > 0, false)
        UNION ALL SELECT id, 'content_hash' FROM c WHERE NOT coalesce(regexp_matches(content_hash, '^sha256:[a-f0-9]{64}$'), false)
        UNION ALL SELECT id, 'token_count' FROM c WHERE NOT coalesce(token_count = length(content) // 4, false)
        UNION ALL SELECT id, 'source_url' FROM c WHERE NOT coalesce(regexp_matches(source_url, '^https?://'), false)""",
    "latest_pages": """SELECT id, package, version, url, title, strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS ingested_at,
        strftime(deleted_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST,
        package DESC NULLS LAST, version DESC NULLS LAST, url DESC NULLS LAST, title DESC NULLS LAST, deleted_at DESC NULLS LAST) AS n FROM pages) WHERE n = 1""",
    "lock_state": """WITH l AS (SELECT DISTINCT c.package AS name, c.version, CASE WHEN length(c.package) % 2 = 0 THEN (SELECT max(pack_digest) FROM packages p WHERE p.name = c.package AND p.version = c.version)
          ELSE k.normalized_content_hash END AS pack_digest FROM (SELECT DISTINCT package, version FROM chunks) c LEFT JOIN packages k ON k.name = c.package AND k.version = c.version)
        SELECT l.name, l.version, l.pack_digest, CASE WHEN count(k.pack_digest) = 0 THEN 'missing' WHEN coalesce(bool_or(k.pack_digest = l.pack_digest), false) THEN 'present' ELSE 'digest mismatch' END AS state
        FROM l LEFT JOIN packages k ON k.name = l.name AND k.version = l.version GROUP BY 1, 2, 3""",
    "text_columns": r"""SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^[ \t]*# (.*)$', 1)), '') AS heading, (length(text) // 4)::INT AS tokens, 'sha256:' || sha256(text) AS hash,
        sha256(concat_ws(chr(10), nullif(title, ''), nullif(source, ''), nullif(text, ''))) AS embedding_sha FROM documents""",
    "mdx_text": r"""WITH a AS (SELECT crawl_id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(trim(x), '<!--')), chr(10)) AS t FROM crawled_pages),
        c AS (SELECT crawl_id, regexp_replace(regexp_replace(t, '(?ms)(^```.*?^```[^\n]*$)|^(?:import|export)\s[^\n]*$\n?', '\1', 'g'), '(?ms)(^```.*?^```[^\n]*$)|^[ \t]*</?[A-Z][^>\n]*/?>[ \t]*$\n?', '\1', 'g') AS t FROM a),
        d AS (SELECT crawl_id, regexp_replace(regexp_replace(regexp_replace(t, '(?ms)(^```.*?^```[^\n]*$)|\{`([^`\n]*)`\}', '\1\2', 'g'), '(?ms)(^```.*?^```[^\n]*$)|\{"([^"\n]*)"\}', '\1\2', 'g'),
          '(?ms)(^```.*?^```[^\n]*$)|\{''([^''\n]*)''\}', '\1\2', 'g') AS t FROM c)
        SELECT DISTINCT crawl_id, sha256(regexp_replace(regexp_replace(t, '(?ms)(^```.*?^```[^\n]*$)|\{[^{}\n]*\}', '\1', 'g'), '(?m)^(#{1,6} .*?)<sup>.*?</sup>', '\1', 'g')) AS sha FROM d""",
    "built_pages": rf"""WITH c AS (SELECT package, {_CANON} AS source_url FROM crawled_pages WHERE trim(content, ' ' || chr(10) || chr(9) || chr(13)) <> '')
        SELECT DISTINCT coalesce(package, 'host:' || coalesce(regexp_extract(source_url, '^https?://([^/]+)', 1), '')) AS package, source_url, true AS dense FROM c""",
    "html_letters": rf"""WITH h AS (SELECT fetch_id, regexp_replace(coalesce(nullif(regexp_extract(text, '(?is)<body\b[^>]*>(.*)</body>', 1), ''), text), '(?s)<!--.*?-->', '', 'g') AS t FROM fetched_html
          WHERE coalesce(content_type, 'text/html') IN ({', '.join(f"'{x}'" for x in U.HTML_TYPES)})),
        d AS (SELECT fetch_id, regexp_replace(t, '(?is){'|'.join(rf'<{x}\b[^>]*>.*?</{x}\s*>' for x in ('nav', 'header', 'footer', 'aside', 'script', 'style', 'noscript'))}', '', 'g') AS t FROM h)
        SELECT fetch_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '<[a-zA-Z/!][^>]*>', '', 'g'), '&(?:lt|gt|amp|quot|nbsp|[#]x?[0-9a-fA-F]+);', '', 'g'), '[^A-Za-z]+', '', 'g')) AS sha FROM d""",
    "url_columns": rf"""WITH p AS (SELECT DISTINCT url, {_CANON} AS canonical, {_PATH} AS path FROM pages WHERE url IS NOT NULL),
        s AS (SELECT *, string_split(lower(path), '/') AS seg, string_split(path, '/')[-1] AS last FROM p)
        SELECT url, canonical, regexp_replace(canonical, '/+$', '') AS dedup_key,
        CASE WHEN path = '' THEN '/' WHEN ends_with(path, '/') THEN path WHEN contains(last, '.') THEN regexp_replace(path, '[^/]*$', '') ELSE path || '/' END AS scope,
        CASE WHEN regexp_replace(trim(path, '/'), '([^/])\.[^./]+$', '\1') = '' THEN url ELSE regexp_replace(trim(path, '/'), '([^/])\.[^./]+$', '\1') END AS label,
        list_has_any(list_concat(seg, list_transform(seg, lambda x: regexp_replace(x, '(.)\.[^.]+$', '\1'))), [{_NAMES}]) AS noise,
        regexp_extract(lower(last), '\.([^.]+)$', 1) IN ({_ASSET}) OR lower(last) = 'objects.inv' AS asset FROM s""",
    "page_links": r"""WITH l AS (SELECT fetch_id, final_url, regexp_extract_all(text, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM fetched_html),
        x AS (SELECT fetch_id, final_url, generate_subscripts(hrefs, 1) - 1 AS pos, unnest(hrefs) AS href FROM l)
        SELECT fetch_id, pos, href, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(final_url, '(?i)^(https?://[^/?#]+)', 1) || href END AS target FROM x""",
    "concatenated_pages": r"""WITH c AS (SELECT DISTINCT crawl_id, url, content FROM crawled_pages)
        SELECT crawl_id AS item_id, 1 AS seq, url, sha256(CASE WHEN trim(content, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'old text' ELSE trim(content, ' ' || chr(10) || chr(9) || chr(13)) END) AS content_sha FROM c
        UNION ALL SELECT crawl_id, 2, 'https://other.example/', sha256('more') FROM c""",
}
QUERIES = {
    q.__name__: q
    for q in (
        index_vocabulary,
        index_statistics,
        search_any,
        search_all,
        search_excluding,
        search_governed,
        search_in_packages,
        search_budget,
        fetch_chunks,
        packages_not_indexed,
        cosine_top,
        rank_fusion,
        rank_fusion_weighted,
        gated_fusion,
        unit_vectors,
        retrieval_metrics,
        metric_slices,
        question_tiers,
        fusion_matrix,
        question_ids,
        tier_counts,
        tier_gaps,
        fetch_budget,
        imported_pages,
        page_references,
        summary_capabilities,
        heading_counts,
        links_first_seen,
        chunk_cover,
        verified_packs,
        crawl_capped,
        sitemap_pages,
        reference_drift,
        reference_cascade,
        reference_chunks,
        pack_hash_chain,
        pack_tree_hashes,
        pack_counts,
        chunk_size_stats,
        oversized_chunks,
        duplicate_contents,
        hash_mismatches,
        chunk_violations,
        latest_pages,
        lock_state,
        text_columns,
        mdx_text,
        normalized_text,
        summaries,
        markdown_chunks,
        html_markdown,
        html_letters,
        url_columns,
        page_links,
        link_graph,
        crawl_levels,
        concatenated_pages,
        built_chunks,
        built_pages,
        routed_markdown,
        cached_summaries,
        sampled_chunks,
        markdown_lint,
        event_latency,
        event_spread,
        query_violations,
    )
}
