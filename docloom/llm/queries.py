"""Queries of the training-data operators, with SQL where SQL can check them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from .boilerplate import furniture, main_body
from .mixing import mix, mixed_documents, share_report
from .packing import CAPACITY, fill_report, pack
from .repeated_lines import repeated_lines, without_lines
from .residue import residue_pages, without_residue
from .sentences import sentences
from .splitting import CHARS_PER_TOKEN, MAX_TOKENS, OVERLAP_TOKENS, split_oversized


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = furniture(table(spark, sf_dir, "chunks"), row_id="id", content="content", src_table="chunks")
    pages = furniture(table(spark, sf_dir, "crawled_pages"), row_id="crawl_id", content="content", src_table="crawled_pages")
    return chunks.union(pages)


def p2_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = main_body(table(spark, sf_dir, "chunks").select("id", "content").distinct(), content="content")
    pages = main_body(table(spark, sf_dir, "crawled_pages").select("crawl_id", "content").distinct(), content="content")
    return chunks.select(F.lit("chunks").alias("src_table"), F.col("id").alias("row_id"), "main_body").union(
        pages.select(F.lit("crawled_pages"), "crawl_id", "main_body")
    )


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "chunks"), row_id="id", source="package", content="content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).select("chunk_id", "line_no")


def p3_lines_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).groupBy("package", "masked").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count(F.lit(1)).alias("n_lines"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("id", "content").distinct()
    return without_lines(chunks, p3_found(spark, sf_dir), row_id="id", content="content").select("id", "cleaned")


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each chunk's content: those kept and those taken out, and whether any other was touched."""
    chunks = table(spark, sf_dir, "chunks").select("id", "content").where("content is not null").distinct()
    found = p3_found(spark, sf_dir)
    cleaned = without_lines(chunks, found, row_id="id", content="content")
    gone = found.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("n_gone"))
    lines = lambda c: F.when(F.col(c) == "", F.lit(0)).otherwise(F.size(F.split(c, "\n", -1)))
    both = cleaned.join(gone, "id", "left").withColumn("n_gone", F.coalesce("n_gone", F.lit(0)))
    # a chunk whose every line went is empty, one that keeps an empty line as its only one has no line by this count
    whole = F.when((F.col("cleaned") == "") & (F.col("n_gone") > 0), F.size(F.split("content", "\n", -1))).otherwise(lines("cleaned") + F.col("n_gone"))
    return both.select("id", whole.cast("long").alias("n_lines"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = split_oversized(table(spark, sf_dir, "chunks"), row_id="id", content="content", src_table="chunks")
    raw = split_oversized(table(spark, sf_dir, "raw_chunks"), row_id="id", content="content", src_table="raw_chunks")
    return chunks.union(raw)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("piece_no > 1").select("src_table", "row_id").distinct()


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut items put together again, and whether all their pieces keep the limit and the overlap."""
    overlap = OVERLAP_TOKENS * CHARS_PER_TOKEN
    per = p4_pieces(spark, sf_dir).groupBy("src_table", "row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece", "n_tokens"))).alias("p"), F.count_distinct("heading_path").alias("n_paths"))
    before = lambda i: F.right(F.get("p", i - 1)["piece"], F.lit(overlap))
    return per.select(
        "src_table",
        "row_id",
        F.sha2(F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], overlap + 1, 2**31 - 1))), ""), 256).alias("sha"),
        F.forall("p", lambda x: x["n_tokens"] <= MAX_TOKENS).alias("in_limit"),
        F.forall(F.transform("p", lambda x, i: (i == 0) | F.startswith(x["piece"], before(i))), lambda x: x).alias("overlapping"),
        (F.col("n_paths") <= 1).alias("one_path"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_pages(
        [
            ("crawled_pages", table(spark, sf_dir, "crawled_pages"), "crawl_id", "url", "content"),
            ("fetched_html", table(spark, sf_dir, "fetched_html"), "fetch_id", "final_url", "text", "content_type"),
        ]
    )


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = p5_found(spark, sf_dir)
    pages = without_residue(table(spark, sf_dir, "crawled_pages"), cases, src_table="crawled_pages", row_id="crawl_id")
    html = without_residue(table(spark, sf_dir, "fetched_html"), cases, src_table="fetched_html", row_id="fetch_id")
    return pages.select(F.lit("crawled_pages").alias("src_table"), F.col("crawl_id").alias("row_id"), "url", F.col("content").alias("text")).union(
        html.select(F.lit("fetched_html"), "fetch_id", "url", "text")
    )


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each table: those kept and the cases together, and how many are both."""
    cases = written(p5_found(spark, sf_dir))
    parts = []
    for name, key in (("crawled_pages", "crawl_id"), ("fetched_html", "fetch_id")):
        kept = without_residue(table(spark, sf_dir, name), cases, src_table=name, row_id=key).select(F.col(key).alias("row_id"), F.lit(1).alias("kept"), F.lit(0).alias("gone"))
        every = kept.union(cases.where(F.col("src_table") == name).select("row_id", F.lit(0), F.lit(1))).groupBy("row_id").agg(F.max("kept").alias("kept"), F.max("gone").alias("gone"))
        parts.append(every.agg(F.lit(name).alias("src_table"), F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("kept") * F.col("gone")).alias("n_both")))
    return parts[0].union(parts[1])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), item_id="doc_id", text="text").withColumnRenamed("item_id", "doc_id")


def p6_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, containers over their capacity, places that overlap or leave a gap, and small documents that were divided."""
    packed = written(p6_containers(spark, sf_dir))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("container").orderBy("position")
    places = packed.withColumn("next", F.lead("offset").over(w)).withColumn("end", F.col("offset") + F.col("n_tokens"))
    counts = [
        docs.select(F.lit("documents").alias("what"), F.count(F.lit(1)).alias("n")),
        docs.select(F.lit("divided"), F.count_if((F.col("parts") > 1) & (F.col("n") <= CAPACITY))),
        places.select(F.lit("over capacity"), F.count_if(F.col("end") > CAPACITY)),
        places.select(F.lit("overlap or gap"), F.count_if(F.col("next").isNotNull() & (F.col("next") != F.col("end")))),
    ]
    return reduce(DataFrame.union, counts)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_containers(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), item_id="doc_id", source="source", text="text")


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(_mixed(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed source's wanted share and cap, the documents used more often than that, and those of other sources."""
    pieces = written(_mixed(spark, sf_dir))
    used = mixed_documents(pieces).join(table(spark, sf_dir, "mix_targets").groupBy("source").agg(F.min("max_repeats").alias("cap")), "source")
    over = used.groupBy("source").agg(F.count_if(F.col("repeats") > F.col("cap")).alias("n_over"))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("own"))
    strange = pieces.select("item_id", "source").distinct().join(own, "item_id", "left").groupBy("source").agg(F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_strange"))
    report = share_report(pieces, table(spark, sf_dir, "mix_targets")).select("source", "wanted_share", "max_repeats")
    return report.join(over, "source", "left").join(strange, "source", "left").fillna(0, ["n_over", "n_strange"])


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of what a document's sentences hold in their order, without white space."""
    per = p8_sentences(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", "sentence"))).alias("s"))
    bare = F.regexp_replace(F.array_join(F.transform("s", lambda x: x["sentence"]), ""), _BLANK, "")
    return per.select("doc_id", F.sha2(bare, 256).alias("sha"), F.size("s").cast("long").alias("n")).select("doc_id", "sha")


_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), item_id="doc_id", text="text")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), item_id="doc_id", text="text", with_text=True)


QUERIES = {
    q.__name__: q
    for q in (
        p2_found,
        p2_main_body,
        p3_found,
        p3_lines_by_package,
        p3_cleaned,
        p3_balance,
        p4_found,
        p4_pieces,
        p4_rejoined,
        p5_found,
        p5_kept,
        p5_balance,
        p6_containers,
        p6_fill,
        p6_balance,
        p7_documents,
        p7_blocks,
        p7_shares,
        p7_balance,
        p8_found,
        p8_sentences,
        p8_cover,
    )
}
ORACLES = {
    "p3_balance": "SELECT DISTINCT id, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS n_lines FROM chunks WHERE content IS NOT NULL",
    "p5_balance": """SELECT 'crawled_pages' AS src_table, count(DISTINCT crawl_id) AS n_pages, 0 AS n_both FROM crawled_pages
        UNION ALL SELECT 'fetched_html', count(DISTINCT fetch_id), 0 FROM fetched_html""",
    "p6_balance": """SELECT 'documents' AS what, count(*) AS n FROM documents WHERE text <> ''
        UNION ALL SELECT unnest(['divided', 'over capacity', 'overlap or gap']), 0""",
    "p7_balance": "SELECT source, max(target_share) AS wanted_share, min(max_repeats) AS max_repeats, 0 AS n_over, 0 AS n_strange FROM mix_targets GROUP BY 1",
    "p8_cover": rf"""SELECT doc_id, sha256(regexp_replace(text, '{_BLANK}', '', 'g')) AS sha FROM documents WHERE regexp_replace(text, '{_BLANK}', '', 'g') <> ''""",
    "p4_found": """
        SELECT DISTINCT 'chunks' AS src_table, id AS row_id FROM chunks WHERE length(content) // 4 > 800
        UNION ALL SELECT DISTINCT 'raw_chunks', id FROM raw_chunks WHERE length(content) // 4 > 800""",
    "p4_rejoined": """
        SELECT DISTINCT 'chunks' AS src_table, id AS row_id, sha256(content) AS sha, true AS in_limit, true AS overlapping, true AS one_path FROM chunks WHERE length(content) // 4 > 800
        UNION ALL SELECT DISTINCT 'raw_chunks', id, sha256(content), true, true, true FROM raw_chunks WHERE length(content) // 4 > 800""",
}
