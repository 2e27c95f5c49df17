"""Retrieval quality: recall, reciprocal rank, gain, slices, difficulty tiers, drift of stored references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranks import numbered

CUTS = (1, 5, 10, 20)


def metrics_of(hits: DataFrame, sizes: DataFrame, cuts: tuple[int, ...] = CUTS, gain_at: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per query: recall at each cut, reciprocal rank, normalised gain; 0 where nothing relevant was found.

    ``hits (query_id, rank)`` are the relevant results, ``sizes (query_id, n_gold)`` says how many there are in all.  ``by`` names the
    columns of both that stand for a query, if it is ranked in more than one way.
    """
    if not cuts or min(*cuts, gain_at) < 1:
        raise ValueError("cuts count from 1")
    per = hits.groupBy(*by).agg(
        *[F.sum((F.col("rank") <= c).cast("int")).alias(f"h{c}") for c in cuts],
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= gain_at, 1 / F.log2(F.col("rank") + 1))).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(gain_at)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return sizes.join(per, [*by], "left").select(
        *by,
        "n_gold",
        *[F.round(F.coalesce(F.col(f"h{c}"), F.lit(0)) / F.col("n_gold"), 9).alias(f"recall_{c}") for c in cuts],
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.coalesce(F.col("gain"), F.lit(0.0)) / ideal, 9).alias(f"ndcg_{gain_at}"),
    )


def retrieval_metrics(results: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS, gain_at: int = 10) -> DataFrame:
    """Metrics of ``results (query_id, id, rank)`` against ``gold (query_id, id)``.

    Repeated gold counts once, queries without gold have no row (``without_gold`` names them).
    """
    g = gold.select("query_id", "id").distinct()
    sizes = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    return metrics_of(results.select("query_id", "id", "rank").join(g, ["query_id", "id"]), sizes, cuts, gain_at)


def class_hits(results: DataFrame, own: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``results (query_id, id, ...)`` that are of their query's class: ``own (query_id, class)``, ``classes (id, class)``."""
    found = results.join(classes, "id").join(own.select("query_id", F.col("class").alias("wanted")), "query_id")
    return found.where("class = wanted").drop("class", "wanted")


def class_metrics(results: DataFrame, own: DataFrame, classes: DataFrame, cuts: tuple[int, ...] = CUTS, gain_at: int = 10) -> DataFrame:
    """Metrics where all items of a query's class are its gold: ``own (query_id, class)``, ``classes (id, class)``.

    Classes are counted and results compared by class, so that a class of very many items costs no more than others.
    """
    sizes = own.join(classes.groupBy("class").agg(F.count(F.lit(1)).alias("n_gold")), "class").select("query_id", "n_gold")
    return metrics_of(class_hits(results.select("query_id", "id", "rank"), own, classes), sizes, cuts, gain_at)


def without_gold(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries ``(query_id)`` that no gold is given for: what would otherwise shrink the set unseen."""
    return queries.select("query_id").distinct().join(gold.select("query_id").distinct(), "query_id", "left_anti")


def question_set(tiered: DataFrame, order: str) -> DataFrame:
    """Questions ``(source_url, heading_path, tier, ...)`` once a key, the first by ``order``, with ids r0001, r0002 ... in that order.

    The tier is part of the key, so that a place may have a question of each.
    """
    key = ["source_url", "heading_path", "tier"]
    rest = [c for c in tiered.columns if c not in (*key, order)]
    first = tiered.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("q")).select(*key, "q.*")
    ids = numbered(first, [], [order], "n")
    return ids.withColumn("question_id", F.concat(F.lit("r"), F.when(F.col("n") < 10_000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string")))).drop("n")


def slices(scored: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean metrics, rounded to 4 places, over all and by each column of ``by``: one pass of grouping sets."""
    view = scored.select(*by, *metrics)
    sets = [[], *[[F.col(c)] for c in by]]
    return view.groupingSets(sets, *[F.col(c) for c in by]).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def tier(nl_rank: Column, overlap: Column) -> Column:
    """Difficulty of a question by the rank of its source and the words it shares with it; null: dropped."""
    return (
        F.when((nl_rank <= 5) | (overlap >= 0.15), "direct")
        .when((nl_rank <= 20) | (overlap >= 0.04), "paraphrase")
        .when(nl_rank <= 50, "vocabulary_mismatch")
    )


def reference_drift(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """State of stored references ``(ref_id, source_url, heading_path, content_hash, anchor)``: ok, missing, hash mismatch or anchor drift.

    A reference is looked up by URL and heading; among several chunks one with the stored hash is preferred,
    then the smallest id.
    """
    found = gold.alias("g").join(
        chunks.select("chunk_id", "source_url", "heading_path", F.col("content_hash").alias("now_hash"), F.col("anchor").alias("now_anchor")).alias("c"), ["source_url", "heading_path"], "left"
    )
    same = F.coalesce(F.col("now_hash") == F.col("content_hash"), F.lit(False))
    best = found.groupBy("ref_id").agg(F.max_by(F.struct("chunk_id", same.alias("same"), (F.col("now_anchor") == F.col("anchor")).alias("anchored")), F.struct(same, -F.col("chunk_id"))).alias("b"))
    return best.select(
        "ref_id",
        F.when(F.col("b").isNull() | F.col("b.chunk_id").isNull(), "missing").when(F.col("b.same"), "ok").when(F.col("b.anchored"), "hash mismatch").otherwise("anchor drift").alias("state"),
    )


def url_suffix(url: Column) -> Column:
    """What a moved page's URL still ends with: the path behind the host, from its slash on, in lower case."""
    behind = F.regexp_replace(F.regexp_replace(url, r"^/+", ""), r"^.*?//", "")
    return F.lower(F.concat(F.lit("/"), F.regexp_replace(behind, r"^[^/]*/", "")))


def url_suffixes(url: Column) -> Column:
    """All ends of ``url`` that begin with a slash, in lower case: what ``url_suffix`` can be an end of."""
    parts = F.split(F.lower(url), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")))
    return F.when(F.size(parts) > 1, ends)


def _looked_up(refs: DataFrame, keyed: DataFrame, found_by: str) -> DataFrame:
    """``refs`` with the chunk of their ``(heading_path, k)``: one with the stored hash, else the smallest id.

    A frequent heading is one row a key and hash, then one row a key, before anything is joined.
    """
    per = keyed.groupBy("heading_path", "k", F.col("content_hash").alias("now_hash")).agg(F.min("chunk_id").alias("id"))
    first = per.groupBy("heading_path", "k").agg(F.min(F.struct("id", "now_hash")).alias("first"))
    same = per.select("heading_path", "k", F.col("now_hash").alias("content_hash"), F.col("id").alias("same_id"))
    got = refs.join(first, ["heading_path", "k"], "left").join(same, ["heading_path", "k", "content_hash"], "left")
    return got.select(
        "ref_id",
        "source_url",
        "heading_path",
        "package",
        "content_hash",
        F.when(F.col("first").isNotNull(), found_by).alias("found_by"),
        F.coalesce("same_id", "first.id").alias("chunk_id"),
        F.when(F.col("same_id").isNotNull(), F.col("content_hash")).otherwise(F.col("first.now_hash")).alias("now_hash"),
    )


def reference_cascade(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk and state of stored references ``(ref_id, source_url, heading_path, package, content_hash, anchor)``.

    A reference's chunk has its heading and, tried in this order, its URL, a URL that ends with its path (another
    host or version prefix; without regard to case), or any URL in its package, in all packages where it names
    none.  Among several the one with the stored hash is taken, else the smallest id.  ``found_by`` says which
    step it was; null with state 'missing' where none finds a chunk, as for a null heading.  The other states:
    ok, hash mismatch, anchor drift (the text does not contain the anchor), or both.  Null and empty URLs, packages,
    hashes and anchors are not compared.
    """
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    refs = gold.select("ref_id", empty("source_url").alias("source_url"), "heading_path", empty("package").alias("package"), empty("content_hash").alias("content_hash"))
    places = chunks.select("chunk_id", "source_url", "heading_path", "package", "content_hash").where("heading_path is not null")

    done = []
    todo = refs
    for found_by, of_ref, of_chunk in [
        ("url", F.col("source_url"), F.col("source_url")),
        ("suffix", url_suffix(F.col("source_url")), F.explode(url_suffixes(F.col("source_url")))),
        ("heading", F.coalesce("package", F.lit("")), F.explode(F.array_distinct(F.array(F.coalesce("package", F.lit("")), F.lit(""))))),
    ]:
        # the later steps need the headings that are still sought only
        near = places if found_by == "url" else places.join(todo.select("heading_path").distinct(), "heading_path", "left_semi")
        got = written(_looked_up(todo.withColumn("k", of_ref), near.select("chunk_id", "heading_path", "content_hash", of_chunk.alias("k")), found_by))
        done.append(got.where("found_by is not null"))
        todo = got.where("found_by is null").select(*refs.columns)
    found = done[0].union(done[1]).union(done[2])

    # only the chunk's own text can tell whether it contains the anchor
    texts = chunks.select("chunk_id", F.col("content_hash").alias("now_hash"), F.trim(F.regexp_replace("content", r"\s+", " ")).alias("text"))
    asked = found.join(gold.where("anchor <> ''").select("ref_id", "anchor"), "ref_id").select("ref_id", F.col("chunk_id").alias("of"), F.col("now_hash").alias("of_hash"), "anchor")
    at = asked.join(texts, (F.col("of") == F.col("chunk_id")) & F.col("of_hash").eqNullSafe(F.col("now_hash")), "left")
    held = at.groupBy("ref_id").agg(F.coalesce(F.max(F.contains("text", "anchor")), F.lit(False)).alias("held"))
    moved = F.coalesce(F.col("content_hash") != F.nullif(F.col("now_hash"), F.lit("")), F.lit(False))
    lost = ~F.coalesce("held", F.lit(True))  # without an anchor there is nothing to be lost
    state = F.when(F.col("chunk_id").isNull(), "missing").when(moved & lost, "hash mismatch, anchor drift").when(moved, "hash mismatch").when(lost, "anchor drift").otherwise("ok")
    missing = todo.withColumns({"found_by": F.lit(None).cast("string"), "chunk_id": F.lit(None).cast("long"), "now_hash": F.lit(None).cast("string")})
    return found.unionByName(missing).join(held, "ref_id", "left").select("ref_id", "found_by", "chunk_id", state.alias("state"))


def gold_chunks(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks ``(ref_id, chunk_id)`` of references ``(ref_id, package, source_path, heading_path)``: same package and heading, a URL that ends with the path.

    A reference without any has one row with a null chunk.  A null URL ends with an empty path alone.
    """
    c = chunks.select("chunk_id", "package", "heading_path", F.coalesce("source_url", F.lit("")).alias("url"))
    got = gold.select("ref_id", "package", "heading_path", "source_path").join(c, ["package", "heading_path"]).where(F.endswith("url", "source_path")).select("ref_id", "chunk_id")
    return gold.select("ref_id").distinct().join(got.distinct(), "ref_id", "left")
