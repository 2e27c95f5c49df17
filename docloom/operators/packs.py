"""Packs as tables: hash chain, counts, sizes, duplicates, import, removal, state against a lock."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import numbered

KEY = ["package", "version"]


def pack_hashes(chunks: DataFrame, text: str = "content", order: str = "id") -> DataFrame:
    """SHA-256 over each pack's texts in order of ``order``, joined by newlines: ``package, version, pack_hash``.

    The hash is sequential by definition.  A pack's rows meet sorted in one task and pass through it one batch
    at a time, so that memory does not grow with the pack; packs are spread over tasks.  Null texts are empty;
    rows repeated with one order and text count once.
    """
    rows = chunks.select(*KEY, F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    sorted_ = rows.repartition(*KEY).sortWithinPartitions(*KEY, "o", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for p, v, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (p, v) != key:
                    if state is not None:
                        done.append((*key, "sha256:" + state.hexdigest()))
                    key, state = (p, v), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(t.encode())
        if state is not None:
            done.append((*key, "sha256:" + state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], "string") for i in range(3)], [*KEY, "pack_hash"])

    return sorted_.mapInArrow(run, "package string, version string, pack_hash string")


def pack_tree_hashes(chunks: DataFrame, text: str = "content", order: str = "id", width: int = 4096, levels: int = 3) -> DataFrame:
    """A pack's hash that no single task has to compute: ``package, version, tree_hash``.

    Every text is hashed where it lies; the hashes of ``width`` ids in a row are joined in order and hashed, then those
    of ``width`` such ranges, ``levels`` times in all, the last over the whole pack.  Null texts are empty; rows repeated with one
    order and text count once.
    """
    rows = chunks.select(*KEY, F.col(order).alias("o"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")).distinct()
    for level in range(levels):
        up = F.floor(F.col("o") / width) if level < levels - 1 else F.lit(0)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n")
        rows = rows.groupBy(*KEY, up.alias("up")).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("up", "o")
    return rows.select(*KEY, F.concat(F.lit("sha256:"), "h").alias("tree_hash"))


def pack_counts(chunks: DataFrame) -> DataFrame:
    """Chunks, pages and estimated tokens of each pack, rows delivered again counted once."""
    once = chunks.select(*KEY, "id", "page_id", F.expr("length(content) div 4").alias("tokens")).distinct()
    return once.groupBy(*KEY).agg(F.count_distinct("id").alias("n_chunks"), F.count_distinct("page_id").alias("n_pages"), F.sum("tokens").alias("n_tokens"))


def size_stats(sizes: DataFrame, by: list[str], size: str, warn: int = 1600, shares: tuple[int, ...] = (95, 99)) -> DataFrame:
    """Count, sum, maximum, number above ``warn`` and order statistics ``sorted[min(int(n * p / 100), n - 1)]``.

    Order statistics come from the counts of each size, summed up in order of size, so that no group is
    collected; a group's window has as many rows as it has different sizes.
    """
    counts = sizes.where(F.col(size).isNotNull()).groupBy(*by, F.col(size).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("n", F.sum("c").over(whole)).withColumn("upto", F.sum("c").over(upto))
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("v"))).alias(f"p{p}") for p in shares]
    return ranked.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.max("v").alias("largest"), F.sum(F.when(F.col("v") > warn, F.col("c")).otherwise(0)).alias("n_over"), *picks
    )


def oversized(chunks: DataFrame, warn: int = 1600) -> DataFrame:
    """Chunks of more than ``warn`` estimated tokens, rows delivered again once."""
    return chunks.select("id", *KEY, "heading_path", F.expr("length(content) div 4").alias("tokens")).where(F.col("tokens") > warn).distinct()


def duplicate_contents(chunks: DataFrame) -> DataFrame:
    """Contents that stand under several ids: hash, number of ids and packs, smallest id."""
    once = chunks.select("id", *KEY, F.sha2("content", 256).alias("hash")).distinct()
    return once.groupBy("hash").agg(F.count_distinct("id").alias("n_ids"), F.count_distinct("package").alias("n_packages"), F.min("id").alias("first_id")).where("n_ids > 1")


def hash_mismatches(rows: DataFrame, text: str, stored: str) -> DataFrame:
    """Rows whose stored hash is not that of their text; a null hash is none to be held against."""
    return rows.where(F.col(stored).isNotNull() & (F.col(stored) != F.concat(F.lit("sha256:"), F.sha2(F.col(text), 256))))


def violations(rows: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row for each record and check that it fails: ``keys, violation``; a null check counts as failed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(failed).alias("violation"))


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of rows delivered several times, the one delivered last (of equal times the largest in its other columns)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def stored_packs(spark: SparkSession, store: str) -> list[tuple[str, str]]:
    """Packs of a store, by the names of its folders; no file is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/package=*/version=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [tuple(unquote(part.getName().split("=", 1)[1]) for part in (f.getPath().getParent(), f.getPath())) for f in found]


def import_packs(store: str, chunks: DataFrame) -> int:
    """Append the packs of ``chunks`` that ``store`` (a Parquet folder by package and version) does not have; how many.

    A pack that is there already is left as it is.  Files become visible when the write commits.
    """
    spark = chunks.sparkSession
    wanted = chunks.select(*KEY).distinct()
    there = spark.createDataFrame(stored_packs(spark, store), "package string, version string")  # a row a pack
    new = wanted.join(there, KEY, "left_anti").cache()
    n = new.count()
    if n:
        chunks.join(F.broadcast(new) if n < 100_000 else new, KEY).write.mode("append").partitionBy(*KEY).parquet(store)
    new.unpersist()
    return n


def lock_state(lock: DataFrame, packages: DataFrame) -> DataFrame:
    """State of each locked ``(name, version, pack_digest)``: missing, digest mismatch or present."""
    have = packages.select("name", "version", F.col("pack_digest").alias("have")).distinct()
    per = lock.join(have, ["name", "version"], "left").groupBy("name", "version", "pack_digest").agg(F.count("have").alias("n"), F.coalesce(F.bool_or(F.col("have") == F.col("pack_digest")), F.lit(False)).alias("same"))
    return per.select("name", "version", "pack_digest", F.when(F.col("n") == 0, "missing").when(F.col("same"), "present").otherwise("digest mismatch").alias("state"))


def remove_pack(spark: SparkSession, store: str, package: str, version: str) -> bool:
    """Take one pack's partition out of ``store``; whether it was there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/package={package}/version={version}")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def sampled(chunks: DataFrame, n: int, seed: str = "1", least: int = 100) -> DataFrame:
    """``n`` chunks of at least ``least`` characters outside change logs and indexes, the same for one seed."""
    fit = chunks.where((F.length("content") >= least) & ~F.coalesce(F.col("heading_path"), F.lit("")).rlike("(?i)changelog|index$|release notes"))
    return fit.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("chunk_id").cast("string"))), "chunk_id").limit(n)


def remapped(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunks`` with ``store_page_id``: their page's id in one id space for all packs; null where the pack has no such page.

    ``pages (package, version, id)``; ids of a store count from 1 in order of package, version and id.
    """
    ids = numbered(pages.select(*KEY, F.col("id").alias("page_id")).distinct(), [], [*KEY, "page_id"], "store_page_id")
    return chunks.join(ids, [*KEY, "page_id"], "left")


def reconciled(refs: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """What two tables disagree about: ``key, state, n``.

    'unknown' for references to no target (``n`` of them), 'repeated' for targets referred to more than once, 'missing' for
    targets not referred to at all.  Null keys refer to nothing.
    """
    counted = refs.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    there = targets.dropna(subset=key).select(*key).distinct().withColumn("__there", F.lit(True))
    both = counted.join(there, key, "full_outer")
    state = F.when(F.col("__there").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(*key, state.alias("state"), F.coalesce("n", F.lit(0)).alias("n")).where("state is not null")


def statement_findings(rows: DataFrame, row_id: str, text: str, name: str, hard: tuple[int, int] = (8, 35), soft: tuple[int, int] = (10, 30), begins: tuple[str, ...] = ()) -> DataFrame:
    """Findings on one-line statements: ``row_id, severity, finding``.

    Failures: empty, of several lines, fewer or more words than ``hard``, another beginning than ``begins`` allows, naming
    ``name``; warnings: fewer or more words than ``soft``.  Length is not judged twice.
    """
    said = F.btrim(F.col(text), F.lit(" \n\t\r"))
    n = F.size(F.regexp_extract_all(said, F.lit(r"\S+"), F.lit(0)))
    full = said != ""
    found = [
        ("failure", "empty", ~full),
        ("failure", "lines", full & said.contains("\n")),
        ("failure", "words", full & ~n.between(*hard)),
        ("warning", "words", full & n.between(*hard) & ~n.between(*soft)),
        ("failure", "beginning", full & ~F.lower(said).rlike("^(?:" + "|".join(begins) + ")") if begins else F.lit(False)),
        ("failure", "name", full & F.array_contains(F.regexp_extract_all(F.lower(said), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower(F.col(name)))),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(f).alias("finding"))) for s, f, c in found]))
    return rows.select(row_id, F.explode(each).alias("f")).select(row_id, "f.severity", "f.finding")


def first_of(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The first ``k`` values of each group in order, and how many more there are: ``by, first, more``."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(value))).where(F.col("r") <= k)
    shown = top.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("first"))
    return shown.join(n, by).select(*by, "first", F.greatest(F.lit(0).cast("long"), F.col("n") - k).alias("more"))
