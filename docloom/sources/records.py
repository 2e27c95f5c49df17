"""Record files: strict JSON lines, summary caches with a header, question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GOLD = "id string, difficulty string, query string, keyword_query string, gold array<struct<source_path:string,source_url:string,heading_path:string,content_hash:string,anchor:string>>"
DIFFICULTIES = ("direct", "paraphrase", "vocabulary_mismatch")


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of a JSON-lines file; a malformed line fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_summary_cache(spark: SparkSession, path: str, prompt_version: str, model: str) -> DataFrame:
    """``content_hash, cached`` of a cache whose header names this prompt and model; another header is an error."""
    rows = read_json_lines(spark, path, "prompt_version string, model string, content_hash string, summary string")
    heads = rows.where("content_hash is null").select("prompt_version", "model").limit(2).collect()
    if [tuple(h) for h in heads] != [(prompt_version, model)]:
        raise ValueError(f"the cache was made otherwise: {[tuple(h) for h in heads]}")
    return rows.where("content_hash is not null").select("content_hash", F.col("summary").alias("cached"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a question set, one row a gold reference: ``id, difficulty, query, keyword_query, gold.*``."""
    sets = spark.read.schema(f"schema_version int, questions array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _split(GOLD))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    q = sets.select(F.explode("questions").alias("q")).select("q.*")
    wrong = q.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max((~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False))).cast("int")).alias("bad"), F.min(F.size("gold")).alias("g")).where("n > 1 or bad = 1 or g < 1 or id is null")
    found = [r["id"] for r in wrong.limit(5).collect()]
    if found:
        raise ValueError(f"questions repeated, without gold or of unknown difficulty: {found}")
    return q.withColumn("gold", F.explode("gold")).select("id", "difficulty", "query", "keyword_query", "gold.*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with their graders: ``id, prompt, must_parse, must_match, must_not_match, teaches``.

    A task without id, prompt or graders, repeated, or with a pattern that is no pattern is an error.
    """
    graders = "struct<must_parse:boolean,must_match:array<string>,must_not_match:array<string>>"
    sets = spark.read.schema(f"tasks array<struct<id:string,prompt:string,graders:{graders},teaches:array<string>>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    t = sets.select(F.explode("tasks").alias("t")).select("t.id", "t.prompt", "t.graders.*", "t.teaches", F.col("t.graders").isNull().alias("bare"))
    none = F.array().cast("array<string>")
    patterns = F.concat(F.coalesce("must_match", none), F.coalesce("must_not_match", none))
    odd = F.exists(patterns, lambda p: p.isNull() | (p == ""))
    each = t.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("bare") | odd | F.coalesce(F.trim("prompt") == "", F.lit(True))).alias("bad"))
    found = [r["id"] for r in each.where("n > 1 or bad or id is null").limit(5).collect()]
    if found:
        raise ValueError(f"tasks repeated or without prompt, graders or patterns: {found}")
    return t.drop("bare")


def _split(ddl: str) -> list[str]:
    """Fields of a DDL string, commas inside brackets kept."""
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]
