"""Reports over runs, replies and responses, as aggregates and outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def persona_queries(reply: Column) -> Column:
    """Four non-blank lines of a reply as two ``(persona, nl_query, keyword_query)``, missing ones empty."""
    lines = F.transform(F.filter(F.split(reply, "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    return F.array(*[F.struct(F.lit(p).alias("persona"), line(i).alias("nl_query"), line(i + 1).alias("keyword_query")) for p, i in (("expert", 0), ("paraphrase", 2))])


def shared_terms(queries: DataFrame, key: list[str]) -> DataFrame:
    """Terms that the expert's and the paraphrased query of one chunk share: ``key, shared``."""
    words = queries.select(*key, "persona", F.array_distinct(F.filter(F.split(F.lower("nl_query"), r"\W+"), lambda w: w != "")).alias("w"))
    pair = words.groupBy(*key).agg(F.max(F.when(F.col("persona") == "expert", F.col("w"))).alias("a"), F.max(F.when(F.col("persona") == "paraphrase", F.col("w"))).alias("b"))
    return pair.select(*key, F.array_sort(F.coalesce(F.array_intersect("a", "b"), F.array().cast("array<string>"))).alias("shared"))


def missing_kinds(keys: DataFrame, present: DataFrame, key: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Combinations of ``keys`` and the given ``kinds`` that ``present`` lacks."""
    wanted = keys.select(*key).distinct().withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds])))
    return wanted.join(present.select(*key, kind).distinct(), [*key, kind], "left_anti")


def graded(replies: DataFrame, reply: str, must: list[str], must_not: list[str]) -> DataFrame:
    """``replies`` with all failures of patterns that must, or must not, be found; a null reply fails every must."""
    text = F.coalesce(F.col(reply), F.lit(""))
    failed = [F.when(~text.rlike(p), F.lit(f"missing: {p}")) for p in must] + [F.when(text.rlike(p), F.lit(f"forbidden: {p}")) for p in must_not]
    failures = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return replies.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def pass_rates(runs: DataFrame) -> DataFrame:
    """Pass rate and latency of each arm of ``runs (arm, passed, latency)``."""
    return runs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.avg("latency").alias("mean_latency"), F.sum("latency").alias("total_latency")
    )


def convergence(runs: DataFrame) -> DataFrame:
    """Share of ``runs (arm, answered_at, passed)`` answered and right by each turn; null ``answered_at``: not answered.

    One row an arm and turn up to the arm's last answer: ``arm, turn, answered, right``.
    """
    per = runs.groupBy("arm", F.col("answered_at").alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("int")).alias("p"))
    whole, upto = Window.partitionBy("arm"), Window.partitionBy("arm").orderBy("turn")
    sums = per.withColumn("all", F.sum("n").over(whole)).where("turn is not null")
    turns = sums.groupBy("arm", "all").agg(F.max("turn").alias("last")).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("last").cast("int")))).select("arm", "all", "turn")
    filled = turns.join(sums.select("arm", "turn", "n", "p"), ["arm", "turn"], "left").fillna(0, ["n", "p"])
    return filled.select("arm", "turn", (F.sum("n").over(upto) / F.col("all")).alias("answered"), (F.sum("p").over(upto) / F.col("all")).alias("right"))


def compared(before: DataFrame, after: DataFrame, name: str, value: str, warn_over: dict[str, float] | None = None, warn_under: dict[str, float] | None = None) -> DataFrame:
    """Two measurements side by side: ``name, before, after, change_percent, warning``.

    One that is missing counts as 0, a change from 0 as null.  A warning says that a change is over its name's percentage
    in ``warn_over``, or the new value under its floor in ``warn_under``.
    """
    both = before.select(name, F.col(value).alias("before")).join(after.select(name, F.col(value).alias("after")), name, "full_outer").fillna(0, ["before", "after"])
    changed = both.withColumn("change_percent", F.try_divide((F.col("after") - F.col("before")) * 100, F.col("before")))
    limit = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(name)) if m else F.lit(None).cast("double")
    warning = F.when(F.col("change_percent") > limit(warn_over), "grown").when(F.col("after") < limit(warn_under), "too small")
    return changed.withColumn("warning", warning)


def response_cost(results: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Estimated tokens of each query's results as JSON, in all and a result; Spark writes JSON without spaces."""
    cost = F.length(F.to_json(F.struct(*fields)))
    return results.groupBy(by).agg(F.floor(F.sum(cost) / 4).alias("tokens"), F.count(F.lit(1)).alias("n_results")).withColumn("tokens_each", F.col("tokens") / F.col("n_results"))


def disclosure_saving(naive: Column, listed: Column, fetched: Column) -> Column:
    """Percent saved by listing first and fetching what is wanted, against fetching all."""
    return F.try_divide((naive - listed - fetched) * 100, naive)
