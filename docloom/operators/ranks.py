"""Ranks and order statistics within groups that may be large, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Sum of ``value`` up to and with each row of its group in order of the columns ``order`` (unique within it).

    Rows are put in order in ranges over all groups; a group is summed up range by range, so that none, however
    large, meets in one task.
    """
    keys = [*group, *order]
    placed = written(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    inner = placed.withColumn(into, F.sum(value).over(Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy("__range", *group).agg(F.sum(value).alias("__s"))
    before = sums.withColumn("__lower", F.sum("__s").over(Window.partitionBy(*(group or [F.lit(1)])).orderBy("__range")) - F.col("__s")).drop("__s")  # a row a group and range
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["__range", *group]]
    return inner.alias("l").join(before.alias("r"), on).select("l.*", "r.__lower").withColumn(into, F.col(into) + F.col("__lower")).drop("__lower", "__range")


def numbered(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Dense numbers from 1 within ``group`` (all rows, if empty) in order of the columns ``order``, unique within it."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), group, order, "__one", into).drop("__one")


def numbered_in_order(parts: DataFrame, group: list[str], outer: list[str], inner: str, into: str) -> DataFrame:
    """Dense numbers from 1 within ``group`` in the order of ``outer`` (say pages) and ``inner`` (a number from 0 within it).

    Only the counts of the outer items are ordered; their parts are lifted by what lies before.
    """
    counts = parts.groupBy(*group, *outer).agg((F.max(inner) + 1).cast("long").alias("__n"))
    before = running_total(counts, group, outer, "__n", "__before").withColumn("__before", F.col("__before") - F.col("__n")).drop("__n")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, *outer]]
    return parts.alias("l").join(before.alias("r"), on).select("l.*", (F.col("r.__before") + F.col(f"l.{inner}") + 1).alias(into))


def order_statistics(df: DataFrame, by: list[str], value: str, picks: dict[str, Column], buckets: int = 256) -> DataFrame:
    """Exact order statistics of ``value`` in each group: ``by, n`` and one column a pick.

    A pick is an expression of ``n`` giving the index, from 0, in the sorted values.  Approximate quantiles cut
    a group into buckets; the buckets' counts say where an index falls, and only values there are ranked,
    equal ones as one.  Null values do not count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cuts = counted.groupBy(*by).agg(
        F.sum("c").alias("n"), F.array_distinct(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], buckets * 20)).alias("cuts")
    )
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]

    def join(a: DataFrame, b: DataFrame, *more: Column) -> DataFrame:
        keep = [c for c in b.columns if c not in by]
        return a.alias("l").join(b.alias("r"), [*on, *more]).select("l.*", *[f"r.{c}" for c in keep])

    placed = join(counted, cuts).withColumn("b", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    sums = placed.groupBy(*by, "b", "n").agg(F.sum("c").alias("s"))
    upto = sums.withColumn("before", F.sum("s").over(Window.partitionBy(*by).orderBy("b")) - F.col("s"))
    wanted = upto.withColumn("k", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in picks.items()])))
    wanted = wanted.where((F.col("k.at") >= F.col("before")) & (F.col("k.at") < F.col("before") + F.col("s"))).select(*by, F.col("b").alias("wb"), "before", "k")
    inside = join(placed, wanted, F.col("l.b") == F.col("r.wb"))
    run = F.sum("c").over(Window.partitionBy(*by, "b", "k").orderBy("v")) + F.col("before")
    found = inside.withColumn("upto", run).where(F.col("k.at") < F.col("upto")).groupBy(*by, "n", "k.name").agg(F.min("v").alias("v"))
    return found.groupBy(*by, "n").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in picks])


def running_sum(df: DataFrame, by: list[str], order: str, value: str, into: str, span: int = 4096) -> DataFrame:
    """Sum of ``value`` up to and with each row, in order of the whole number ``order`` (unique within ``by``).

    Rows are summed within spans of the order, and the spans' sums are what is run over.
    """
    cut = df.withColumn("__span", F.floor(F.col(order) / span))
    inner = cut.withColumn(into, F.sum(value).over(Window.partitionBy(*by, "__span").orderBy(order)))
    spans = cut.groupBy(*by, "__span").agg(F.sum(value).alias("__s"))
    before = spans.withColumn("__before", F.sum("__s").over(Window.partitionBy(*by).orderBy("__span")) - F.col("__s")).drop("__s")
    return inner.join(before, [*by, "__span"]).withColumn(into, F.col(into) + F.col("__before")).drop("__span", "__before")
