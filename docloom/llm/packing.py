"""Filling containers of fixed capacity: best fit, planned on the histogram of lengths.

There are at most ``capacity`` different lengths, so best-fit decreasing runs over counts: equal containers
are one entry of the plan, whatever their number.  The plan's rows say which ranks of a length go to which
containers; items find theirs by joining on their rank within their length.  Only ids and lengths move.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .tokens import rank_within, token_sizes

CAPACITY = 2048
#: a plan up to this number of rows is broadcast (56 bytes each); it does not depend on the number of items
MAX_BROADCAST_PLAN = 500_000
PLAN = T.StructType(
    [
        T.StructField(n, T.LongType(), False)
        for n in ("length", "rank_from", "rank_to", "container_from", "each", "position_from", "offset_from")
    ]
)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[Row]:
    """Best-fit decreasing over ``counts`` of lengths 1 to ``capacity``.

    A row places the ranks ``rank_from`` to ``rank_to - 1`` of a length, ``each`` of them into one container
    after the other from ``container_from`` on.
    """
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room left -> (first container, how many, items in each)
    rooms: list[int] = []  # the keys of groups, sorted
    rows: list[Row] = []
    opened = 0

    def keep(room: int, first: int, n: int, items: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n, items))

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n, items = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, items = capacity, 0
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append(Row(length, rank, rank + full * each, first, each, items, capacity - room))
                keep(room - each * length, first, full, items + each)
                left, rank = left - full * each, rank + full * each
            if left and full < n:
                rows.append(Row(length, rank, rank + left, first + full, left, items, capacity - room))
                keep(room - left * length, first + full, 1, items + left)
                full, left = full + 1, 0
            keep(room, first + full, n - full, items)
    return rows


def pack(df: DataFrame, *, item_id: str, text: str, capacity: int = CAPACITY, rows_per_bucket: int = 100_000, **tokenizer) -> DataFrame:
    """Places of all non-empty items: ``container, position, item_id, part, token_start, n_tokens, offset``.

    Containers and positions count from 0; ``offset`` is the place in the container's tokens.  An item above
    ``capacity`` is divided: parts that fill a container, and a rest that is placed like any item.  Null and
    empty texts are left out.  Rows repeated as a whole are items of their own; a null id is an id.
    """
    spark = df.sparkSession
    sized = written(token_sizes(df, keys=[item_id], text=text, **tokenizer).select(F.col(item_id).alias("item_id"), "n_tokens").where("n_tokens > 0"))
    items = sized.select(
        "item_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {capacity}"))).alias("part")
    ).select("item_id", "part", (F.col("part") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("long").alias("length"))
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most one row a length
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), PLAN)
    ranked = rank_within(items, ["length"], ["item_id", "part"], "rank", rows_per_bucket, largest=max(counts.values(), default=0))
    if plan.count() <= MAX_BROADCAST_PLAN:
        plan = F.broadcast(plan)
    p, r = plan.alias("p"), ranked.alias("r")
    here = F.col("r.rank") - F.col("p.rank_from")
    return r.join(p, (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.rank_from")) & (F.col("r.rank") < F.col("p.rank_to"))).select(
        (F.col("p.container_from") + F.floor(here / F.col("p.each"))).alias("container"),
        (F.col("p.position_from") + here % F.col("p.each")).alias("position"),
        F.col("r.item_id").alias("item_id"),
        F.col("r.part").alias("part"),
        F.col("r.token_start").alias("token_start"),
        F.col("r.length").alias("n_tokens"),
        (F.col("p.offset_from") + here % F.col("p.each") * F.col("r.length")).alias("offset"),
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: number of containers, of items, of tokens, and the share of the space that is filled."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("filled"), F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_items"),
        F.sum("filled").alias("n_tokens"),
        F.max("filled").alias("fullest"),
        (F.sum("filled") / (F.count(F.lit(1)) * capacity)).alias("fill_share"),
    )
