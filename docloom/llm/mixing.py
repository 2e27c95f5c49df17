"""Mixing sources to target weights, in blocks of tokens.

Each source's documents, in a fixed pseudorandom order, are cut into blocks of ``block`` tokens.  The shares
each source can give under its cap of repeats are settled first: a source that falls short gives all it
has, and the others share what is left by their targets.  Then every output shard draws multinomial counts
of blocks per source; the n-th block drawn from a source in all is looked up in a pseudorandom permutation
of its block numbers, a new one for each round through the source; and the slots join the blocks by number.
Slots drawn over a source's cap are drawn again from the sources with room left, until every slot is placed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running_sum
from ..session import written
from .tokens import token_sizes

BLOCK, SLOTS_PER_SHARD, SEED = 1024, 1024, 20240501


def settle_shares(target: dict[str, float], limit: dict[str, int], total: int) -> dict[str, float]:
    """Blocks each source gives: its share of ``total``, at most its limit; what is short goes to the others by target."""
    given = {s: 0.0 for s in target}
    open_ = {s for s in target if limit.get(s, 0) > 0 and target[s] > 0}
    left = float(min(total, sum(limit.get(s, 0) for s in open_)))
    while open_ and left > 1e-9:
        weight = sum(target[s] for s in open_)
        full = {s for s in open_ if left * target[s] / weight >= limit[s]}
        for s in full or open_:
            given[s] = float(limit[s]) if full else left * target[s] / weight
        if not full:
            break
        left -= sum(limit[s] for s in full)
        open_ -= full
    return given


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 for each ``key``: a Feistel network, walked on until it is below n."""
    index, n, key = (np.asarray(x).astype("uint64") for x in (index, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype("float64"))) + 1).astype("uint64") // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        h, m, k = half[at], mask[at], key[at]
        a, b = x >> h, x & m
        for r in range(4):
            v = b * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r * 0x632BE5AB)
            v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((v ^ (v >> np.uint64(32))) & m)
        return (a << h) | b

    with np.errstate(over="ignore"):
        out = index.copy()
        at = np.arange(len(out))
        while len(at):
            out[at] = once(out[at], at)
            at = at[out[at] >= n[at]]
    return out.astype("int64")


def source_blocks(df: DataFrame, *, item_id: str, source: str, text: str, block: int = BLOCK, rows_per_bucket: int = 100_000, **tokenizer) -> DataFrame:
    """Pieces of items in blocks: ``source, block_no, item_id, token_from, token_to`` (within the item)."""
    sized = written(
        token_sizes(df.where(F.col(source).isNotNull()), keys=[item_id, source], text=text, **tokenizer)
        .select(F.col(item_id).alias("item_id"), F.col(source).alias("source"), "n_tokens")
        .where("n_tokens > 0")
    )
    # running number of tokens within the source, without a task per source
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-largest // rows_per_bucket)))).cast("int"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("item_id", F.lit(7)), "item_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("end", F.sum("n_tokens").over(inside))
    totals = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    spans = local.join(before, ["source", "bucket"]).select("source", "item_id", "n_tokens", (F.col("before") + F.col("end") - F.col("n_tokens")).alias("start"))
    cut = spans.withColumn("block_no", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n_tokens - 1) div {block}"))))
    return cut.select(
        "source",
        "block_no",
        "item_id",
        F.greatest(F.lit(0).cast("long"), F.col("block_no") * block - F.col("start")).alias("token_from"),
        F.least(F.col("n_tokens"), (F.col("block_no") + 1) * block - F.col("start")).alias("token_to"),
    )


def mix(
    df: DataFrame,
    targets: DataFrame,
    *,
    item_id: str,
    source: str,
    text: str,
    total_tokens: int | None = None,
    block: int = BLOCK,
    slots_per_shard: int = SLOTS_PER_SHARD,
    seed: int = SEED,
    **tokenizer,
) -> DataFrame:
    """The mix's pieces: ``shard, slot, source, block_no, round, item_id, token_from, token_to``.

    ``targets`` has ``source, target_share, max_repeats``, one row a source (a bounded table; of repeated rows
    the largest share and smallest cap hold; null shares or caps count as 0).  Sources not listed, null
    sources and empty texts are not used; a listed source without documents gives nothing.  ``total_tokens``
    is as much as the listed sources' documents have, if not given.  No token is used more than
    ``max_repeats`` times, so no document is.  A source's last block may be short.
    """
    spark = df.sparkSession
    wanted = {
        r["source"]: (float(r["share"] or 0), int(r["cap"] or 0))
        for r in targets.groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()
        if r["source"] is not None
    }
    listed = df.where(F.col(source).isin(list(wanted))) if wanted else df.limit(0)
    blocks = written(source_blocks(listed, item_id=item_id, source=source, text=text, block=block, **tokenizer))
    have = {r["source"]: (r["n"], r["tokens"]) for r in blocks.groupBy("source").agg((F.max("block_no") + 1).alias("n"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens")).collect()}
    total = -(-(total_tokens if total_tokens is not None else sum(t for _, t in have.values())) // block)
    limit = {s: have[s][0] * wanted[s][1] for s in have}
    given = settle_shares({s: wanted[s][0] for s in wanted}, limit, total)
    names = sorted(s for s in given if given[s] > 0)
    slots = round(sum(given.values()))
    empty = "shard long, slot long, source string, block_no long, round int, item_id {}, token_from long, token_to long".format(dict(blocks.dtypes)["item_id"])
    if not slots:
        return spark.createDataFrame([], empty)
    p = np.array([given[s] for s in names]) / sum(given.values())
    n_shards = -(-slots // slots_per_shard)
    room = np.array([limit[s] for s in names], "int64")

    def draw(weights: np.ndarray, salt: int, column: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                counts = [np.random.default_rng([seed, salt, int(k)]).multinomial(int(n), weights) for k, n in zip(batch["shard"], batch[column])]
                yield pd.DataFrame({"shard": np.repeat(batch["shard"].to_numpy(), len(names)), "kind": np.tile(np.arange(len(names)), len(batch)), "n": np.concatenate(counts) if counts else []})

        return run

    caps = spark.createDataFrame([(i, names[i], int(room[i])) for i in range(len(names))], "kind long, source string, room long")
    shards = spark.range(n_shards).select(F.col("id").alias("shard"), F.least(F.lit(slots_per_shard).cast("long"), F.lit(slots) - F.col("id") * slots_per_shard).alias("n_slots"))
    drawn = written(shards.mapInPandas(draw(p, 1, "n_slots"), "shard long, kind long, n long"))
    # what goes over a source's room is drawn again from those with room left, until no slot is over
    for turn in itertools.count(2):
        used = {r["kind"]: r["n"] for r in drawn.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a row a source
        left = np.array([room[i] - used.get(i, 0) for i in range(len(names))], "int64")
        if (left >= 0).all():
            break
        excess, left = -left.clip(max=0).sum(), left.clip(min=0)
        free = np.where(left > 0, p, 0.0) / p[left > 0].sum()
        if (excess * free > left).any():  # the targets would fill some of them up: by room, then
            free = left / left.sum()
        ends = running_sum(drawn.join(F.broadcast(caps), "kind"), ["kind"], "shard", "n", "end")
        fits = written(ends.withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), F.col("room") - (F.col("end") - F.col("n"))))))
        over = fits.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("n_slots")).where("n_slots > 0")
        again = over.mapInPandas(draw(free, turn, "n_slots"), "shard long, kind long, n long")
        drawn = written(fits.select("shard", "kind", F.col("kept").alias("n")).union(again).groupBy("shard", "kind").agg(F.sum("n").alias("n")))
    numbered = running_sum(drawn.join(F.broadcast(caps), "kind"), ["kind"], "shard", "n", "end").withColumn("start", F.col("end") - F.col("n"))
    size = np.array([have[s][0] for s in names], "int64")

    @F.pandas_udf("block_no long, round int")
    def look_up(kind: pd.Series, number: pd.Series) -> pd.DataFrame:
        n = size[kind.to_numpy()]
        turn = number.to_numpy() // n
        with np.errstate(over="ignore"):
            key = (kind.to_numpy().astype("uint64") * np.uint64(0xD1342543DE82EF95)) ^ (turn.astype("uint64") * np.uint64(0xA24BAED4963EE407)) ^ np.uint64(seed)
        return pd.DataFrame({"block_no": permuted(number.to_numpy() % n, n, key), "round": turn.astype("int32")})

    slot = (
        numbered.where("end > start")
        .select("shard", "kind", "source", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("number"))
        .withColumn("at", look_up("kind", "number"))
        .select("shard", "source", "number", F.col("at.block_no").alias("block_no"), F.col("at.round").alias("round"))
        .withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("source", "number"))).cast("long") - 1)
    )
    return slot.join(blocks, ["source", "block_no"]).select("shard", "slot", "source", "block_no", "round", "item_id", "token_from", "token_to")


def mixed_documents(pieces: DataFrame) -> DataFrame:
    """Chosen items: how often each is used (at most; a block's edge may cut it) and with how many tokens in all."""
    at = pieces.groupBy("source", "item_id", "token_from").agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    return at.groupBy("source", "item_id").agg(F.max("times").alias("repeats"), F.sum("tokens").alias("n_tokens"))


def share_report(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and actual share per listed source; 0 where a source gave nothing."""
    got = pieces.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    joined = targets.groupBy("source").agg(F.max("target_share").alias("wanted_share"), F.min("max_repeats").alias("max_repeats")).join(got, "source", "left")
    given = joined.withColumn("n_tokens", F.coalesce(F.col("n"), F.lit(0)))
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # a row a source
    return given.select("source", "wanted_share", F.coalesce(F.try_divide("n_tokens", whole), F.lit(0.0)).alias("actual_share"), "n_tokens", "max_repeats")
