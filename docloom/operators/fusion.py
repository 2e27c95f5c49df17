"""Vector search in blocks and fusion of ranked lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

RRF_K, DEPTH = 60, 100


def cosine_top(queries: DataFrame, rows: DataFrame, k: int = 10, query_block: int = 8192, row_block: int = 4096, skip_self: bool = False) -> DataFrame:
    """Exact best ``k`` of ``rows (id, embedding)`` for each of ``queries (query_id, embedding)``: ``query_id, id, score, rank``.

    Both sides are cut into blocks; a task multiplies a block of queries with a block of rows and keeps its
    best, which are merged per query.  Rows are copied once for every ``query_block`` queries, queries once for every
    ``row_block`` rows.  Null and zero vectors match nothing; equal scores (to 6 digits) go by id.
    """

    def parts(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    nq, nr = parts(queries, query_block), parts(rows, row_block)
    q = queries.where("embedding is not null").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"))
    r = rows.where("embedding is not null").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int").alias("rb"))
    q = q.select("query_id", F.col("embedding").alias("wanted"), "qb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    r = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        flat = t.column(name).combine_chunks()
        m = flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(t.num_rows, -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        qi, ri = a.column("query_id").to_numpy(), b.column("id").to_numpy()
        parts_ = []
        if len(qi) and len(ri):
            by_id = np.argsort(ri, kind="stable")
            ri = ri[by_id]
            every, y = matrix(a, "wanted"), matrix(b, "embedding")[by_id]
            for at in range(0, len(qi), 256):
                x, own = every[at : at + 256], qi[at : at + 256]
                s = np.round(x @ y.T, 6)
                s[:, ~y.any(1)] = -np.inf
                s[~x.any(1)] = -np.inf
                if skip_self:
                    s[own[:, None] == ri[None, :]] = -np.inf
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # columns are in order of id
                rows_, cols = np.repeat(np.arange(len(own)), order.shape[1]), order.reshape(-1)
                score = s[rows_, cols]
                ok = np.isfinite(score)
                parts_.append((own[rows_][ok], ri[cols][ok], score[ok]))
        got = [np.concatenate(c) for c in zip(*parts_)] if parts_ else [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
        return pa.table({"query_id": got[0], "id": got[1], "score": got[2]})

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(block, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top_shared(queries: DataFrame, rows: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``cosine_top`` of ``queries (query_id, vec)`` and ``rows (id, vec)`` that share the ``vectors (vec, embedding)``: ``query_id, id, score, rank``.

    Different vectors are held against each other once, however many queries and rows have them.  A vector stands for its rows by
    the smallest id: among the best ``k`` of a query are rows of the best ``k`` vectors alone, and of each its ``k`` smallest ids.
    """
    rows, queries = rows.where("vec is not null").select("id", "vec"), queries.where("vec is not null").select("query_id", "vec")
    firsts = written(rows.groupBy("vec").agg(F.min("id").alias("id")).join(vectors.where("embedding is not null"), "vec").select("vec", "id", "embedding"))
    asked = queries.select("vec").distinct().join(vectors, "vec").select(F.col("vec").alias("query_id"), "embedding")
    near = cosine_top(asked, firsts.select("id", "embedding"), k).select(F.col("query_id").alias("of"), "id", "score")
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k).select("vec", "id")
    every = near.join(firsts.select("vec", "id"), "id").select("of", "vec", "score").join(least, "vec")
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return queries.join(best.select(F.col("of").alias("vec"), "id", "score", "rank"), "vec").select("query_id", "id", "score", "rank")


def rank_fusion(lists: list[tuple[DataFrame, float]], k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(query_id, id, rank)`` with weights: ``query_id, id, score, rank``.

    Ties go by the rank in the first list that has the item, then by id.
    """
    every = None
    for n, (ranked, weight) in enumerate(lists):
        part = ranked.where(F.col("rank") <= depth).select("query_id", "id", "rank", F.lit(n).alias("list"), F.lit(float(weight)).alias("weight"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), F.min_by("rank", "list").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank", "id")
    return fused.withColumn("rank", F.row_number().over(w)).select("query_id", "id", "score", "rank")


def fused_ranks(lists: dict[str, DataFrame], weights: dict[str, tuple[float, ...]], k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """``rank_fusion`` of the same ``lists`` by several weightings at once: ``query_id, id``, the rank in each list, the rank in each fused one.

    ``weights`` names a weighting and gives a weight a list.  A list's rank is null where its best ``depth`` lack the item.  The lists
    are shuffled once, by query, whatever the number of weightings.
    """
    every = None
    for n, ranked in enumerate(lists.values()):
        part = ranked.where(F.col("rank") <= depth).select("query_id", "id", "rank", F.lit(n).alias("list"))
        every = part if every is None else every.unionByName(part)
    score = lambda own: F.round(F.sum(F.array(*[F.lit(float(x)) for x in own])[F.col("list")] / (k + F.col("rank"))), 9)
    fused = every.repartition("query_id").groupBy("query_id", "id").agg(
        *[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(name) for n, name in enumerate(lists)],
        *[score(own).alias(name) for name, own in weights.items()],
        F.min_by("rank", "list").alias("__first"),
    )
    for name in weights:
        fused = fused.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(name), "__first", "id")))
    return fused.drop("__first")


def gated(strict: DataFrame, fused: DataFrame) -> DataFrame:
    """The strict list of the queries that have one, the fused list of the others."""
    hit = strict.select("query_id").distinct()
    return strict.select("query_id", "id", "rank").unionByName(fused.join(hit, "query_id", "left_anti").select("query_id", "id", "rank"))


def id_differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two id spaces that the other one lacks, with ``side`` a or b; lists may be fused if there are none."""
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))
