"""References to records that are not there when the reference is made.

Parents are valid over half-open intervals ``[start, end)``.  Their ``(key, start)`` pairs are cut into
ranges of about ``rows_per_range`` entries, and each range becomes one row holding a sorted array.  The
references are sent to the range their ``(key, moment)`` falls into, in batches of bounded size, and a
batch is probed with a vectorised binary search.  Because ranges are cut on the pair, a key with very
many versions spreads over several ranges; because batches are salted by the counted load of a range, a
key with very many references spreads over several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

OPEN_END = 2**63 - 1


def _position(keys: np.ndarray, starts: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the last entry with ``(keys, starts) <= (key, at)`` for each probe, -1 if none."""
    lo = np.searchsorted(keys, key, "left")
    hi = np.searchsorted(keys, key, "right")
    first = lo.copy()
    while True:  # binary search on starts within the run of equal keys
        open_ = lo < hi
        if not open_.any():
            break
        mid = (lo + hi) // 2
        up = np.zeros(len(lo), bool)
        up[open_] = starts[mid[open_]] <= at[open_]
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return np.where(lo > 0, np.maximum(lo - 1, first - 1), -1)


def _range_of(bounds: list[tuple]):
    """Column function giving the range number of ``(key, at)``; bounds are the ranges' first pairs but one."""
    keys = [b[0] for b in bounds]
    starts = np.array([b[1] for b in bounds], "int64")

    @F.pandas_udf("int")
    def number(key: pd.Series, at: pd.Series) -> pd.Series:
        k = np.array(keys, dtype=object) if key.dtype == object else np.array(keys, "int64")
        v = key.to_numpy()
        if key.dtype == object:  # few distinct strings: rank them once, then search on integers
            every, code = np.unique(np.concatenate([k, v]).astype(str), return_inverse=True)
            k, v = code[: len(k)], code[len(k) :]
        return pd.Series(_position(k, starts, v, at.to_numpy()) + 1, dtype="int32")

    return number


def _probe(carry: dict[int, tuple]):
    def probe(key: tuple, refs: pa.Table, parents: pa.Table) -> pa.Table:
        at = refs.column("at").to_numpy()
        value = refs.column("key").to_numpy(zero_copy_only=False)
        before = carry.get(key[0].as_py())
        if parents.num_rows:
            cells = parents.column("entries").combine_chunks().flatten()
            keys, starts, ends = (cells.field(n).to_numpy(zero_copy_only=False) for n in ("key", "start", "end"))
        else:
            keys, starts, ends = np.array([], value.dtype), np.array([], "int64"), np.array([], "int64")
        if value.dtype == object:
            every, code = np.unique(np.concatenate([keys, value, [before[0]] if before else []]).astype(str), return_inverse=True)
            keys, value = code[: len(keys)], code[len(keys) : len(keys) + len(value)]
            before = (code[-1], before[1]) if before else None
        # running maximum of the ends within each key, the carried key's history included
        ends = ends.copy()
        if before is not None and len(keys) and keys[0] == before[0]:
            ends[0] = max(ends[0], before[1])
        if len(keys):
            new = np.r_[True, keys[1:] != keys[:-1]]
            group = np.cumsum(new) - 1
            rank = np.argsort(np.argsort(ends, kind="stable"), kind="stable")
            top = np.maximum.accumulate(rank + group * len(keys)) - group * len(keys)
            ends = np.sort(ends, kind="stable")[top]
        i = _position(keys, starts, value, at)
        found = np.zeros(len(at), bool)
        hit = i >= 0
        hit[hit] = keys[i[hit]] == value[hit]
        found[hit] = ends[i[hit]] > at[hit]
        if before is not None:
            found |= ~hit & (value == before[0]) & (before[1] > at)
        return refs.filter(pa.array(~found)).select(["row_id", "at"])

    return probe


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    ref_table: str,
    row_id: str = "id",
    ref_key: str,
    at: str = "ingested_at",
    parent_key: str,
    valid_from: str,
    valid_to: str,
    rows_per_range: int = 20_000,
    rows_per_batch: int = 200_000,
) -> DataFrame:
    """Rows of ``refs`` whose non-null key has no parent that counts at the row's moment.

    Returns distinct ``(ref_table, row_id, period)``; period is ``yyyy-MM`` of the moment.

    A null reference key refers to nothing and is never a case.  A null moment is a moment at which no
    parent counts: a case with a null period.  A parent with a null key or a null ``valid_from`` never
    counts; a null ``valid_to`` leaves it open.  Repeated rows give one result row; a row delivered again
    at another moment is judged again.  Without parents every non-null reference is a case.
    """
    spark = refs.sparkSession
    p = (
        parents.select(
            F.col(parent_key).alias("key"),
            F.unix_micros(F.col(valid_from).cast("timestamp")).alias("start"),
            F.coalesce(F.unix_micros(F.col(valid_to).cast("timestamp")), F.lit(OPEN_END)).alias("end"),
        )
        .where("key is not null and start is not null and start < end")
        .groupBy("key", "start")
        .agg(F.max("end").alias("end"))
    )
    r = refs.select(
        F.col(row_id).cast("long").alias("row_id"),
        F.col(ref_key).alias("key"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
    ).where("key is not null")
    dated = r.where("at is not null").distinct()

    p = written(p)
    n = p.count()
    # ranges and their number, which the driver holds the bounds of, grow with the square root of the parents at most
    ranges = max(1, -(-n // max(rows_per_range, math.isqrt(n))))
    bounds: list[tuple] = []
    if ranges > 1:
        firsts = p.repartitionByRange(ranges, "key", "start").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "start")).alias("first"))
        bounds = sorted((x["first"]["key"], x["first"]["start"]) for x in firsts.collect())[1:]
    number = _range_of(bounds) if bounds else lambda key, at: F.lit(0)

    arrays = written(p.withColumn("range", number("key", "start")).groupBy("range").agg(F.sort_array(F.collect_list(F.struct("key", "start", "end"))).alias("entries")))
    carry: dict[int, tuple] = {}
    if bounds:
        last = F.element_at("entries", -1)["key"]
        tails = arrays.select("range", last.alias("key"), F.array_max(F.transform(F.filter("entries", lambda e: e["key"] == last), lambda e: e["end"])).alias("end"))
        run: tuple | None = None
        for x in sorted(tails.collect(), key=lambda x: x["range"]):  # one row a range
            if run:
                carry[x["range"]] = run
            run = (x["key"], max(x["end"], run[1])) if run and run[0] == x["key"] else (x["key"], x["end"])
        for n in range(1, len(bounds) + 1):
            carry.setdefault(n, carry.get(n - 1))

    placed = dated.withColumn("range", number("key", "at"))
    load = {x["range"]: -(-x["count"] // rows_per_batch) for x in placed.groupBy("range").count().collect() if x["count"] > rows_per_batch}
    splits = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in load.items() for v in kv]), F.col("range")), F.lit(1)) if load else F.lit(1)
    batches = placed.withColumn("salt", F.pmod(F.xxhash64("row_id", "at"), splits).cast("int"))
    stores = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), (splits - 1).cast("int"))))
    missed = (
        batches.groupBy("range", "salt")
        .cogroup(stores.groupBy("range", "salt"))
        .applyInArrow(_probe({k: v for k, v in carry.items() if v}), "row_id long, at long")
        .select("row_id", F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"))
    )
    undated = r.where("at is null").select("row_id", F.lit(None).cast("string").alias("period"))
    return missed.union(undated).distinct().select(F.lit(ref_table).alias("ref_table"), "row_id", "period")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per referring table and month."""
    return orphans.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
