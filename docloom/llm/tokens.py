"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a byte-level vocabulary for many languages, as ranks; any file of that kind may be given instead
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: the published pre-tokenisation pattern of that vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, *, keys: list[str], text: str, into: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``keys`` and the number of tokens of ``text`` as a long; a null text has none.  The texts go no further."""
    kept = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = kept.select(*keys).withColumn(into, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            sizes = np.array([len(encode(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()], "int64")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], [*keys, into])

    return kept.mapInArrow(run, schema)


def rank_within(df: DataFrame, group: list[str], order: list[str], into: str, rows_per_bucket: int = 100_000, largest: int | None = None) -> DataFrame:
    """``df`` with the dense rank from 0 within ``group`` in a fixed pseudorandom order, without a task per group.

    Rows are spread over hash buckets of ``order``, ranked inside (group, bucket) and lifted by the counts of
    the buckets before.  ``largest`` is the size of the largest group, counted where it is not given.
    """
    from pyspark.sql import Window

    if largest is None:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-int(largest) // rows_per_bucket))
    placed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    local = placed.withColumn(into, F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(F.xxhash64(*order, F.lit(7)), *order)).cast("long") - 1)
    if buckets == 1:
        return local.drop("__bucket")
    counts = placed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket")) - F.col("__n")).drop("__n")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__bucket"]]
    joined = local.alias("l").join(before.alias("r"), on)
    return joined.select("l.*", "r.__before").withColumn(into, F.col(into) + F.col("__before")).drop("__bucket", "__before")
