"""Lines repeated across one source's documents, found and removed.

Every line is masked (case, spacing, marks, numbers, dates, addresses, the author of a byline) and read as a
set of five-word shingles.  Min-hashes of the set place it in buckets, one for each of ``BANDS``; equal masked
lines always meet, lines of Jaccard similarity 0.8 meet in some bucket with probability 0.992.  Buckets are
counted over all lines; only those that hold enough documents of their source, or nearly, go on.  In each, the masked
line found in most documents is the head of a cluster, to which the others belong from similarity 0.8 up; a
cluster gathers its members from all buckets of its head, and its documents are counted exactly.

Every text is parsed once, into lines as numbers; counting is by (source, bucket) and (source, line) with the
documents spread first, so that no source and no line, however frequent, meets in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

SHINGLE, BANDS, SIMILARITY = 5, 3, 0.8
MIN_SHARE, MIN_DOCUMENTS = 0.03, 5
#: of the documents a cluster must stand in, so many must meet in a bucket for it to be looked at: a cluster's near-duplicates are spread over buckets
BUCKET_SHARE = 0.6
#: tables of hot buckets and keys, a few numbers a row, are sent to all tasks up to this number of rows and joined beyond
MAX_SHIPPED = 400_000
#: the same for cases, which carry a line's text
MAX_CASES = 50_000

# Month names and their short forms, English, German, French, Spanish, Portuguese.
_MONTHS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janeiro fevereiro março maio junho julho setembro outubro novembro dezembro"
).split()
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+")
_MONTH = "(?:" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + r")\b\.?"
_DATE = re.compile(rf"\b\d{{1,2}}(?:st|nd|rd|th)?\.?\s+(?:de\s+)?{_MONTH},?\s+(?:de\s+)?\d{{4}}|\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}")
_WORD = re.compile(r"[^\W_]+")
_NUMBERS = re.compile(r"\d+")
_DIGIT, _YEAR = re.compile(r"\d").search, re.compile(r"\d{4}").search
_ZEROS = re.compile(r"\b0(?: 0)+\b")
_WHO = r"[^\W\d_][\w.'’-]*"
_BY = re.compile(rf"\bby {_WHO}(?: {_WHO}){{0,3}}(?=$|\s+[·|•/–—]|,)")
_HEAD = re.compile(rf"^{_WHO}(?: {_WHO}){{1,3}}(?=, .*\d)")
_CODE = re.compile(r"(?: {4,}|\t)(?!\s*(?:[-*+•]|\d+[.)])\s)")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def masked(line: str) -> str:
    """The line as it is compared: equal for lines that differ in what is masked only; '' if no word is left."""
    s = " ".join(line.lower().split())
    if "/" in s or "www." in s:
        s = _ADDRESS.sub("address", s)
    if _DIGIT(s):
        if _YEAR(s):
            s = _DATE.sub("0", s)
        s = _NUMBERS.sub("0", s)
    if "by " in s or s.endswith(("0", "0.", "0*", "0_")) and ", " in s:
        s = s.strip(" *_>—–-~")
        s = _BY.sub("by author", s)
        if s.endswith(("0", "0.")):
            s = _HEAD.sub("author", s)
    s = " ".join(_WORD.findall(s))
    return _ZEROS.sub("0", s) if "0 0" in s else s


def candidate_lines(text: str) -> list[tuple[int, str]]:
    """(number, masked line) of the lines that may be cases: no headings, table rows, code or blank lines."""
    out, fence = [], False
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence or not bare or bare[0] == "|" and bare[-1] == "|" or bare[0] == "#" and bare.lstrip("#")[:1] in ("", " ", "\t") or _CODE.match(line):
            continue
        key = masked(line)
        if key:
            out.append((n, key))
    return out


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def band_values(lines: list[str]) -> np.ndarray:
    """Min-hash of each masked line's shingles under each of ``BANDS`` permutations: one row a line."""
    if not lines:
        return np.zeros((0, BANDS), "uint64")
    words = [line.split() for line in lines]
    size = np.fromiter(map(len, words), "int64", len(words))
    flat = np.fromiter((_word_hash(w) for ws in words for w in ws), "uint64", int(size.sum()))
    with np.errstate(over="ignore"):
        end = np.repeat(np.cumsum(size), size)
        at = np.arange(len(flat))
        value = np.zeros(len(flat), "uint64")
        for k in range(SHINGLE):  # shorter lines are one shingle: missing words count as zero
            ok = at + k < end
            step = np.zeros(len(flat), "uint64")
            step[ok] = flat[at[ok] + k]
            value = _mix(value * _M1 + step + np.uint64(k + 1))
        start = np.cumsum(size) - size
        whole = at + SHINGLE <= end  # no shingle runs over the line's end, but the first one always counts
        whole[start] = True
        out = np.empty((len(lines), BANDS), "uint64")
        for b in range(BANDS):
            v = _mix(value ^ (_M1 * np.uint64(2 * b + 1)))
            v[~whole] = np.uint64(2**64 - 1)
            out[:, b] = np.minimum.reduceat(v, start)
    return out


def shingles(line: str) -> frozenset[str]:
    words = line.split()
    return frozenset(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def _read(batch: pa.RecordBatch):
    """Flat arrays of a batch's candidate lines: row index, line number, masked line, source hash, bucket hashes."""
    rows, numbers, keys, sources = [], [], [], []
    for i, (source, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
        if source is None or not text:
            continue
        h = xxhash.xxh64_intdigest(source)
        for n, key in candidate_lines(text):
            rows.append(i), numbers.append(n), keys.append(key), sources.append(h)
    seen: dict[str, int] = {}
    which = np.fromiter((seen.setdefault(k, len(seen)) for k in keys), "int64", len(keys))
    source = np.array(sources, "uint64")
    with np.errstate(over="ignore"):
        own = band_values(list(seen))[which]
        bucket = _mix((own + np.arange(1, BANDS + 1, dtype="uint64")) ^ (source * _M1)[:, None])
    return np.array(rows, "int64"), np.array(numbers, "int64"), keys, source.view("int64"), bucket.view("int64")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every candidate line: its place, the hash of its masked text, its buckets, and once a batch the masked text itself."""
    for batch in batches:
        rows, numbers, keys, source, bucket = _read(batch)
        first: dict[tuple, int] = {}
        for i, place in enumerate(zip(source.tolist(), keys)):
            first.setdefault(place, i)
        once = np.zeros(len(rows), bool)
        once[list(first.values())] = True
        # lines of one shingle have one min-hash in effect: their first band is enough
        size = np.where(np.fromiter((k.count(" ") < SHINGLE for k in keys), bool, len(keys)), 1, BANDS)
        at = np.r_[0, np.cumsum(size)]
        kept = np.arange(BANDS)[None, :] < size[:, None]
        lists = pa.ListArray.from_arrays(pa.array(at, "int32"), pa.array(bucket.reshape(-1, BANDS)[kept], "int64"))
        of = batch.column(1).cast("int64").take(pa.array(rows))
        key = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), "uint64", len(keys)).view("int64")
        yield pa.RecordBatch.from_arrays(
            [pa.array(source), of, pa.array(numbers, "int32"), pa.array(key), lists, pa.array([k if o else None for k, o in zip(keys, once)], "string")],
            ["source", "id", "line_no", "key", "buckets", "masked"],
        )


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a table sent to all tasks if it has up to ``rows`` rows (of two numbers), joined by shuffling beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def repeated_lines(
    df: DataFrame, *, row_id: str, source: str, content: str, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """Distinct ``(chunk_id, line_no, package, masked)`` of lines standing in too many documents of their source.

    A case stands, alone or with the near-duplicates of its cluster, in at least ``min_share`` and at least
    ``min_documents`` of the source's distinct ids.  Rows with a null id or source and null or empty texts
    have no cases; a row delivered again counts once; a line twice in a document counts once but is found twice.
    """
    rows = df.select(F.col(source).alias("package"), F.col(row_id).cast("long").alias("id"), F.col(content).alias("content")).where("package is not null and id is not null")
    sizes = rows.groupBy("package").agg(F.count_distinct("id").alias("n"))

    @F.pandas_udf("long")
    def source_hash(names):
        import pandas as pd

        return pd.Series(np.array([xxhash.xxh64_intdigest(n) for n in names], "uint64").view("int64"))

    least = sizes.select(source_hash("package").alias("source"), "package", F.greatest(F.lit(min_documents), F.ceil(F.col("n") * F.lit(min_share) - 1e-9)).alias("least"))
    # every text is read once; what follows moves numbers only, and texts of frequent lines once each
    every = written(rows.mapInArrow(_lines, "source long, id long, line_no int, key long, buckets array<long>, masked string"))
    buckets = every.select("source", "id", F.explode("buckets").alias("bucket"))
    counted = buckets.groupBy("source", "bucket").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= BUCKET_SHARE * min_documents)
    hot = _few(written(counted.join(least, "source").where(F.col("n") >= BUCKET_SHARE * F.col("least")).select("source", "bucket")), MAX_SHIPPED)
    placed = every.select("source", "key", "id", F.explode("buckets").alias("bucket")).join(hot, ["source", "bucket"], "left_semi")
    members = written(placed.select("source", "bucket", "key").distinct())
    wanted = members.select("source", "key").distinct()
    of_hot = every.join(_few(written(wanted), MAX_SHIPPED), ["source", "key"], "left_semi")
    ids = written(of_hot.select("source", "key", "id").distinct())
    texts = of_hot.where("masked is not null").groupBy("source", "key").agg(F.min("masked").alias("masked"))
    keys = written(ids.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).join(texts, ["source", "key"]).join(least, "source"))
    alone = keys.where("n >= least").select("source", "key")
    each = members.join(keys, ["source", "key"])
    heads = each.groupBy("source", "bucket").agg(F.max_by(F.struct("masked", "key"), F.struct("n", "key")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")

    @F.pandas_udf("boolean")
    def near(a, b):
        import pandas as pd

        return pd.Series([similarity(x, y) >= SIMILARITY for x, y in zip(a, b)], dtype=bool)

    # a head gathers what is near it from all of its buckets
    pairs = each.join(heads, ["source", "bucket"]).select("source", "head", "key", "masked", "n", "least").distinct()
    clusters = written(pairs.where(near("masked", "head.masked")).select("source", F.col("head.key").alias("head"), "key", "n", "least"))
    # clusters whose members may reach the share together though not each alone
    unsure = clusters.groupBy("source", "head").agg(F.sum("n").alias("most"), F.min("n").alias("fewest"), F.max("least").alias("least")).where("most >= least and fewest < least")
    together = clusters.join(unsure.select("source", "head"), ["source", "head"], "left_semi")
    reach = ids.join(_few(written(together.select("source", "key", "head", "least")), MAX_SHIPPED), ["source", "key"]).groupBy("source", "head", "least").agg(F.count_distinct("id").alias("n"))
    joined = together.join(reach.where("n >= least").select("source", "head"), ["source", "head"], "left_semi").select("source", "key")
    cases = keys.join(alone.union(joined).distinct(), ["source", "key"], "left_semi").select("source", "key", "package", "masked")
    found = every.select("source", "key", "id", "line_no").join(_few(written(cases), MAX_CASES), ["source", "key"])
    return found.select(F.col("id").alias("chunk_id"), F.col("line_no").cast("long").alias("line_no"), "package", "masked").distinct()


def without_lines(df: DataFrame, lines: DataFrame, *, row_id: str, content: str, into: str = "cleaned") -> DataFrame:
    """``df`` with ``content`` less the lines listed for its id in ``lines (chunk_id, line_no)``; null stays null."""
    gone = lines.groupBy(F.col("chunk_id").alias("__id")).agg(F.collect_set(F.col("line_no").cast("int")).alias("__gone"))
    kept = F.array_join(F.filter(F.split(F.col(content), "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i + 1)), "\n")
    joined = df.join(gone, F.col(row_id) == F.col("__id"), "left")
    return joined.withColumn(into, F.when(F.col("__gone").isNull(), F.col(content)).otherwise(kept)).drop("__id", "__gone")
