"""Pack archives: zip files read and written by tasks, one archive at a time, with the safety checks on entries."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits on an archive.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 10_000, 50 * 2**20, 500 * 2**20
_TIME = (2021, 8, 8, 0, 0, 0)


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all archives below ``folder``: ``path, name, size, mode, error``, without their contents.

    A file that is no archive gives one row with its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ctx").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        rows += [(path, i.filename, i.file_size, i.external_attr >> 16, None) for i in z.infolist()]
                except zipfile.BadZipFile as e:
                    rows.append((path, None, None, None, str(e)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["path", "name", "size", "mode", "error"]), schema=_ENTRIES)

    return files.mapInArrow(run, "path string, name string, size long, mode long, error string")


_ENTRIES = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mode", pa.int64()), ("error", pa.string())])


def unsafe_archives(entries: DataFrame) -> DataFrame:
    """Archives that must not be unpacked: ``path, reason``, the first of: broken, unsafe name, link, entry too large, too many, too large."""
    name = F.translate("name", "\\", "/")
    bad = name.startswith("/") | name.rlike("^[A-Za-z]:") | F.array_contains(F.split(name, "/"), "..")
    link = F.col("mode").bitwiseAND(0o170000) == 0o120000
    per = entries.groupBy("path").agg(
        F.max("error").alias("error"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"),
        F.coalesce(F.bool_or(link), F.lit(False)).alias("link"),
        F.coalesce(F.bool_or(F.col("size") > MAX_ENTRY_BYTES), F.lit(False)).alias("big"),
        F.count("name").alias("n"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
    )
    reason = (
        F.when(F.col("error").isNotNull(), "broken archive")
        .when(F.col("bad"), "unsafe entry name")
        .when(F.col("link"), "symbolic link")
        .when(F.col("big"), "entry too large")
        .when(F.col("n") > MAX_ENTRIES, "too many entries")
        .when(F.col("total") > MAX_TOTAL_BYTES, "archive too large")
    )
    return per.select("path", reason.alias("reason")).where("reason is not null")


def digest_of(entries: list[tuple[str, bytes]]) -> str:
    """Digest over entries in order of name, each as length and bytes of its name and its content; the manifest counts with an empty digest."""
    h = hashlib.sha256()
    for name, content in sorted(entries):
        if name == "manifest.json":
            content = _json({**json.loads(content), "pack_digest": ""})
        for part in (name.encode(), content):
            h.update(struct.pack(">I", len(part)))
            h.update(part)
    return "sha256:" + h.hexdigest()


def _json(value: object) -> bytes:
    return json.dumps(value, indent=2, sort_keys=True).encode()


def text_hash(records: list[dict]) -> str:
    """Hash of the records' contents in order of id, joined by newlines."""
    return "sha256:" + hashlib.sha256("\n".join(r.get("content") or "" for r in sorted(records, key=lambda r: r.get("id") or 0)).encode()).hexdigest()


def _fits(value: object, kind: str) -> bool:
    if kind.endswith("?"):
        return value is None or _fits(value, kind[:-1])
    if kind in ("id", "count"):
        return isinstance(value, int) and not isinstance(value, bool) and value >= (kind == "id")
    return isinstance(value, str) and (kind != "hash" or bool(re.fullmatch("sha256:[a-f0-9]{64}", value))) and (kind != "name" or bool(value))


# Fields of the records and what they hold.
MANIFEST = {"package": "name", "version": "name", "schema_version": "count", "chunks": "count", "pack_digest": "hash", "normalized_content_hash": "hash"}
CHUNK = {"id": "id", "page_id": "id?", "heading_path": "text?", "content": "text?", "content_hash": "hash?", "summary": "text?", "token_count": "count?", "source_url": "text?", "source_commit": "text?"}
PAGE = {"id": "id", "package": "text", "version": "text", "url": "text", "title": "text?", "content_hash": "text?"}


def _off(record: object, fields: dict[str, str]) -> str | None:
    """The first field of a record that is not as it should be."""
    if not isinstance(record, dict):
        return "record"
    return next((f for f, kind in fields.items() if not _fits(record.get(f), kind)), None)


def checked(content: bytes) -> tuple[int | None, str | None, list[str]]:
    """Number and reason of the first check an archive fails, if any, and the lines of its chunks if none.

    In order: 1 it opens and has a manifest, 2 the manifest's fields, 4 names and links, 5 limits (nothing but the manifest
    is unpacked before), 6 digest, 7 records and content hash.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = z.infolist()
    except (zipfile.BadZipFile, OSError) as e:
        return 1, f"broken archive: {e}", []
    with z:
        for i in infos:
            if i.filename == "manifest.json" and i.file_size > MAX_ENTRY_BYTES:
                return 5, "entry too large: manifest.json", []
        try:
            manifest = json.loads(z.read("manifest.json"))
        except KeyError:
            return 1, "no manifest", []
        except (ValueError, zipfile.BadZipFile) as e:
            return 1, f"manifest: {e}", []
        wrong = _off(manifest, MANIFEST)
        if wrong:
            return 2, f"manifest: {wrong}", []
        for i in infos:
            name = i.filename.replace("\\", "/")
            if name.startswith("/") or re.match("[A-Za-z]:/", name) or ".." in name.split("/"):
                return 4, f"unsafe entry name: {i.filename}", []
            if (i.external_attr >> 16) & 0o170000 == 0o120000:
                return 4, f"symbolic link: {i.filename}", []
        large = next((i.filename for i in infos if i.file_size > MAX_ENTRY_BYTES), None)
        if large:
            return 5, f"entry too large: {large}", []
        if len(infos) > MAX_ENTRIES:
            return 5, "too many entries", []
        if sum(i.file_size for i in infos) > MAX_TOTAL_BYTES:
            return 5, "archive too large", []
        try:
            if digest_of([(i.filename, z.read(i)) for i in infos]) != manifest["pack_digest"]:
                return 6, "digest mismatch", []
            lines = [x for x in z.read("chunks.jsonl").decode().split("\n") if x.strip()]
            records = [json.loads(x) for x in lines]
            pages = json.loads(z.read("pages.json"))
        except (KeyError, ValueError, zipfile.BadZipFile, zlib.error) as e:
            return 7, f"records: {e}", []
        wrong = next((w for w in (_off(r, CHUNK) for r in records) if w), None) or next((w for w in (_off(p, PAGE) for p in pages) if w), None)
        if wrong:
            return 7, f"records: {wrong}", []
        if text_hash(records) != manifest["normalized_content_hash"]:
            return 7, "content hash mismatch", []
        return None, None, lines


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ctx").load(folder).select("path", "content")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of all archives below ``folder``: ``path, step, reason``, both null where an archive passes (see ``checked``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [checked(c.as_py())[:2] for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], "int32"), pa.array([f[1] for f in found], "string")], ["path", "step", "reason"])

    return _archives(spark, folder).mapInArrow(run, "path string, step int, reason string")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk records of all archives: ``path``, the fields of ``chunks.jsonl``, and ``reason``.

    An archive that fails a check is not unpacked any further; its one row holds the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, reason, lines = checked(content.as_py())
                lines = [None] if reason else lines
                yield pa.RecordBatch.from_arrays([pa.array(x, "string") for x in ([path] * len(lines), lines, [reason] * len(lines))], ["path", "line", "reason"])

    schema = "id long, page_id long, heading_path string, content string, content_hash string, summary string, token_count int, source_url string, source_commit string"
    return _archives(spark, folder).mapInArrow(run, "path string, line string, reason string").select("path", "reason", F.from_json("line", schema).alias("c")).select("path", "c.*", "reason")


def write_packs(chunks: DataFrame, folder: str, fields: list[str], pages: DataFrame | None = None) -> DataFrame:
    """One archive ``package@version.ctx`` a pack in ``folder`` (shared by the tasks): ``package, version, file, n_chunks, error``.

    A pack's rows come sorted to one task.  Records stand one a line, keys in order, under one fixed time, so that
    equal packs are equal files; the manifest holds the digest and the hash of the contents.  A pack whose records
    are over the limit of an entry gets no archive, but a row with an error, and no more than the limit is held.
    ``pages (package, version, id, url, title, content_hash)`` are the packs' pages, none if not given.
    """
    record = chunks.select("package", "version", F.lit(0).alias("__page"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("__line"), F.col(fields[0]).cast("long").alias("__at")).distinct()
    if pages is not None:
        listed = F.to_json(F.struct("id", "package", "version", "url", "title", "content_hash"), {"ignoreNullFields": "false"})
        record = record.union(pages.select("package", "version", F.lit(1), listed, F.col("id").cast("long")).distinct().join(chunks.select("package", "version").distinct(), ["package", "version"], "left_semi"))
    sorted_ = record.repartition("package", "version").sortWithinPartitions("package", "version", "__page", "__at", "__line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, size, n, done = None, ([], []), 0, 0, []

        def close() -> None:
            if key is None:
                return
            if size > MAX_ENTRY_BYTES:
                done.append((*key, None, n, "entry too large"))
                return
            entries = [("chunks.jsonl", "".join(x + "\n" for x in held[0]).encode()), ("pages.json", _json([json.loads(x) for x in held[1]]))]
            manifest = {"package": key[0], "version": key[1], "chunks": n, "schema_version": 2, "pack_digest": "", "normalized_content_hash": text_hash([json.loads(x) for x in held[0]])}
            manifest["pack_digest"] = digest_of([*entries, ("manifest.json", _json(manifest))])
            with zipfile.ZipFile(f"{folder}/{key[0]}@{key[1]}.ctx", "w") as z:
                for name, content in [*entries, ("manifest.json", _json(manifest))]:
                    z.writestr(zipfile.ZipInfo(name, _TIME), content, zipfile.ZIP_DEFLATED)
            done.append((*key, f"{key[0]}@{key[1]}.ctx", n, None))

        for batch in batches:
            for package, version, page, line in zip(batch["package"], batch["version"], batch["__page"], batch["__line"]):
                if (package, version) != key:
                    close()
                    key, held, size, n = (package, version), ([], []), 0, 0
                n += not page
                line = json.dumps(json.loads(line), sort_keys=True)
                size += len(line.encode()) + 1
                if size <= MAX_ENTRY_BYTES:
                    held[page].append(line)
                else:
                    held = ([], [])
        close()
        yield pd.DataFrame(done, columns=["package", "version", "file", "n_chunks", "error"])

    return sorted_.mapInPandas(run, "package string, version string, file string, n_chunks long, error string")
