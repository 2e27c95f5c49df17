import hashlib
import os
import zipfile

from pyspark.sql import functions as F

from docloom.operators import packs as P
from docloom.sources import archives as A
from docloom.sources.indexes import collected_sitemap_pages, index_links, preferred_sitemap_pages, sitemap_urls, split_concatenated
from docloom.streaming.imports import import_stream

SCHEMA = "package string, version string, id long, page_id long, content string"
ROWS = [("a", "1", 2, 1, "two"), ("a", "1", 1, 1, "one"), ("a", "1", 1, 1, "one"), ("a", "2", 1, None, None), ("b", "1", 3, 2, "one"), ("b", "1", 4, 2, "")]


def test_hash_chain_and_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    assert {(r.package, r.version): r.pack_hash for r in P.pack_hashes(df).collect()} == {("a", "1"): sha("one\ntwo"), ("a", "2"): sha(""), ("b", "1"): sha("one\n")}
    assert P.pack_hashes(df.limit(0)).count() == 0
    assert {(r.package, r.version): (r.n_chunks, r.n_pages) for r in P.pack_counts(df).collect()} == {("a", "1"): (2, 1), ("a", "2"): (1, 0), ("b", "1"): (2, 1)}
    dup = P.duplicate_contents(df).collect()
    assert [(r.n_ids, r.n_packages, r.first_id) for r in dup] == [(2, 2, 1)]


def test_order_statistics(spark):
    for n in (1, 2, 19, 20, 21, 100, 257):
        values = [(i * 37) % 101 for i in range(n)]
        r = P.size_stats(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int"), ["g"], "v", warn=50).first()
        s = sorted(values)
        assert (r.n, r.total, r.largest, r.n_over) == (n, sum(s), s[-1], sum(v > 50 for v in s))
        assert (r.p95, r.p99) == tuple(s[min(int(n * p / 100), n - 1)] for p in (95, 99))


def test_violations_latest_and_lock(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id long, t string")
    assert {(r.id, r.violation) for r in P.violations(df, {"text": F.length("t") > 0}, ["id"]).collect()} == {(2, "text"), (3, "text")}
    rows = spark.createDataFrame([(1, "2024", "a"), (1, "2025", "b"), (1, "2025", "a"), (2, None, "c")], "id long, at string, v string")
    assert {r.id: r.v for r in P.latest(rows, ["id"], "at").collect()} == {1: "b", 2: "c"}
    packs = spark.createDataFrame([("a", "1", "d1"), ("a", "1", "d0"), ("b", "1", "d2")], "name string, version string, pack_digest string")
    lock = spark.createDataFrame([("a", "1", "d0"), ("b", "1", "zz"), ("c", "1", "d1"), ("b", "1", None)], "name string, version string, pack_digest string")
    assert {(r.name, r.pack_digest): r.state for r in P.lock_state(lock, packs).collect()} == {("a", "d0"): "present", ("b", "zz"): "digest mismatch", ("c", "d1"): "missing", ("b", None): "digest mismatch"}


def test_archives_round_trip_and_safety(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    made = A.write_packs(df, str(tmp_path), ["id", "page_id", "content"]).collect()
    assert {(r.file, r.n_chunks) for r in made} == {("a@1.ctx", 2), ("a@2.ctx", 1), ("b@1.ctx", 2)}
    first = {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path)}
    A.write_packs(df, str(tmp_path), ["id", "page_id", "content"]).collect()
    assert first == {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path)}
    back = {(r.path.rsplit("/", 1)[-1], r.id, r.page_id, r.content) for r in A.read_chunks(spark, str(tmp_path)).collect()}
    assert back == {(f"{p}@{v}.ctx", i, g, c) for p, v, i, g, c in ROWS}
    assert A.unsafe_archives(A.read_entries(spark, str(tmp_path))).count() == 0
    for name, entry, mode in (("up", "x/../../y", 0), ("abs", "/etc/x", 0), ("win", "C:/x", 0), ("back", "..\\x", 0), ("link", "l", 0o120777), ("fine", "a..b/c", 0)):
        with zipfile.ZipFile(tmp_path / f"{name}.ctx", "w") as z:
            info = zipfile.ZipInfo(entry)
            info.external_attr = mode << 16
            z.writestr(info, "x")
    (tmp_path / "broken.ctx").write_text("no zip")
    got = {r.path.rsplit("/", 1)[-1].split(".")[0]: r.reason for r in A.unsafe_archives(A.read_entries(spark, str(tmp_path))).collect()}
    assert got == {"up": "unsafe entry name", "abs": "unsafe entry name", "win": "unsafe entry name", "back": "unsafe entry name", "link": "symbolic link", "broken": "broken archive"}


def test_import_once_also_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    store = str(tmp_path / "store")
    assert P.import_packs(store, df.where("package = 'a'")) == 2
    assert P.import_packs(store, df) == 1
    df.union(spark.createDataFrame([("c", "1", 9, 9, "new")], SCHEMA)).write.parquet(str(tmp_path / "in"))
    import_stream(spark, str(tmp_path / "in"), df.schema, store, str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r.package, r.id) for r in spark.read.parquet(store).collect())
    assert got == sorted([(r[0], r[2]) for r in ROWS] + [("c", 9)])


def test_text_indexes(spark):
    row = spark.createDataFrame([("- [A](https://x.example/a) and [B](http://y.example/b?c=1)\n[no](/rel)",)], "t string").select(index_links(F.col("t")).alias("l")).first()
    assert [(x["label"], x["url"]) for x in row.l] == [("A", "https://x.example/a"), ("B", "http://y.example/b?c=1")]
    text = "drop\nSource: https://x/1\none\n\nSource: https://x/2\n\nSource: https://x/3\r\nthree\nSource: https://x/1\nlast\nSource: not a marker"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none"), (4, "Source: https://x/9\nfirst")], "i long, t string")
    got = sorted((r.item_id, r.seq, r.url, r.content) for r in split_concatenated(df, "i", "t").collect())
    assert got == [(1, 1, "https://x/1", "last\nSource: not a marker"), (1, 2, "https://x/3", "three"), (4, 1, "https://x/9", "first")]
    xml = '<urlset xmlns="u"><url><loc> https://x/a?b&amp;c </loc></url><s:url><s:loc>https://x/d</s:loc></s:url></urlset>'
    assert spark.createDataFrame([(xml,)], "x string").select(sitemap_urls(F.col("x")).alias("u")).first().u == ["https://x/a?b&c", "https://x/d"]


def test_archives_are_checked_before_they_are_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 2, 1, "two"), ("a", "1", 1, None, "one")], SCHEMA)
    pages = spark.createDataFrame([("a", "1", 7, "https://x/a", None, "h"), ("z", "1", 8, "u", None, None)], "package string, version string, id long, url string, title string, content_hash string")
    A.write_packs(df, str(tmp_path), ["id", "page_id", "content"], pages).collect()
    good = (tmp_path / "a@1.ctx").read_bytes()
    with zipfile.ZipFile(tmp_path / "a@1.ctx") as z:
        held = {i.filename: z.read(i) for i in z.infolist()}
    assert b"https://x/a" in held["pages.json"] and b'"z"' not in held["pages.json"]

    def pack(name, change=None, drop=(), extra=(), redigest=False):
        entries = {k: v for k, v in held.items() if k not in drop} | dict(change or {})
        if redigest:
            m = A.json.loads(entries["manifest.json"])
            m["pack_digest"] = A.digest_of([(k, v) for k, v in entries.items()])
            entries["manifest.json"] = A._json(m)
        with zipfile.ZipFile(tmp_path / f"{name}.ctx", "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
            for info in extra:
                z.writestr(info, "x")

    link = zipfile.ZipInfo("l")
    link.external_attr = 0o120777 << 16
    (tmp_path / "broken.ctx").write_text("no zip")
    pack("nomanifest", drop=["manifest.json"])
    pack("badjson", {"manifest.json": b"{"})
    pack("field", {"manifest.json": held["manifest.json"].replace(b'"package"', b'"pack"')})
    pack("up", extra=["a/../../b"])
    pack("abs", extra=["C:/x"])
    pack("link", extra=[link])
    pack("tampered", {"chunks.jsonl": held["chunks.jsonl"].replace(b"two", b"2")})
    pack("text", {"chunks.jsonl": held["chunks.jsonl"].replace(b"two", b"2")}, redigest=True)
    pack("record", {"chunks.jsonl": held["chunks.jsonl"].replace(b'"id": 2', b'"id": -2')}, redigest=True)
    pack("nopages", drop=["pages.json"], redigest=True)
    got = {r.path.rsplit("/", 1)[-1].split(".")[0].replace("%40", "@"): (r.step, r.reason) for r in A.verified(spark, str(tmp_path)).collect()}
    steps = {k: v[0] for k, v in got.items()}
    assert steps == {"a@1": None, "broken": 1, "nomanifest": 1, "badjson": 1, "field": 2, "up": 4, "abs": 4, "link": 4, "tampered": 6, "text": 7, "record": 7, "nopages": 7}
    assert got["text"][1] == "content hash mismatch" and got["record"][1] == "records: id"
    rows = A.read_chunks(spark, str(tmp_path)).collect()
    assert [(r.id, r.content) for r in rows if r.reason is None] == [(1, "one"), (2, "two")] and sum(r.reason is not None for r in rows) == 11
    assert A.checked(good)[0] is None


def test_limits_hold_before_anything_is_unpacked(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "1", i, 1, "word " * 10) for i in range(20)], SCHEMA)
    A.write_packs(df, str(tmp_path), ["id", "content"]).collect()
    good = (tmp_path / "a@1.ctx").read_bytes()
    for limit, value, reason in (("MAX_ENTRY_BYTES", 900, "entry too large: chunks.jsonl"), ("MAX_ENTRIES", 2, "too many entries"), ("MAX_TOTAL_BYTES", 1000, "archive too large")):
        with monkeypatch.context() as m:
            m.setattr(A, limit, value)
            assert A.checked(good)[:2] == (5, reason)


def test_stores_statements_and_listings(spark):
    pages = spark.createDataFrame([("b", "1", 1), ("a", "1", 5), ("a", "1", 2), ("a", "1", 2), ("a", "2", 2)], "package string, version string, id long")
    chunks = spark.createDataFrame([("a", "1", 1, 5), ("a", "1", 2, None), ("a", "2", 3, 5), ("b", "1", 4, 1)], "package string, version string, id long, page_id long")
    assert {r.id: r.store_page_id for r in P.remapped(chunks, pages).collect()} == {1: 2, 2: None, 3: None, 4: 4}
    refs = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    targets = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k int")
    assert {(r.k, r.state, r.n) for r in P.reconciled(refs, targets, ["k"]).collect()} == {(1, "repeated", 2), (9, "unknown", 1), (3, "missing", 0)}
    said = [(1, "", "p"), (2, None, "p"), (3, "to show " + "w " * 40, "p"), (4, "To show a thing that is\nvery well done here", "p"), (5, "show how the P is set up in nine", "p"), (6, "to do " + "it " * 10, "p")]
    got = P.statement_findings(spark.createDataFrame(said, "i int, t string, n string"), "i", "t", "n", begins=("to ",)).collect()
    assert {(r.i, r.severity, r.finding) for r in got} == {
        (1, "failure", "empty"), (3, "failure", "words"), (4, "failure", "lines"), (5, "failure", "beginning"), (5, "failure", "name"), (5, "warning", "words"),
    }
    few = P.first_of(spark.createDataFrame([("x", c) for c in "gfedcba"] + [("y", "q")], "g string, v string"), ["g"], "v", 5).collect()
    assert {r.g: (r.first, r.more) for r in few} == {"x": (list("abcde"), 2), "y": (["q"], 0)}


def test_sitemaps(spark):
    maps = [
        ("i", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"),
        ("a", "<urlset><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>"),
        ("b", "<urlset><url><loc>p2</loc></url></urlset>"),
        ("e", "<urlset></urlset>"),
        ("n", None),
    ]
    sitemaps = spark.createDataFrame(maps, "url string, xml string")
    starts = spark.createDataFrame([("s", "i"), ("s", "b"), ("t", "b"), ("u", "e")], "start string, url string")
    assert {(r.start, r.page) for r in collected_sitemap_pages(sitemaps, starts).collect()} == {("s", "p1"), ("s", "p2"), ("t", "p2")}
    assert {(r.start, r.page) for r in collected_sitemap_pages(sitemaps, starts, max_fetches=2).collect()} == {("s", "p2"), ("t", "p2")}
    prefer = spark.createDataFrame([("s", ["gone", "e", "b", "i"]), ("t", ["n"])], "start string, candidates array<string>")
    assert {(r.start, r.page) for r in preferred_sitemap_pages(sitemaps, prefer).collect()} == {("s", "p2")}
