import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, process_mdx, strip_mdx
from docloom.operators.lint import lint
from docloom.operators.packs import import_packs, remove_pack, sampled
from docloom.operators.ranks import numbered_in_order, order_statistics
from docloom.plans.build import build_chunks, enriched, with_cached_summaries
from docloom.sources.files import read_files, routed_pages

BODY = "Some words about it that are long enough to make a chunk of their own, surely.\n"


def test_components_may_stand_in_each_other(spark):
    deep = "<Note>\n" * 5 + "body\n" + "</Note>\n" * 5 + "<Tabs><Tab title='One'><Tip>tip</Tip></Tab></Tabs>\n```\n<Note>\n```\n"
    got = spark.createDataFrame([(deep,)], "t string").select(process_mdx(F.col("t"))).first()[0]
    assert got == "body\n\n### One\n\ntip\n```\n<Note>\n```"


def test_chunk_records(spark):
    pages = [
        ("p", "1", "https://x/b", "b", f"# B\n\n{BODY}\n## B2\n\n{BODY}"),
        ("p", "1", "https://x/a", "a", f"# A\n\n{BODY}"),
        ("p", "1", "https://x/a", "a", None),
        ("p", "2", "https://x/a", "a", f"# A\n\n{BODY}"),
        ("q", "1", "https://x/e", "e", "  \n"),
        (None, "1", "https://x/n", "n", BODY),
    ]
    got = build_chunks(spark.createDataFrame(pages, "package string, version string, url string, label string, text string")).orderBy("package", "version", "id").collect()
    assert [(r.version, r.id, r.source_url, r.heading_path) for r in got] == [
        ("1", 1, "https://x/a", "a / A"),
        ("1", 2, "https://x/b", "b / B"),
        ("1", 3, "https://x/b", "b / B / B2"),
        ("2", 1, "https://x/a", "a / A"),
    ]
    assert all(r.content_hash.startswith("sha256:") and r.token_count == len(r.content) // 4 and r.summary.startswith(r.heading_path.split(" / ")[-1]) for r in got)


def test_pages_without_package_and_fetched_again(spark, tmp_path):
    from docloom.plans.queries import built_chunks

    rows = [
        (1, "https://a.example/x?v=1", "p", f"# Zebra\n\n{BODY}", 1),
        (2, "https://a.example/x?v=2", "p", f"# Apple\n\n{BODY}", 2),
        (3, "https://a.example/x", "p", " ", 3),  # fetched last, but no text
        (4, "https://B.example/y", None, f"# Alone\n\n{BODY}", 1),
        (5, "https://c.example/z", "q", f"# Zebra\n\n{BODY}", 1),
        (6, "https://c.example/z", "q", f"# Apple\n\n{BODY}", 1),
        (7, None, None, f"# Nowhere\n\n{BODY}", 1),
    ]
    df = spark.createDataFrame(rows, "crawl_id long, url string, package string, content string, at int")
    df.select("crawl_id", "url", "package", "content", F.timestamp_seconds("at").alias("fetched_at")).write.parquet(f"{tmp_path}/crawled_pages.parquet")
    got = {(r.package, (r.heading_path or "").split(" / ")[-1]) for r in built_chunks(spark, str(tmp_path)).collect()}
    assert got == {("p", "Apple"), ("host:b.example", "Alone"), ("q", "Apple"), ("host:", "Nowhere")}


def test_cache(spark):
    chunks = spark.createDataFrame([(1, "h1", "x", None), (2, "h1", "x", "own"), (3, "h2", "y", None), (4, None, "z", None)], "id long, content_hash string, content string, summary string")
    cache = spark.createDataFrame([("h1", "b"), ("h1", "a"), ("h9", "c"), (None, "n")], "content_hash string, cached string")
    assert {r.id: r.summary for r in with_cached_summaries(chunks, cache).collect()} == {1: "a", 2: "own", 3: None, 4: None}
    assert [(r.content_hash, r.cached) for r in enriched(chunks, cache, lambda texts: [t.upper() for t in texts]).collect()] == [("h2", "Y")]
    with pytest.raises(Exception, match="missing or empty"):
        enriched(chunks, cache, lambda texts: [""] * len(texts)).collect()


def test_order_statistics(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.5, 1.5, rng.random(), None])) for g in ["a"] * 700 + ["b"] * 3 + [None] * 50]
    n = F.col("n")
    got = order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": F.floor(n / 2), "p95": F.ceil(n * 0.95) - 1, "most": n - 1}, buckets=8)
    for r in got.collect():
        s = sorted(v for g, v in rows if g == r.g and v is not None)
        assert (r.n, r.p50, r.p95, r.most) == (len(s), s[len(s) // 2], s[-(-len(s) * 95 // 100) - 1], s[-1])


def test_numbers_in_order(spark):
    df = spark.createDataFrame([("g", "b", 0), ("g", "b", 1), ("g", "a", 0), ("h", "z", 0)], "g string, page string, seq int")
    assert {(r.g, r.page, r.seq): r.id for r in numbered_in_order(df, ["g"], ["page"], "seq", "id").collect()} == {("g", "a", 0): 1, ("g", "b", 0): 2, ("g", "b", 1): 3, ("h", "z", 0): 1}


def test_lint(spark):
    df = spark.createDataFrame([(1, "ok\n<div>\n```\n<div>\n```\n{x} &amp;"), (2, None), (3, "")], "i long, t string")
    assert sorted((r.item_id, r.line_no, r.finding) for r in lint(df, "i", "t").collect()) == [(1, 2, "html tag"), (1, 6, "entity"), (1, 6, "expression")]


def test_components(spark):
    text = 'import A from "a"\n<Note>\nkeep {`x`}\n</Note>\n```jsx\nimport B\n<Note>{y}</Note>\n```\n<Tabs><Tab title="One">in</Tab></Tabs>\n<Frame><img src="z"/></Frame>\n## H<sup>1</sup>'
    got = spark.createDataFrame([(text,)], "t string").select(process_mdx(F.col("t")).alias("m"), strip_mdx(F.lit(None).cast("string")).alias("n")).first()
    assert "keep x" in got.m and "import A" not in got.m and "import B\n<Note>{y}</Note>" in got.m
    assert "### One" in got.m and "img" not in got.m and got.m.endswith("## H") and got.n is None


def test_files_and_routes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.md").write_text("# A", "utf-8")
    (tmp_path / "d" / "b.HTML").write_text("<main><h1>B</h1></main>", "utf-8")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    assert {r.path: r.text for r in read_files(spark, str(tmp_path)).collect()} == {"a.md": "# A", "d/b.HTML": "# B", "bad.md": None}
    rows = [("https://x/a.md?v=1", "import x\nhi", None), ("https://x/b", "<p>b</p>", "text/html"), ("https://x/c", "x", "image/png"), ("https://x/d", "d {e}", "text/plain")]
    got = routed_pages(spark.createDataFrame(rows, "url string, text string, type string"), "url", "text", "type")
    assert {r.url[10:]: r.markdown for r in got.collect()} == {"a.md?v=1": "hi", "b": "b", "d": "d "}


def test_removal_and_sample(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 1, "x" * 120), ("b", "1", 2, "y" * 120), ("b", "1", 3, "short")], "package string, version string, chunk_id long, content string").withColumn("heading_path", F.lit(None).cast("string"))
    store = str(tmp_path / "s")
    import_packs(store, df)
    assert remove_pack(spark, store, "a", "1") and not remove_pack(spark, store, "a", "1")
    assert {r.package for r in spark.read.parquet(store).collect()} == {"b"}
    assert {r.chunk_id for r in sampled(df, 5).collect()} == {1, 2} and sampled(df, 1).count() == 1
    assert content_hash(F.lit("x")) is not None


def test_running_sum(spark):
    from docloom.operators.ranks import running_sum

    df = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = running_sum(df, ["g"], "o", "v", "s", span=10).collect()
    assert len(got) == 200 and all(r.s == sum(i % 7 for i in range(r.o + 1) if i % 3 == r.g) for r in got)
