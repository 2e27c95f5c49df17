import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.chunks import blocks, chunk_markdown, chunks_of
from docloom.functions.html import html_to_markdown, markdown_of
from docloom.plans.crawl import crawl


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a\u00a0b <b>c</b>", "a b c"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("e\u0301", "é"),
        ("List<String>\n```\nList<String>\u00a0x\n```\n<i>y</i>", "List\n```\nList<String>\u00a0x\n```\ny"),
        ("```\nopen <b>", "```\nopen <b>"),
        ("", ""),
        (None, None),
        ("  x  ", "x"),
    ],
)
def test_normalize(spark, raw, want):
    got = one(spark, T.normalize_text, raw)
    assert got == want and one(spark, T.normalize_text, got) == want


def test_summary(spark):
    s = lambda c, p: one(spark, T.heuristic_summary, c, p)
    assert s("# Head\nFirst one. Second.", "pack / Head") == "Head: First one."
    assert s("First one! Second.", "pack") == "First one!"
    assert s("Head is here. More.", "pack / Head") == "Head is here."
    assert s("```py\nx = 1\ndef f(a):\n    pass\n```", "pack / Head") == "def f(a):"
    assert s("- item\n- other", "p / L") == "L: - item\n- other"
    assert s("# Only", "") == "Only"
    assert s("word " * 100, "a") .endswith("...") and len(s("word " * 100, "a")) <= 204
    assert s("x", "p / " + "h" * 70) == "h" * 70
    assert s(None, "a") is None


def test_small_functions(spark):
    assert one(spark, T.title_of, "x\n  # The title \n# Other") == "The title" and one(spark, T.title_of, "none") is None
    assert one(spark, T.anchor, " a \n b ") == "a b"
    assert one(spark, T.strip_mdx, "import X from 'x'\n<Card title='a'>\nhi {`code`} {\"s\"} {drop}\n</Card>\n") == "hi code s \n"
    assert one(spark, T.clean_headings, "## A<sup>1</sup>\nb<sup>2</sup>") == "## A\nb<sup>2</sup>"
    assert one(spark, T.code_blocks, "a\n```python\nx\n```\n```\ny\n```\n") == "x\n\ny\n" and one(spark, T.code_blocks, "plain") == "plain"
    assert one(spark, T.without_comment_lines, "a\n <!-- b -->\nc") == "a\nc"
    assert one(spark, T.term_set, "The API's fast, naïve api_key x1y ab") == ["the", "api", "fast", "x1y"]
    assert one(spark, T.query_terms, "The Cost of CAFÉ cafe") == ["cost", "cafe", "cafe"]


def test_chunks_follow_the_structure(spark):
    cut = lambda t, p="doc", **k: [(c.heading_path, c.content) for c in one(spark, lambda a, b: chunk_markdown(a, b, **k), t, p)]
    text = "intro text that is long enough to stand alone, quite.\n\n# A\n\nbody of a, also long enough to be a chunk of its own here.\n\n## B\nshort\n# C #\nend of it"
    got = cut(text, min_tokens=8)
    assert [p for p, _ in got] == ["doc", "doc / A", "doc / C"]
    assert got[2][1].startswith("## B\nshort\n# C") and got[1][1].startswith("# A")
    paragraphs = "\n\n".join(f"paragraph {i} " + "x" * 60 for i in range(12))
    parts = cut(paragraphs, max_tokens=40)
    assert len(parts) > 3 and "\n\n".join(c for _, c in parts) == paragraphs
    fence = "```\n" + "\n".join("# not a heading " + "y" * 40 for _ in range(20)) + "\n```"
    assert cut("# H\n" + fence, max_tokens=40) == [("doc / H", "# H\n" + fence)]
    lines = "\n".join("line " + "z" * 50 for _ in range(20))
    assert len(cut(lines, max_tokens=40)) > 4
    assert cut("") == cut(None) == [] and cut("# Only", None) == []


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Title\n=====\n\nSub of it\ngoes on\n---\ntext\n", [("heading", 0, 2, (1, "Title")), ("heading", 3, 6, (2, "Sub of it\ngoes on")), ("text", 6, 7, None)]),
        ("a\n    still a\n\n    code\n\n    more code\n\nb", [("text", 0, 2, None), ("code", 3, 6, None), ("text", 7, 8, None)]),
        ("- a\n\n  in a\n- b\n  # not a heading\nlazy\n\nout\n* other", [("list", 0, 6, [0, 3]), ("text", 7, 8, None), ("list", 8, 9, [8])]),
        ("1. a\n2. b\n3) c", [("list", 0, 2, [0, 1]), ("list", 2, 3, [2])]),
        ("- a\n  ```\n- no item\n  ```\n- b", [("list", 0, 5, [0, 4])]),
        ("text\n2. no item\n1. item", [("text", 0, 2, None), ("list", 2, 3, [2])]),
        ("> q\nlazy\n\n***\n<div>\nx\n</div>\n\n~~~~ sh\n# c\n~~~\n~~~~", [("quote", 0, 2, None), ("rule", 3, 4, None), ("html", 4, 7, None), ("fence", 8, 12, None)]),
        ("```\nopen", [("fence", 0, 2, None)]),
        ("#no heading\n####### none\n# H ##\n#", [("text", 0, 2, None), ("heading", 2, 3, (1, "H")), ("heading", 3, 4, (1, ""))]),
        ("", []),
    ],
)
def test_blocks(text, kinds):
    assert blocks(text.split("\n")) == kinds


def test_large_blocks_are_cut_where_their_kind_allows(spark):
    line = "words of a line that is long enough"
    items = "\n".join(f"- {line}\n  {line}" for _ in range(10))
    assert all(c["content"].startswith("- ") and c["content"].count("- ") == 2 for c in chunks_of(items, "p", 30, 5))
    code = "\n\n".join(f"    {line}\n    {line}" for _ in range(10))
    assert [c["content"].count(line) for c in chunks_of("x\n\n" + code, "p", 30, 5)][:2] == [4, 4]
    quote = "\n".join(f"> {line}" for _ in range(10))
    assert len(chunks_of(quote, "p", 30, 5)) == 1
    under = "Top\n===\n\n" + line + "\n\nPart\n---\n\n" + line
    assert [c["heading_path"] for c in chunks_of(under, "p", 30, 5)] == ["p / Top", "p / Top / Part"]
    import time

    sizes = []
    for n in (2000, 16000):
        began = time.perf_counter()
        chunks_of("\n".join(f"{line} {i}" if i % 9 else "\n# H\n" for i in range(n)), "p", 800, 20)
        sizes.append(time.perf_counter() - began)
    assert sizes[1] < 30 * sizes[0] + 0.2  # eight times the lines


def test_html(spark):
    page = "<html><body><nav>menu</nav><div role='main'><h1>T<a href='#t'>¶</a></h1><p>a <code>x &lt; y</code> <a href='/b'>b</a></p><ul><li>one<li>two</ul><pre>k  v\n</pre><div class='sphx-glr-footer'>f</div></div><footer>z</footer></body></html>"
    got = one(spark, html_to_markdown, page)
    assert got.startswith("# T") and "¶" not in got and "menu" not in got and "z" not in got.split("k  v")[1]
    assert "a `x < y` [b](/b)" in got and "- one" in got and "```\nk  v\n" in got
    assert markdown_of("") == "" and markdown_of("plain <b>text") == "plain **text" and one(spark, html_to_markdown, None) is None


def test_urls(spark):
    c = lambda u: one(spark, U.canonical_url, u)
    assert c("HTTPS://Docs.X.example/A/index.html?q=1#f") == "https://docs.x.example/A/"
    assert c("https://x.example") == "https://x.example/" and c("mailto:a@b") is None and c(None) is None
    assert one(spark, U.dedup_key, "https://x.example/a//") == "https://x.example/a"
    assert [one(spark, U.scope_of, u) for u in ("https://x.example", "https://x.example/a/", "https://x.example/a/b.html", "https://x.example/a")] == ["/", "/a/", "/a/", "/a/"]
    assert one(spark, U.label_of, "https://x.example/a/b.html") == "a/b" and one(spark, U.label_of, "https://x.example/") == "https://x.example/"
    assert one(spark, U.is_noise, "https://x.example/docs/Changelog.html") and not one(spark, U.is_noise, "https://x.example/docs/updates-now")
    assert one(spark, U.is_asset, "https://x.example/a.PNG") and one(spark, U.is_asset, "https://x.example/objects.inv") and not one(spark, U.is_asset, "https://x.example/a.md")
    r = lambda h: one(spark, U.resolved, "https://x.example/a/b.html?q", h)
    assert [r(h) for h in ("/c", "c", "./c", "../c", "//y.example/d", "http://z", "#f", "mailto:x", "")] == [
        "https://x.example/c", "https://x.example/a/c", "https://x.example/a/c", "https://x.example/c", "https://y.example/d", "http://z", None, None, None,
    ]


def test_crawl(spark):
    pages = [
        ("https://x.example/d/", "<a href='a.html'>a</a><a href='/other'>o</a><a href='p.png'>p</a>"),
        ("https://x.example/d/a.html", "<a href=\"b.html#s\">b</a><a href='../d/'>up</a>"),
        ("https://x.example/d/b.html", "<a href='missing.html'>m</a>"),
        ("https://x.example/other", ""),
        ("https://x.example/d/alone", None),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {(r.key.rsplit("/", 1)[-1], r.depth) for r in crawl(df, df.limit(1).select("url"), url="url", html="html").collect()}
    assert got == {("d", 0), ("a.html", 1), ("b.html", 2)}
    assert crawl(df, df.limit(0).select("url"), url="url", html="html").count() == 0
    deep = spark.createDataFrame([(f"https://x.example/d/{i:03}", f"<a href='/d/{i + 1:03}'>n</a><a href='/d/z{i:03}'>z</a>") for i in range(8)], "url string, html string")
    seed = deep.limit(1).select("url").withColumn("start", F.lit("https://x.example/"))
    every = crawl(deep, seed, url="url", html="html", fetched_only=False).collect()
    assert max(r.depth for r in every) == 8 and len(every) == 17 and not any(r.truncated for r in every)
    some = crawl(deep, seed, url="url", html="html", fetched_only=False, max_pages=10).collect()
    assert {(r.key, r.depth) for r in some} == {(r.key, r.depth) for r in sorted(every, key=lambda r: (r.depth, r.key))[:10]} and all(r.truncated for r in some)
    assert not any(r.truncated for r in crawl(deep, seed, url="url", html="html", fetched_only=False, max_pages=17).collect())
