import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import boilerplate
from docloom.llm.boilerplate import Labeller, blocks, furniture, furniture_lines, main_body

PAGE = "\n".join(
    [
        "Skip to content",
        "[API](/api/)",
        "[Blog](/blog/)",
        "",
        "# Using the scheduler",
        "",
        "Call `drain_page()` before the scheduler closes the window. It never blocks.",
        "",
        "```python",
        "menu = 'All rights reserved.'",
        "```",
        "",
        "| a | b |",
        "|---|---|",
        "",
        "Edit this page",
        "All rights reserved.",
    ]
)


def test_page_is_cut_to_its_article(spark):
    assert furniture_lines([PAGE])[0] == [1, 2, 3, 16, 17]
    body = spark.createDataFrame([(PAGE,), (None,), ("",)], "content string").transform(main_body, content="content").collect()
    assert body[0].main_body.startswith("# Using") and body[0].main_body.rstrip().endswith("|---|---|")
    assert body[1].main_body is None and body[2].main_body == ""


def test_found_rows(spark):
    rows = [(1, PAGE, 3), (1, PAGE, 3), (2, None, 1), (3, "", 1), (4, "\n \n", 1), (5, "word " * 200_000, 1), (None, PAGE, 1)]
    df = spark.createDataFrame(rows, "id long, content string, line_no int")
    got = furniture(df, row_id="id", content="content", src_table="t").collect()
    assert sorted(r.line_no for r in got if r.row_id == 1) == [1, 2, 3, 16, 17]
    assert {r.row_id for r in got} == {1, None}
    assert furniture(df.limit(0), row_id="id", content="content", src_table="t").count() == 0


def test_blocks_cover_every_nonblank_line_once():
    text = PAGE + "\n```\nopen fence\n\n1. x"
    spans = blocks(text)[0]
    covered = [n for a, b in spans for n in range(a, b)]
    assert covered == sorted(set(covered))
    assert {i for i, x in enumerate(text.split("\n")) if x.strip()} <= set(covered)


def test_batched_scores_equal_single_ones():
    net = Labeller.shipped()
    texts = [PAGE, "", "One line", PAGE * 3, "# H\n\ntext. " * 40]
    cut = [blocks(t)[1:] for t in texts]
    together = net.scores(cut)
    for t, y in zip(cut, together):
        assert np.allclose(net.scores([t])[0], y, atol=1e-3)


@pytest.mark.parametrize("sf", ["/root/testdata/check_s"])
def test_held_out_accuracy(spark, sf):
    """Against the training patterns' labels, on other rows than the training ones."""
    from pathlib import Path

    from docloom.llm.training.furniture_labels import labels

    if not Path(sf).exists():
        sf = "/root/testdata/sf0.01"  # its pages are others than those of the training table
    texts = [r.content for r in spark.read.parquet(f"{sf}/crawled_pages.parquet").where(F.col("crawl_id") % 8 == 0).select("content").collect()]
    wrong = total = 0
    for t, got in zip(texts, furniture_lines(texts)):
        want = {n for n, y in enumerate(labels(t), 1) if y}
        wrong, total = wrong + len(want ^ set(got)), total + len(want)
    assert wrong < 0.005 * total


def test_words_that_recur_are_cut_once(monkeypatch):
    cut = []
    boilerplate._buckets.cache_clear()
    boilerplate.read_line.cache_clear()
    found = boilerplate._TOKEN.findall

    class Token:
        def findall(self, text):
            cut.append(text)
            return found(text)

    monkeypatch.setattr(boilerplate, "_TOKEN", Token())
    for line in ("the reader waits.", "the writer waits.", "the reader, too"):
        boilerplate.read_line(line)
    assert sorted(cut) == ["reader", "reader,", "the", "too", "waits.", "writer"]


def test_words_are_the_tokens_of_the_whole_line():
    for line in ("a_b c-d e1f2 x", "- [Größe](../a/b.html) über\u00a0alles\u2003x", "索引を作る。 次の行 abc", "https://a.example/x?y=1#z", "the 12 34.5 (x), don't\x1fstop", "한국어 문장 은 띄어 쓴다", ""):
        assert boilerplate.word_buckets(line) == tuple(map(boilerplate._bucket, boilerplate._TOKEN.findall(line))), line


def test_context_of_long_texts():
    context = blocks("\n".join(f"line {i}" for i in range(200)))[2]
    assert [c[2] for c in context] == [min(6, (i + 1).bit_length() - 1) for i in range(200)]
    assert [c[3] for c in context] == [min(6, (200 - i).bit_length() - 1) for i in range(200)]
    assert [c[:2] for c in context] == [(1 if i == 0 else 0, 3 if i == 199 else 0) for i in range(200)]
    assert blocks("")[2] == blocks("\n\n")[2] == []
