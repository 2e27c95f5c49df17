import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.splitting import boundary_pattern, split_oversized, split_pieces


def pieces(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    return {r.n: r.p for r in df.select("n", split_pieces(F.col("t"), **kw).alias("p")).collect()}


def rejoined(parts, overlap):
    for a, b in zip(parts, parts[1:]):
        assert b.startswith(a[-overlap:]) and len(b) > overlap
    return parts[0] + "".join(p[overlap:] for p in parts[1:])


@pytest.mark.parametrize("max_tokens,overlap_tokens", [(800, 80), (50, 5), (20, 6)])
def test_round_trip(spark, max_tokens, overlap_tokens):
    rng = random.Random(3)
    units = ["word ", "ends. ", "a\n", "p\n\n", "# Head\n", "| a | b |\n", "x" * 90, "漢字。", "😀", "é", "\r\n", "「はい。」", " ", "```\ncode\n```\n"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randrange(4000))) for _ in range(25)]
    fenced = [*units, "```py\n# comment\n\nx = 1. Y\n```\n", "~~~\n```\n\n", "~~~ \n", "   ```\n", "```"]
    texts += ["".join(rng.choice(fenced) for _ in range(rng.randrange(4000))) for _ in range(25)] + ["```\n" + "\ufdd0 y\n\n" * 4000]
    texts += ["x" * 50_000, "\n" * 20_000, "é" * 9_000, "a" * (max_tokens * 4 + 3), "a" * (max_tokens * 4 + 4)]
    got = pieces(spark, texts, max_tokens=max_tokens, overlap_tokens=overlap_tokens)
    for i, t in enumerate(texts):
        if t:
            assert rejoined(got[i], overlap_tokens * 4) == t
        assert all(len(p) // 4 <= max_tokens for p in got[i])
        assert (len(got[i]) > 1) == (len(t) // 4 > max_tokens)


def test_strongest_boundary_wins(spark):
    body = "One sentence here. " * 6
    text = body + "\n\n" + body + "\n# Next\n" + "tail " * 60
    first = pieces(spark, [text], max_tokens=63, overlap_tokens=4)[0][0]
    assert first.endswith("\n") and text[len(first) :].startswith("# Next")
    long = "One sentence here, and so on. " * 30
    assert pieces(spark, [long], max_tokens=50, overlap_tokens=4)[0][0].endswith(". ")
    accents = pieces(spark, ["é" * 500], max_tokens=50, overlap_tokens=0)[0]
    assert not any(p.startswith("́") for p in accents)


def open_fences(text, cuts):
    """Of places where a text is cut, those inside a fence."""
    inside, at, mark = [], 0, ""
    for line in text.split("\n"):
        bare = line.strip()
        if mark:
            inside.append((at, at + len(line)))
            if bare.startswith(mark) and not bare.strip(mark[0]):
                mark = ""
        elif bare.startswith("```"):
            mark = "```"
        at += len(line) + 1
    return [c for c in cuts if any(a <= c <= b for a, b in inside)]


def test_fences_are_cut_only_where_they_do_not_fit(spark):
    code = "\n```sh\n# first, make it\nmake all\n\n# then run it. Now\nrun --fast, --hot\n```\n"
    rng = random.Random(5)
    texts = ["".join(rng.choice([code, "Some words go on here, and on. ", "Line.\n", "\n\n", "## Head\n"]) for _ in range(400)) for _ in range(20)]
    kw = dict(max_tokens=100, overlap_tokens=10)
    for i, parts in pieces(spark, texts, **kw).items():
        assert rejoined(parts, 40) == texts[i]
        ends = [len(parts[0])]
        for p in parts[1:-1]:
            ends.append(ends[-1] + len(p) - 40)
        assert open_fences(texts[i], ends) == []
    before = "Before it stands a line of some length.\n\n" * 2
    big = before + "```\n" + "# comment\nline of code\n" * 60 + "```\nAfter it.\n"
    parts = pieces(spark, [big], **kw)[0]
    assert parts[0] == before and all(p.endswith("\n") for p in parts) and rejoined(parts, 40) == big


def test_nulls_empty_repeats_and_clashing_names(spark):
    rows = [(1, None, "h", 1), (2, "", None, 1), (3, "short", "h", 1), (4, "long " * 900, None, 7), (4, "long " * 900, None, 7)]
    df = spark.createDataFrame(rows, "id long, content string, heading_path string, piece_no int")
    got = split_oversized(df, row_id="id", content="content", src_table="t").collect()
    assert {r.row_id for r in got} == {4} and sorted(r.piece_no for r in got) == [1, 2] and all(r.heading_path is None for r in got)
    assert split_oversized(df.limit(0), row_id="id", content="content", src_table="t").count() == 0
    assert pieces(spark, [None, "", "a"])[0] is None and pieces(spark, ["", "a"]) == {0: [], 1: ["a"]}


def test_overlap_must_leave_room(spark):
    with pytest.raises(ValueError):
        split_pieces(F.lit("x"), 10, 9)
    assert boundary_pattern(10)


def test_texts_are_cut_once(spark):
    df = spark.createDataFrame([(1, "x", "h")], "id long, content string, heading_path string")
    plan = split_oversized(df, row_id="id", content="content", src_table="t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == plan.split("Generate")[1].count("regexp_extract_all") > 0
