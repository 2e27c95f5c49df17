import collections
import random

import numpy as np
import pytest

import docloom.llm.repeated_lines as M
from docloom.llm.repeated_lines import band_values, candidate_lines, masked, repeated_lines, similarity, without_lines


@pytest.mark.parametrize(
    "a,b",
    [
        ("Written by Marn Hilbrecken · 25 min read", "WRITTEN BY THE NIGHT EDITORS · 4096 MIN READ"),
        ("> Last updated on 2024-10-21 by the docs rota", "Last updated on October 1, 2023 by Tess Quillory"),
        ("_Ilvane Orvandel, Zephyrcfg docs, 13 Apr. 2025_", "Odo Sundreth, Zephyrcfg docs, 2022-09-20"),
        ("Copy link to this page: https://a.example/x/1", "copy link  to this page: https://a.example/y"),
        ("Posted 24 Oct. 2023 in lesson", "*Posted 2021-01-26 in lesson*"),
        (
            "This long notice stands below each page of the handbook and says who looked after it in the last months of work: reviewed and edited by Ann Lee",
            "This long notice stands below each page   of the handbook and says who looked after it in the last months of work: reviewed and edited by Tessa Marn Quillory",
        ),
        ("Ilvane Orvandel, " + "the docs of a project with a very long name, " * 4 + "13 Apr. 2025", "Odo  Sundreth, " + "the docs of a project with a very long name, " * 4 + "2022-09-20"),
        ("Rate it: ★★★★☆ (7 votes)", "Rate it: ★★ (81 votes)"),
    ],
)
def test_same_line(a, b):
    assert masked(a) == masked(b) != ""


def test_different_lines():
    assert masked("All rights reserved.") != masked("All rights served.")
    assert masked("* * *") == ""
    assert candidate_lines("# Head\n\n| a |\n```\ncode\n```\n    indented\n#tag text\nprose") == [(8, "tag text"), (9, "prose")]


def test_bands_are_minimums_over_shingles():
    lines = ["a b c d e f g", "a b c", "x", "a b c d e f g", "b c d e f g h"]
    v = band_values(lines)
    assert (v[0] == v[3]).all() and not (v[0] == v[1]).any() and v.shape == (5, M.BANDS)
    rng = random.Random(1)
    hits = total = 0
    for _ in range(200):
        a = [str(rng.random()) for _ in range(60)]
        b = a[:58] + ["z", "y"]
        s = similarity(" ".join(a), " ".join(b))
        x, y = band_values([" ".join(a), " ".join(b)])
        hits, total = hits + (x == y).sum(), total + s * M.BANDS
    assert abs(hits - total) < 0.1 * total
    assert band_values([]).shape == (0, M.BANDS) and isinstance(v, np.ndarray)


def brute(rows, min_share=0.03, min_documents=5):
    n, at, occ = collections.defaultdict(set), collections.defaultdict(set), set()
    for p, i, t in rows:
        if p is None or i is None:
            continue
        n[p].add(i)
        for no, k in candidate_lines(t or ""):
            at[p, k].add(i)
            occ.add((p, i, no, k))
    keys = {p: [k for q, k in at if q == p] for p in n}
    ok = {(p, k): len(at[p, k]) >= max(min_documents, min_share * len(n[p])) for p, k in at}
    for p in n:
        for h in keys[p]:
            near = [k for k in keys[p] if similarity(h, k) >= 0.8]
            if len(set().union(*(at[p, k] for k in near))) >= max(min_documents, min_share * len(n[p])) and all(len(at[p, k]) <= len(at[p, h]) for k in near):
                for k in near:
                    ok[p, k] = True
    return {(i, no) for p, i, no, k in occ if ok[p, k]}


@pytest.mark.parametrize("shipped", [True, False])
def test_against_brute_force(spark, monkeypatch, shipped):
    if not shipped:
        monkeypatch.setattr(M, "MAX_SHIPPED", -1)
        monkeypatch.setattr(M, "MAX_CASES", -1)
    rng = random.Random(4)
    long = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(300):
        p = rng.choice(["hot", "hot", "b", "c"])
        t = [" ".join(rng.choice("abcdefgh") * 3 + str(j) + rng.choice("xyz") for j in range(9)) for _ in range(4)]
        if rng.random() < 0.2:
            t.insert(0, f"Written by {rng.choice(['Ann Lee', 'the crew', 'Bo Xi'])} · {i} min read")
        if rng.random() < 0.04:
            t.append(" ".join([*long, *rng.choice([[], ["tail"], ["other", "tail"]])]))
        if rng.random() < 0.3:
            t += ["## Overview", "| x | y |", "", "```", "same code", "```"]
        rows.append((p, i, "\n".join(t)))
    rows += [rows[0], rows[0], (None, 900, "Written by X · 1 min read"), ("hot", None, "a"), ("hot", 901, None), ("hot", 902, "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "package string, id long, content string, masked string, n int")
    got = [(r.chunk_id, r.line_no) for r in repeated_lines(df, row_id="id", source="package", content="content").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 20


def test_a_cluster_is_counted_over_its_buckets(spark):
    """Three wordings of a notice, none frequent enough, which no single bucket need hold all of."""
    rng = random.Random(7)
    found = 0
    for _ in range(3):
        base = ["".join(rng.choice("klmnop") for _ in range(8)) for _ in range(30)]
        texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["new", *base[1:]])]
        rows = [("p", i, texts[i % 3] if i < 9 else " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(9))) for i in range(250)]
        df = spark.createDataFrame(rows, "package string, id long, content string")
        got = {r.chunk_id for r in repeated_lines(df, row_id="id", source="package", content="content").collect()}
        assert got in (set(), set(range(9)))
        found += len(got) == 9
    assert found >= 2  # each trial: near-duplicates of similarity 0.9 meet their head in one of three buckets or more


def test_removal(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc", 1), (2, None, 1), (3, "b", 1), (4, "", 1)], "id long, content string, line_no int")
    lines = spark.createDataFrame([(1, 2), (3, 1)], "chunk_id long, line_no long")
    got = {r.id: r.cleaned for r in without_lines(df, lines, row_id="id", content="content").collect()}
    assert got == {1: "a\n\nc", 2: None, 3: "", 4: ""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "package string, id long, content string")
    assert repeated_lines(df, row_id="id", source="package", content="content").count() == 0
