import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation as E
from docloom.operators import fusion as U


def test_metrics_against_definition(spark):
    rng = random.Random(2)
    results, gold = [], []
    for q in range(12):
        ids = rng.sample(range(60), 25)
        results += [(q, i, n + 1) for n, i in enumerate(ids)] if q else []
        gold += [(q, i) for i in rng.sample(range(60), rng.randrange(1, 15))]
    got = {r.query_id: r for r in E.retrieval_metrics(spark.createDataFrame(results, "query_id long, id long, rank int"), spark.createDataFrame([*gold, gold[0]], "query_id long, id long")).collect()}
    for q in range(12):
        g = {i for k, i in gold if k == q}
        ranks = sorted(r for k, i, r in results if k == q and i in g)
        assert got[q].n_gold == len(g)
        for c in E.CUTS:
            assert math.isclose(got[q][f"recall_{c}"], sum(r <= c for r in ranks) / len(g), abs_tol=1e-8)
        assert math.isclose(got[q].mrr, 1 / ranks[0] if ranks else 0, abs_tol=1e-8)
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(g), 10) + 1))
        assert math.isclose(got[q].ndcg_10, sum(1 / math.log2(r + 1) for r in ranks if r <= 10) / ideal, abs_tol=1e-8)


def test_slices_and_tiers(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.5)], "p string, m double")
    assert {(r.p, r.n, r.m) for r in E.slices(df, ["p"], ["m"]).collect()} == {(None, 3, 0.5), ("a", 2, 0.5), ("b", 1, 0.5)}
    t = spark.createDataFrame([(1, 0.0), (30, 0.2), (15, 0.0), (None, 0.05), (40, 0.0), (None, 0.0)], "r int, j double").select(E.tier(F.col("r"), F.col("j")).alias("t"))
    assert [r.t for r in t.collect()] == ["direct", "direct", "paraphrase", "paraphrase", "vocabulary_mismatch", None]


def test_reference_drift(spark):
    chunks = spark.createDataFrame([(1, "u", "h", "x", "ax"), (2, "u", "h", "y", "ay"), (3, "v", "h", "z", "az")], "chunk_id long, source_url string, heading_path string, content_hash string, anchor string")
    gold = spark.createDataFrame(
        [(1, "u", "h", "y", "ay"), (2, "v", "h", "q", "az"), (3, "v", "h", "q", "other"), (4, "w", "h", "z", "az"), (5, None, None, "z", "az")],
        "ref_id long, source_url string, heading_path string, content_hash string, anchor string",
    )
    assert {r.ref_id: r.state for r in E.reference_drift(gold, chunks).collect()} == {1: "ok", 2: "hash mismatch", 3: "anchor drift", 4: "missing", 5: "missing"}


def test_reference_cascade(spark):
    chunks = spark.createDataFrame(
        [
            (1, "https://h/v2/guide/a", "h", "p", "x", "some  text\nof x"),
            (2, "https://h/v2/guide/a", "h", "p", "y", "text of y"),
            (3, "https://h/b", "h", "q", "z", "text of z"),
            (4, None, "h4", "p", "n", None),
            (5, "https://h/xguide/a", "h5", "p", "w", "text of w"),
            (6, "bare", "h6", "p", "v", "text of v"),
        ],
        "chunk_id long, source_url string, heading_path string, package string, content_hash string, content string",
    )
    gold = spark.createDataFrame(
        [
            (1, "https://h/v2/guide/a", "h", "p", "y", "of y"),
            (2, "https://old/guide/A", "h", "p", "y", "text of"),  # another host, no version prefix
            (3, "https://old/guide/a", "h", "p", "gone", "text of x"),
            (4, None, "h4", "p", "n", ""),
            (5, "https://h/none", "h", "q", "gone", "not there"),
            (6, "https://h/none", "h", None, "z", "of z"),
            (7, "https://h/none", "h", "r", "z", "of z"),
            (8, None, None, None, "z", "of z"),
            (9, "https://old/guide/a", "h5", "p", "w", None),  # ends alike, but not from a slash on
            (10, "", "h4", "p", None, "of"),
            (11, "https://h/bare", "h6", "r", "v", None),
        ],
        "ref_id long, source_url string, heading_path string, package string, content_hash string, anchor string",
    )
    assert {r.ref_id: (r.found_by, r.chunk_id, r.state) for r in E.reference_cascade(gold, chunks).collect()} == {
        1: ("url", 2, "ok"),
        2: ("suffix", 2, "ok"),
        3: ("suffix", 1, "hash mismatch"),
        4: ("heading", 4, "ok"),
        5: ("heading", 3, "hash mismatch, anchor drift"),
        6: ("heading", 3, "ok"),
        7: (None, None, "missing"),
        8: (None, None, "missing"),
        9: ("heading", 5, "ok"),
        10: ("heading", 4, "anchor drift"),
        11: (None, None, "missing"),
    }
    paths = spark.createDataFrame([(1, "p", "guide/a", "h"), (2, "q", "guide/a", "h"), (3, "p", "", "h4"), (4, "p", "guide/a", "h5")], "ref_id long, package string, source_path string, heading_path string")
    assert sorted((r.ref_id, r.chunk_id) for r in E.gold_chunks(paths, chunks).collect() if r.chunk_id) == [(1, 1), (1, 2), (3, 4), (4, 5)]
    assert [r.ref_id for r in E.gold_chunks(paths, chunks).where("chunk_id is null").collect()] == [2]


def test_cosine_blocks_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8)).round(3)
    x[7], x[8] = x[3], 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, embedding array<double>")
    queries = rows.where("id % 10 = 0 or id = 8").select(F.col("id").alias("query_id"), "embedding")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for qb, rb in ((512, 4096), (3, 11)):
        got = {}
        for r in U.cosine_top(queries, rows, 5, qb, rb).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert set(got) == set(range(0, 90, 10))
        for q in got:
            s = (unit @ unit[q]).round(6)
            want = sorted((i for i in range(90) if i != 8), key=lambda i: (-s[i], i))[:5]
            assert [i for i, _ in got[q]] == want


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3), (2, 5, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 30, 1), (1, 40, 2), (1, 50, 200)], "query_id long, id long, rank int")
    got = [(r.query_id, r.id, r.rank) for r in U.rank_fusion([(a, 1.0), (b, 1.0)]).orderBy("query_id", "rank").collect()]
    assert got == [(1, 30, 1), (1, 10, 2), (1, 20, 3), (1, 40, 4), (2, 5, 1)]
    heavy = U.rank_fusion([(a, 3.0), (b, 1.0)]).where("query_id = 1").orderBy("rank")
    assert [r.id for r in heavy.collect()][:2] == [30, 10]
    strict = a.where("query_id = 2")
    gate = {(r.query_id, r.id, r.rank) for r in U.gated(strict, U.rank_fusion([(a, 1.0), (b, 1.0)])).collect()}
    assert (2, 5, 1) in gate and (1, 30, 1) in gate


def test_weightings_at_once_rank_like_each_alone(spark):
    rng = random.Random(4)
    one = lambda: spark.createDataFrame([(q, i, r + 1) for q in range(4) for r, i in enumerate(rng.sample(range(150), 110))], "query_id long, id long, rank int")
    a, b = one(), one().where("query_id < 3")
    got = U.fused_ranks({"a": a, "b": b}, {"even": (1, 1.0), "heavy": (3, 1.0)}).collect()
    assert len(got) == len({(r.query_id, r.id) for r in got})
    for name, w in (("even", 1.0), ("heavy", 3.0)):
        assert {(r.query_id, r.id, r[name]) for r in got} == {(r.query_id, r.id, r["rank"]) for r in U.rank_fusion([(a, w), (b, 1.0)]).collect()}
    for name, df in (("a", a), ("b", b)):
        assert {(r.query_id, r.id, r[name]) for r in got if r[name]} == {tuple(r) for r in df.where("rank <= 100").collect()}


def test_metrics_by_class_equal_metrics_by_pairs(spark):
    import random

    rng = random.Random(2)
    classes = spark.createDataFrame([(i, f"c{rng.randrange(6)}") for i in range(40)], "id long, class string")
    own = classes.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    results = spark.createDataFrame([(q, i, r + 1) for q in range(0, 40, 5) for r, i in enumerate(rng.sample(range(40), 25))], "query_id long, id long, rank int")
    gold = own.join(classes, "class").select("query_id", "id")
    a = sorted(map(tuple, E.retrieval_metrics(results, gold).collect()))
    assert a == sorted(map(tuple, E.class_metrics(results, own, classes).collect())) and len(a) == 8
    with pytest.raises(ValueError):
        E.retrieval_metrics(results, gold, cuts=(0, 5))
    assert [r.query_id for r in E.without_gold(spark.createDataFrame([(0,), (99,)], "query_id long"), gold).collect()] == [99]


def test_question_sets(spark):
    rows = [("u", "h", "direct", 7, "x"), ("u", "h", "direct", 3, "y"), ("u", "h", "paraphrase", 5, "z"), (None, "h", "direct", 1, "n")]
    got = E.question_set(spark.createDataFrame(rows, "source_url string, heading_path string, tier string, at long, q string"), "at").collect()
    assert {(r.question_id, r.q) for r in got} == {("r0001", "n"), ("r0002", "y"), ("r0003", "z")}


def test_numbers_in_order_over_many_ranges(spark):
    from docloom.operators.ranks import numbered, running_total

    df = spark.range(5000).selectExpr("id % 3 AS g", "(id * 7919) % 5000 AS o", "1L AS v").repartition(7)
    got = numbered(df, ["g"], ["o"], "n").collect()
    want = {}
    for r in sorted(got, key=lambda r: r.o):
        want[r.g] = want.get(r.g, 0) + 1
        assert r.n == want[r.g]
    assert sorted(r.n for r in numbered(df, [], ["o"], "n").collect()) == list(range(1, 5001))
    assert running_total(df.limit(0), ["g"], ["o"], "v", "s").count() == 0


def test_id_spaces(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, h string")
    b = spark.createDataFrame([(2, "z"), (1, "x")], "id long, h string")
    assert {(r.id, r.h, r.side) for r in U.id_differences(a, b, ["id", "h"]).collect()} == {(2, "y", "a"), (2, "z", "b")}


def test_shared_vectors_are_ranked_like_each_row_its_own(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4)).round(2)
    x[5], x[6], x[7] = x[2], x[2] * 2, 0  # equal scores over different vectors, and one that matches nothing
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(12, None)], "vec long, embedding array<double>")
    rows = spark.createDataFrame([(i, i % 14) for i in range(100)], "id long, vec long")
    queries = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    out = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    own = rows.join(vectors, "vec").select("id", "embedding")
    want = out(U.cosine_top(own.where("id % 9 = 0").withColumnRenamed("id", "query_id"), own, 20))
    assert want and out(U.cosine_top_shared(queries, rows, vectors, 20)) == want
