import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import reports as R
from docloom.sources.records import read_json_lines, read_questions, read_summary_cache, read_tasks


def test_personas(spark):
    df = spark.createDataFrame([(1, "how do I a\n\na b\nwhat is a\nc d\n"), (2, "only one"), (3, None)], "id long, r string")
    got = {r.id: r.q for r in df.select("id", R.persona_queries(F.col("r")).alias("q")).collect()}
    assert [tuple(x) for x in got[1]] == [("expert", "how do I a", "a b"), ("paraphrase", "what is a", "c d")]
    assert [tuple(x) for x in got[2]] == [("expert", "only one", ""), ("paraphrase", "", "")]
    flat = df.select("id", F.explode(R.persona_queries(F.col("r"))).alias("q")).select("id", "q.*")
    assert {r.id: r.shared for r in R.shared_terms(flat, ["id"]).collect()}[1] == ["a"]
    keys = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    have = spark.createDataFrame([(1, "expert"), (1, "paraphrase"), (2, "expert")], "id long, persona string")
    assert [tuple(r) for r in R.missing_kinds(keys, have, ["id"], "persona", ["expert", "paraphrase"]).collect()] == [(2, "paraphrase")]


def test_grading_and_rates(spark):
    df = spark.createDataFrame([("a", "def f(): pass"), ("b", "import os"), ("c", None)], "id string, r string")
    got = {r.id: (r.passed, r.failures) for r in R.graded(df, "r", [r"def \w+"], ["import os"]).collect()}
    assert got == {"a": (True, []), "b": (False, [r"missing: def \w+", "forbidden: import os"]), "c": (False, [r"missing: def \w+"])}
    runs = spark.createDataFrame([("x", 1, True, 2.0), ("x", 3, False, 4.0), ("x", None, False, 6.0), ("x", 3, True, 0.0)], "arm string, answered_at int, passed boolean, latency double")
    assert [tuple(r) for r in R.pass_rates(runs).collect()] == [("x", 4, 0.5, 3.0, 12.0)]
    assert [tuple(r) for r in R.convergence(runs).orderBy("turn").collect()] == [("x", 1, 0.25, 0.25), ("x", 2, 0.25, 0.25), ("x", 3, 0.75, 0.5)]


def test_comparison_and_cost(spark):
    a, b = (spark.createDataFrame(x, "tool string, n long") for x in ([("s", 100), ("gone", 5)], [("s", 120), ("new", 7)]))
    assert {r.tool: (r.before, r.after, r.change_percent) for r in R.compared(a, b, "tool", "n").collect()} == {"s": (100, 120, 20.0), "gone": (5, 0, -100.0), "new": (0, 7, None)}
    cost = R.response_cost(spark.createDataFrame([(1, "x" * 40), (1, "y" * 40)], "q long, t string"), "q", ["t"]).first()
    assert (cost.tokens, cost.n_results, cost.tokens_each) == (24, 2, 12.0)
    assert spark.range(1).select(R.disclosure_saving(F.lit(200), F.lit(60), F.lit(40)).alias("s")).first().s == 50.0


def test_record_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"prompt_version": "v1", "model": "m"}\n{"content_hash": "h", "summary": "s"}\n')
    assert [tuple(r) for r in read_summary_cache(spark, str(tmp_path / "c.jsonl"), "v1", "m").collect()] == [("h", "s")]
    with pytest.raises(ValueError):
        read_summary_cache(spark, str(tmp_path / "c.jsonl"), "v2", "m")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):  # noqa: B017
        read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    q = {"id": "r1", "difficulty": "direct", "query": "q", "keyword_query": "k", "gold": [{"heading_path": "a / b", "content_hash": "h"}, {"heading_path": "c"}]}
    (tmp_path / "q.json").write_text(json.dumps({"schema_version": 2, "questions": [q]}, indent=1))
    got = read_questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r.id, r.heading_path, r.content_hash) for r in got] == [("r1", "a / b", "h"), ("r1", "c", None)]
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 2, "questions": [q, q]}))
    with pytest.raises(ValueError):
        read_questions(spark, str(tmp_path / "d.json"))


def test_warnings_of_changes(spark):
    a = spark.createDataFrame([("s", 100.0), ("t", 100.0), ("u", 50.0)], "tool string, n double")
    b = spark.createDataFrame([("s", 121.0), ("t", 120.0), ("u", 39.0), ("new", 1.0)], "tool string, n double")
    got = {r.tool: r.warning for r in R.compared(a, b, "tool", "n", {"s": 20.0, "t": 20.0}, {"u": 40.0}).collect()}
    assert got == {"s": "grown", "t": None, "u": "too small", "new": None}


def test_task_sets(spark, tmp_path):
    good = {"id": "a", "prompt": "do", "graders": {"must_parse": True, "must_match": ["x"], "must_not_match": []}, "teaches": ["t"]}

    def read(*tasks):
        (tmp_path / "t.json").write_text(json.dumps({"tasks": list(tasks)}))
        return read_tasks(spark, str(tmp_path / "t.json"))

    assert [(r.id, r.must_parse, r.must_match, r.teaches) for r in read(good).collect()] == [("a", True, ["x"], ["t"])]
    for bad in (good | {"prompt": " "}, good | {"id": None}, {k: v for k, v in good.items() if k != "graders"}, good | {"graders": {"must_match": [""]}}):
        with pytest.raises(ValueError):
            read(bad)
    with pytest.raises(ValueError):
        read(good, good)
