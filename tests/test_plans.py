"""Plans that must stay as they are: what is read, what is joined how."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import evaluation, search

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return entry.queries()


def test_no_query_crosses_tables(spark, queries):
    for name in ("search_any", "search_governed", "retrieval_metrics", "rank_fusion", "chunk_size_stats", "p1_found", "crawl_levels"):
        text = plan(queries[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_read_what_is_needed(spark, queries):
    text = plan(queries["pack_counts"](spark, SF))
    assert "summary" not in text and "heading_path" not in text
    text = plan(queries["p1_orphans_by_period"](spark, SF))
    assert "content" not in text.replace("content_hash", "") and "url" not in text
    assert "PushedFilters: [IsNotNull(" in plan(queries["packages_not_indexed"](spark, SF))


def test_partial_aggregation_comes_before_the_shuffle(spark, queries):
    assert "partial_count" in plan(queries["duplicate_contents"](spark, SF)) or "partial_min" in plan(queries["duplicate_contents"](spark, SF))


def test_every_sql_has_its_query(queries):
    sql = entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 38


def test_scores_are_summed_where_the_postings_lie(spark, queries):
    text = plan(queries["search_any"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(query_id" in text and "WindowGroupLimit" in text
    assert "SelectedBucketsCount" in text


@pytest.mark.parametrize("name", ["fusion_matrix", "question_ids", "search_any", "search_governed", "rank_fusion", "search_all", "rank_fusion_weighted", "tier_gaps", "gated_fusion", "question_tiers", "retrieval_metrics", "search_budget", "search_in_packages", "metric_slices", "search_excluding", "tier_counts"])
def test_no_row_for_each_query_and_matching_chunk(spark, queries, monkeypatch, name):
    """These rows grow with the square of the table."""
    monkeypatch.setattr(search, "matches", None)
    assert queries[name](spark, SF).columns


def test_ways_to_rank_share_one_plan(spark, queries):
    """A plan for each way shuffled the same lists again, beyond the disk allowed, and took more of the driver's memory."""
    text = plan(queries["fusion_matrix"](spark, SF))
    assert text.count("Exchange hashpartitioning") < 10 and len(text) < 50_000


def test_questions_are_numbered_from_what_is_written(spark, queries, monkeypatch):
    given = []
    monkeypatch.setattr(evaluation, "question_set", lambda df, order: given.append(df) or df.withColumn("question_id", F.lit("")))
    queries["question_ids"](spark, SF)
    assert given and "MapInArrow" not in plan(given[0]) and "Exchange" not in plan(given[0])
