"""Queries of the general data-quality problems, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import orphan_references, orphans_by_period
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    chunks = orphan_references(table(spark, sf_dir, "chunks"), pages, ref_table="chunks", ref_key="page_id", parent_key="id", valid_from="ingested_at", valid_to="deleted_at")
    packs = orphan_references(pages, table(spark, sf_dir, "packages"), ref_table="pages", ref_key="package", parent_key="name", valid_from="indexed_at", valid_to="removed_at")
    return chunks.union(packs)


def p1_orphans_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_period(p1_found(spark, sf_dir))


P1_SQL = """
SELECT DISTINCT 'chunks' AS ref_table, c.id AS row_id, strftime(c.ingested_at AT TIME ZONE 'UTC', '%Y-%m') AS period
FROM chunks c WHERE c.page_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM pages p WHERE p.id = c.page_id AND p.ingested_at <= c.ingested_at
  AND (p.deleted_at IS NULL OR c.ingested_at < p.deleted_at))
UNION ALL
SELECT DISTINCT 'pages', p.id, strftime(p.ingested_at AT TIME ZONE 'UTC', '%Y-%m')
FROM pages p WHERE p.package IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM packages k WHERE k.name = p.package AND CAST(k.indexed_at AS TIMESTAMPTZ) <= p.ingested_at
  AND (k.removed_at IS NULL OR p.ingested_at < CAST(k.removed_at AS TIMESTAMPTZ)))
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_period": p1_orphans_by_period}
ORACLES = {
    "p1_found": P1_SQL,
    "p1_orphans_by_period": f"SELECT ref_table, period, count(*) AS n_orphans FROM ({P1_SQL}) GROUP BY ref_table, period",
}
