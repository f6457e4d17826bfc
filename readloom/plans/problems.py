"""Queries of the general (core) problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.operators.spans import spans_and_gaps, unpack_intervals
from readloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and gaps of every panel and contig."""
    lists = table(spark, sf_dir, "bed_reglist")
    return spans_and_gaps(unpack_intervals(lists, "a", "panel_id", "contig"), ["panel_id", "contig"])


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
WITH e AS (
  SELECT DISTINCT panel_id, contig, x >> 32 AS s, x & 4294967295 AS t
  FROM (SELECT panel_id, contig, unnest(a) AS x FROM bed_reglist) WHERE x IS NOT NULL
), o AS (
  SELECT *, max(t) OVER (PARTITION BY panel_id, contig ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM e WHERE t > s
), i AS (
  SELECT *, count(*) FILTER (p IS NULL OR s > p) OVER (PARTITION BY panel_id, contig ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM o
), spans AS (
  SELECT panel_id, contig, island, min(s) AS start_pos, max(t) AS end_pos FROM i GROUP BY ALL
), g AS (
  SELECT panel_id, contig, lag(end_pos) OVER (PARTITION BY panel_id, contig ORDER BY island) AS start_pos, start_pos AS end_pos FROM spans
)
SELECT panel_id, contig, 'span' AS kind, start_pos, end_pos FROM spans
UNION ALL SELECT panel_id, contig, 'gap', start_pos, end_pos FROM g WHERE start_pos IS NOT NULL
""",
}
