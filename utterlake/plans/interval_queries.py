"""Registered queries on intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterlake.operators.intervals import periods_and_gaps
from utterlake.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").where("speaker IS NOT NULL AND end_time > start_time")
    return periods_and_gaps(rows, ["org_media_path", "speaker"], gap_ms=5_000)


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
WITH r AS (
  SELECT DISTINCT org_media_path, speaker, start_time AS s, end_time AS e FROM utterances
  WHERE speaker IS NOT NULL AND end_time > start_time
), o AS (
  SELECT *, max(e) OVER (PARTITION BY org_media_path, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r
), i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY org_media_path, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o
), p AS (
  SELECT org_media_path, speaker, island, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY ALL
), g AS (
  SELECT *, lead(s) OVER (PARTITION BY org_media_path, speaker ORDER BY s) AS after FROM p
)
SELECT org_media_path, speaker, 'merged' AS kind, s AS from_ms, e AS to_ms FROM p WHERE n > 1
UNION ALL
SELECT org_media_path, speaker, 'gap' AS kind, e AS from_ms, after AS to_ms FROM g WHERE after - e >= 5000
""",
}
