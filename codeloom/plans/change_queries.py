"""Registered queries of the snapshot comparison (problem 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators.snapshot_diff import chunk_changes, chunk_ordinals
from codeloom.session import table


def p1_found(spark, sf_dir):
    return chunk_changes(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "index_runs"))


def p1_keys(spark, sf_dir):
    """Keys of each branch's dictionary of ordinals, over all its snapshots."""
    known = chunk_ordinals(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "index_runs"))
    return known.groupBy("repo_id", "branch").agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("blocks", (F.xxhash64("file_path", "parent_class", "name", "chunk_type") % F.col("blocks")), "ordinal").alias("ordinals"))


QUERIES = {"p1_found": p1_found, "p1_keys": p1_keys}

_PLAIN = r"regexp_replace(replace(file_path, chr(92), '/'), '^(\./)+', '')"
_STEPS = "SELECT id, repo_id, branch, lead(id) OVER (PARTITION BY repo_id, branch ORDER BY started_at, id) AS next_id FROM index_runs WHERE status = 'completed' OR status = 'superseded'"

ORACLE = {
    # Both sides of every step in full: the older snapshot's keys under the step, then the newer one's.
    "p1_found": f"""
WITH step AS (SELECT repo_id, id AS a, next_id AS b FROM ({_STEPS}) WHERE next_id IS NOT NULL),
side AS (
  SELECT step.repo_id, a, b, {_PLAIN} AS file_path, parent_class, name, chunk_type,
         list_sort(list_distinct(list(lower(content_hash)) FILTER (index_run_id = a))) AS was, list_sort(list_distinct(list(lower(content_hash)) FILTER (index_run_id = b))) AS now
  FROM step JOIN code_chunks c ON c.index_run_id IN (a, b) GROUP BY ALL
)
SELECT repo_id, a AS prev_run_id, b AS run_id, file_path, parent_class, name, chunk_type,
       CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM side WHERE was IS DISTINCT FROM now
""",
    "p1_keys": f"""SELECT repo_id, branch, count(*) AS keys, count(*) AS ordinals FROM (
  SELECT DISTINCT r.repo_id, r.branch, {_PLAIN}, parent_class, name, chunk_type FROM ({_STEPS}) r JOIN code_chunks c ON c.index_run_id = r.id) GROUP BY 1, 2""",
}
