"""Schemas of the engine's tables and records, and checks of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPOSITORIES = (
    "id string, full_name string, clone_url string, default_branch string, last_indexed_at timestamp, status string, created_at timestamp, updated_at timestamp, active_index_run_id string"
)
INDEX_RUNS = (
    "id string, repo_id string, commit_sha string, branch string, status string, embedding_model string, chunking_version string, parser_version string,"
    " files_processed int, chunks_created int, chunks_deleted int, error_message string, started_at timestamp, completed_at timestamp"
)
CODE_CHUNKS = (
    "id string, repo_id string, index_run_id string, file_path string, chunk_type string, name string, parent_class string, language string, content string, content_hash string,"
    " line_start int, line_end int, embedding array<float>, metadata struct<line_count: int, oversized: boolean, docstring: string, calls: array<string>>, created_at timestamp"
)
PR_REVIEWS = (
    "id string, repo_id string, pr_number int, pr_title string, commit_sha string, review_run int, review_decision string, review_summary string, comments_count int,"
    " issues_found int, issues_resolved int, issues_open int, processing_ms int, created_at timestamp"
)
DIFF_FILES = (
    "full_name string, pr_number int, commit_sha string, file_idx int, filename string, old_filename string, status string, additions int, deletions int,"
    " hunks array<struct<header: string, content: string>>"
)
REVIEW = "body string, event string, comments array<struct<path: string, line: int, body: string>>"
EVENT_PAYLOAD = (
    "ref string, action string, repository struct<full_name: string, default_branch: string>,"
    " pull_request struct<number: int, title: string, head: struct<sha: string>>"
)

#: Allowed states.
ALLOWED = {
    "repository_status": ("pending", "indexing", "indexed", "failed"),
    "run_status": ("running", "completed", "superseded", "failed"),
    "chunk_type": ("function", "class", "method", "module"),
    "decision": ("APPROVE", "REQUEST_CHANGES", "COMMENT"),
}


def allowed(column: Column, kind: str) -> Column:
    """Whether a value is one of its enumeration; null is not."""
    return F.coalesce(column.isin(*ALLOWED[kind]), F.lit(False))


def checked(df: DataFrame, **kinds: str) -> DataFrame:
    """The frame; a row with a value outside its enumeration fails the job. ``kinds``: column to enumeration."""
    for column, kind in kinds.items():
        message = F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column), F.lit("null")))
        df = df.withColumn(column, F.when(allowed(F.col(column), kind), F.col(column)).otherwise(F.raise_error(message).cast("string")))
    return df


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose reference has no counterpart (J8); a null reference is none."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(key).isNotNull()).join(keys, child[key] == keys["_parent"], "left_anti")
