"""Repositories and index runs as tables: what becomes of them is computed for all of them at once.

Every function takes tables and gives the rows as they are afterwards; ``index_store`` keeps the same states of single repositories in files.
Times and ids come from outside, so that a step gives the same rows whenever it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.conf import EngineConf


def short_sha(sha: Column, digits: int = 8) -> Column:
    """First digits of a commit id, as messages show it."""
    return F.substring(sha, 1, digits)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times; null where one is missing or the end comes first (F32)."""
    value = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")
    return F.when(end >= start, value)


def repository_id(full_name: Column) -> Column:
    """Id of a repository that is new, from its name alone."""
    return F.substring(F.sha2(full_name, 256), 1, 32)


def by_name(repositories: DataFrame, names: DataFrame) -> DataFrame:
    """Repositories with these full names, each once (S9); ``names``: full_name."""
    return repositories.join(names.select("full_name").distinct(), "full_name", "left_semi")


def get_or_create(repositories: DataFrame, wanted: DataFrame) -> DataFrame:
    """All repositories with those of ``wanted`` (full_name, clone_url, default_branch, at) that are not there yet.

    Rows that are there stay as they are. Of several wishes for one name the first by time and address counts; a null name is none.
    """
    first = F.min(F.struct("at", "clone_url", "default_branch")).alias("_w")
    new = wanted.where(F.col("full_name").isNotNull()).join(repositories.select("full_name"), "full_name", "left_anti").groupBy("full_name").agg(first)
    made = new.select(
        repository_id(F.col("full_name")).alias("id"), "full_name", "_w.clone_url", "_w.default_branch", F.lit(None).cast("timestamp").alias("last_indexed_at"),
        F.lit("pending").alias("status"), F.col("_w.at").alias("created_at"), F.col("_w.at").alias("updated_at"), F.lit(None).cast("string").alias("active_index_run_id"),
    )
    return repositories.select(*made.columns).unionByName(made)


def with_status(repositories: DataFrame, changes: DataFrame) -> DataFrame:
    """Repositories after changes (id, status, at): the last change by time counts, then the greatest status."""
    last = changes.groupBy("id").agg(F.max(F.struct("at", "status")).alias("_c"))
    changed = F.col("_c").isNotNull()
    return repositories.join(last, "id", "left").select(
        *[
            F.when(changed, F.col("_c.status")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(changed, F.col("_c.at")).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
            for c in repositories.columns
        ]
    )


def opened(requests: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """A running run for each request (repo_id, commit_sha, branch, at), its id from all four (W4). Repeated requests are one."""
    conf = conf or EngineConf()
    what = F.concat_ws(":", "repo_id", "commit_sha", "branch", F.unix_micros("at").cast("string"))
    none = F.lit(None)
    return requests.select("repo_id", "commit_sha", "branch", "at").distinct().select(
        F.substring(F.sha2(what, 256), 1, 32).alias("id"), "repo_id", "commit_sha", "branch", F.lit("running").alias("status"), F.lit(conf.embedding_model).alias("embedding_model"),
        F.lit(conf.chunking_version).alias("chunking_version"), F.lit(conf.parser_version).alias("parser_version"), F.lit(0).alias("files_processed"), F.lit(0).alias("chunks_created"),
        F.lit(0).alias("chunks_deleted"), none.cast("string").alias("error_message"), F.col("at").alias("started_at"), none.cast("timestamp").alias("completed_at"),
    )


def finished(runs: DataFrame, chunks: DataFrame, at: Column) -> DataFrame:
    """Running runs as completed, with the files and chunks that they have (W5, A3, A12); a run without chunks has none of either."""
    counts = chunks.groupBy("index_run_id").agg(F.count_distinct("file_path").cast("int").alias("_files"), F.count(F.lit(1)).cast("int").alias("_chunks"))
    running = F.col("status") == "running"
    after = {
        "status": F.lit("completed"), "files_processed": F.coalesce("_files", F.lit(0)), "chunks_created": F.coalesce("_chunks", F.lit(0)), "completed_at": at,
    }
    joined = runs.join(counts, runs["id"] == counts["index_run_id"], "left")
    return joined.select(*[F.when(running, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in runs.columns])


def failed(runs: DataFrame, errors: DataFrame, at: Column, longest: int = 2000) -> DataFrame:
    """Running runs with an error (id, error) as failed, the pointer of their repository untouched (W6); the least of several errors counts."""
    first = errors.groupBy("id").agg(F.min("error").alias("_error"))
    stops = (F.col("status") == "running") & F.col("_error").isNotNull()
    after = {"status": F.lit("failed"), "error_message": F.substring("_error", 1, longest), "completed_at": at}
    return runs.join(first, "id", "left").select(*[F.when(stops, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in runs.columns])


def activated(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories with the pointer at their last completed run on the default branch (W3); one without such a run keeps its pointer."""
    last = (
        runs.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())
        .select("repo_id", F.col("branch").alias("_branch"), "completed_at", F.col("id").alias("_run"))
        .groupBy("repo_id", "_branch")
        .agg(F.max(F.struct("completed_at", "_run")).alias("_last"))
    )
    own = (repositories["id"] == last["repo_id"]) & (repositories["default_branch"] == last["_branch"])
    after = {"active_index_run_id": F.col("_last._run"), "last_indexed_at": F.col("_last.completed_at")}
    return repositories.join(last, own, "left").select(*[F.coalesce(after[c], F.col(c)).alias(c) if c in after else F.col(c) for c in repositories.columns])


def cascade(chunks: DataFrame, runs: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and runs that are left once repositories are gone: runs go with their repository, chunks with their run."""
    kept = runs.join(repositories.select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    return chunks.join(kept.select(F.col("id").alias("index_run_id")), "index_run_id", "left_semi"), kept
