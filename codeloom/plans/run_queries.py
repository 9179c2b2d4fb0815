"""Registered queries of repositories and runs as tables and as documents of the store, with SQL for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.operators import run_log
from codeloom.operators.index_store import IndexStore
from codeloom.session import shared_folder, table

_AT = "2031-05-06 07:08:09"


def _utc(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def repository_get_or_create(spark, d):
    """Each repository is asked for again, under another address, along with a fork that is asked for twice."""
    r = table(spark, d, "repositories")
    fork = r.select(F.concat(F.lit("fork/"), "full_name").alias("full_name"), "clone_url", F.lit("dev").alias("default_branch"), F.col("updated_at").alias("at"))
    again = r.select("full_name", F.lit("elsewhere").alias("clone_url"), "default_branch", F.col("updated_at").alias("at"))
    after = run_log.get_or_create(r, fork.unionByName(again).unionByName(fork.withColumn("at", F.col("at") + F.expr("interval 1 hour"))))
    return after.select("id", "full_name", "clone_url", "default_branch", "status", _utc("created_at"), "active_index_run_id")


def repository_status(spark, d):
    """The status that the last run of each repository leads to."""
    status = F.when(F.col("status") == "running", "indexing").when(F.col("status") == "failed", "failed").otherwise("indexed")
    changes = table(spark, d, "index_runs").select(F.col("repo_id").alias("id"), status.alias("status"), F.col("started_at").alias("at"))
    return run_log.with_status(table(spark, d, "repositories"), changes).select("id", "full_name", "status", _utc("updated_at"))


def run_open(spark, d):
    asked = table(spark, d, "pr_reviews").select("repo_id", "commit_sha", F.lit("main").alias("branch"), F.col("created_at").alias("at"))
    return run_log.opened(asked.unionByName(asked)).select("id", "repo_id", "commit_sha", "branch", "status", "chunking_version", "files_processed", _utc("started_at"))


def run_complete(spark, d):
    after = run_log.finished(table(spark, d, "index_runs"), table(spark, d, "code_chunks"), F.lit(_AT).cast("timestamp"))
    return after.select("id", "status", "files_processed", "chunks_created", _utc("completed_at"))


def run_fail(spark, d):
    runs = table(spark, d, "index_runs")
    errors = runs.where(F.col("commit_sha") < "8").select("id", F.concat(F.lit("E "), "commit_sha").alias("error"))
    after = run_log.failed(runs, errors.unionByName(errors.withColumn("error", F.concat(F.lit("F "), "error"))), F.lit(_AT).cast("timestamp"))
    return after.select("id", "status", "error_message", _utc("completed_at"))


def run_activate(spark, d):
    after = run_log.activated(table(spark, d, "repositories"), table(spark, d, "index_runs"))
    return after.select("id", "active_index_run_id", _utc("last_indexed_at"))


def run_times(spark, d):
    runs = table(spark, d, "index_runs")
    return runs.select("id", run_log.short_sha(F.col("commit_sha")).alias("short"), run_log.elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("ms"))


def cascade_delete(spark, d):
    chunks, runs = run_log.cascade(table(spark, d, "code_chunks"), table(spark, d, "index_runs"), table(spark, d, "repositories").where("status <> 'failed'"))
    return chunks.select("id", F.lit("chunk").alias("kind")).unionByName(runs.select("id", F.lit("run").alias("kind")))


def store_documents(spark, d):
    """Three runs of each repository in a store of files in the shared folder: one completed, one completed and active, one failed."""
    store = IndexStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for row in table(spark, d, "repositories").select("full_name", "clone_url", "default_branch").toLocalIterator():
        repo = store.get_or_create_repository(row["full_name"], row["clone_url"], row["default_branch"])
        assert store.get_or_create_repository(row["full_name"], "other") == repo
        for commit in ("s1", "s2", "s3"):
            run = store.create_run(repo["id"], commit, row["default_branch"])
            if commit == "s3":
                store.fail_run(run, "E: broken")
            else:
                store.complete_run(run, files_processed=2, chunks_created=5)
                store.set_active_run(repo["id"], run["id"])
        store.update_repository_status(row["full_name"], "indexed")
    repositories = store.repositories().select(F.col("id").alias("repo_id"), "full_name", F.col("status").alias("state"), "active_index_run_id")
    return store.runs().join(repositories, "repo_id").select("full_name", "state", "commit_sha", "branch", "status", "chunks_created", "error_message", (F.col("id") == F.col("active_index_run_id")).alias("active"))


QUERIES = {
    f.__name__: f for f in (repository_get_or_create, repository_status, run_open, run_complete, run_fail, run_activate, run_times, cascade_delete, store_documents)
}

_TEXT = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')"

ORACLE = {
    "repository_get_or_create": f"""SELECT id, full_name, clone_url, default_branch, status, {_TEXT.format('created_at')} AS created_at, active_index_run_id FROM repositories
 UNION ALL SELECT substr(sha256('fork/' || full_name), 1, 32), 'fork/' || full_name, clone_url, 'dev', 'pending', {_TEXT.format('updated_at')}, NULL FROM repositories""",
    "repository_status": f"""WITH c AS (SELECT repo_id, CASE status WHEN 'running' THEN 'indexing' WHEN 'failed' THEN 'failed' ELSE 'indexed' END AS s, started_at FROM index_runs),
 l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, s DESC) = 1)
 SELECT id, full_name, coalesce(s, status) AS status, {_TEXT.format('coalesce(started_at, updated_at)')} AS updated_at FROM repositories LEFT JOIN l ON repo_id = id""",
    "run_open": f"""SELECT DISTINCT substr(sha256(repo_id || ':' || commit_sha || ':main:' || epoch_us(created_at)), 1, 32) AS id, repo_id, commit_sha, 'main' AS branch, 'running' AS status, '1.0' AS chunking_version,
 0 AS files_processed, {_TEXT.format('created_at')} AS started_at FROM pr_reviews""",
    "run_complete": f"""SELECT id, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status, CASE WHEN status = 'running' THEN (SELECT count(DISTINCT file_path) FROM code_chunks c WHERE c.index_run_id = r.id) ELSE files_processed END::INT AS files_processed,
 CASE WHEN status = 'running' THEN (SELECT count(*) FROM code_chunks c WHERE c.index_run_id = r.id) ELSE chunks_created END::INT AS chunks_created,
 CASE WHEN status = 'running' THEN '{_AT}.000000' ELSE {_TEXT.format('completed_at')} END AS completed_at FROM index_runs r""",
    "run_fail": f"""SELECT id, CASE WHEN status = 'running' AND commit_sha < '8' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND commit_sha < '8' THEN 'E ' || commit_sha ELSE error_message END AS error_message,
 CASE WHEN status = 'running' AND commit_sha < '8' THEN '{_AT}.000000' ELSE {_TEXT.format('completed_at')} END AS completed_at FROM index_runs""",
    "run_activate": f"""WITH l AS (SELECT repo_id, branch, id AS run, completed_at FROM index_runs WHERE status = 'completed' AND completed_at IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY repo_id, branch ORDER BY completed_at DESC, id DESC) = 1)
 SELECT p.id, coalesce(run, active_index_run_id) AS active_index_run_id, {_TEXT.format('coalesce(completed_at, last_indexed_at)')} AS last_indexed_at
 FROM repositories p LEFT JOIN l ON l.repo_id = p.id AND l.branch = p.default_branch""",
    "run_times": "SELECT id, left(commit_sha, 8) AS short, CASE WHEN completed_at >= started_at THEN (epoch_us(completed_at) - epoch_us(started_at)) // 1000 END AS ms FROM index_runs",
    "cascade_delete": """WITH r AS (SELECT id FROM index_runs WHERE repo_id IN (SELECT id FROM repositories WHERE status <> 'failed'))
 SELECT id, 'run' AS kind FROM r UNION ALL SELECT id, 'chunk' FROM code_chunks WHERE index_run_id IN (FROM r)""",
    "store_documents": """SELECT full_name, 'indexed' AS state, c AS commit_sha, default_branch AS branch, s AS status, n AS chunks_created, e AS error_message, a AS active
 FROM repositories, (VALUES ('s1', 'superseded', 5, NULL, false), ('s2', 'completed', 5, NULL, true), ('s3', 'failed', NULL, 'E: broken', false)) v(c, s, n, e, a)""",
}
