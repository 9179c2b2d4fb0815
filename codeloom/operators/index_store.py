"""Versioned, content-addressed snapshots of chunks.

``IndexStore`` keeps tables as parquet below one root. Chunks lie in a directory per run, which is written once. Rows of runs and repositories and
the active pointer are documents of numbered versions, of which the highest counts: a version is written aside and moved to a name that nobody
has yet, so that a reader sees the state before or the one after and a crash loses neither. The pointer's new version is the one commit point;
readers resolve it once, and a failed run leaves it as it was. There is one writer for each repository.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.conf import EngineConf
from codeloom.operators.chunking import chunk_files, with_embedding_text
from codeloom.operators.embedding import Embedder, embed
from codeloom.session import cut

CHUNK_KEY = ["index_run_id", "file_path", "content_hash"]
_CARRIED = ("file_path", "chunk_type", "name", "parent_class", "language", "content", "content_hash", "line_start", "line_end", "embedding", "metadata")


def unique_in_batch(chunks: DataFrame) -> DataFrame:
    """One row per (run, path, hash): the first by line, then by name and id."""
    order = [F.col(c) for c in ("line_start", "name", "id") if c in chunks.columns]
    return chunks.withColumn("_r", F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy(*order))).where(F.col("_r") == 1).drop("_r")


def insertable(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a batch that an idempotent insert adds: unique in the batch and not there yet."""
    return unique_in_batch(chunks).join(existing.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_anti")


def existing_by_hash(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per content hash (and ``by``), the last by creation and id (A8, S10); each task keeps its own last one before the shuffle."""
    keys = [*by, "content_hash"]
    last = F.max_by(F.struct(*[c for c in chunks.columns if c not in keys]), F.struct("created_at", "id")).alias("_row")
    return chunks.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in chunks.columns])


def reusable(new: DataFrame, existing: DataFrame, refresh_positions: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the active run whose content the new run has too (J1), one for each new chunk; positions are the old ones unless refreshed.

    With ``by``, such as the repository, many are compared at once, each with its own.
    """
    keys = [*by, "content_hash"]
    old = existing_by_hash(existing, by).select(*by, *_CARRIED)
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("line_start", "line_end", "name", "parent_class")])
    both = fresh.join(old, keys)
    if refresh_positions:
        return both.select(*by, *[F.col(f"_{c}").alias(c) if c in ("line_start", "line_end", "name", "parent_class") else F.col(c) for c in _CARRIED])
    return both.select(*by, *_CARRIED)


def copied(new: DataFrame, existing: DataFrame, run_id: Column, refresh_positions: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Rows that are carried over to the new run, with its id and ids of their own (W9); a (path, hash) is carried once."""
    rows = reusable(new, existing, refresh_positions, by).withColumn("index_run_id", run_id)
    return unique_in_batch(rows.withColumn("id", chunk_id()))


def chunk_id() -> Column:
    """Id of a chunk within its run, the same whenever it is written again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", "index_run_id", "file_path", "content_hash"), 256), 1, 32)


def to_embed(new: DataFrame, existing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """New chunks whose content the active run lacks."""
    return new.join(existing.select(*by, "content_hash").distinct(), [*by, "content_hash"], "left_anti")


def deleted_chunks(new: DataFrame, existing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chunks of the active run that the new one lacks."""
    return existing.join(new.select(*by, "content_hash").distinct(), [*by, "content_hash"], "left_anti")


def superseded(runs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Status of each run after its repository's pointer: other completed runs are superseded."""
    active = repositories.select(F.col("id").alias("repo_id"), "active_index_run_id")
    current = F.col("id").eqNullSafe(F.col("active_index_run_id"))
    status = F.when((F.col("status") == "completed") & F.col("active_index_run_id").isNotNull() & ~current, "superseded").otherwise(F.col("status"))
    return runs.join(active, "repo_id", "left").withColumn("status", status).drop("active_index_run_id")


def run_counts(chunks: DataFrame) -> DataFrame:
    """Files and chunks of each run."""
    return chunks.groupBy("index_run_id").agg(F.count_distinct("file_path").alias("files_processed"), F.count(F.lit(1)).alias("chunks_created"))


@dataclass(frozen=True)
class IndexResult:
    """What a run did."""

    run_id: str
    copied: int
    inserted: int
    failed: int
    duplicate: int
    deleted: int
    files: int


class IndexStore:
    """Snapshots below ``root``, a path that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, conf: EngineConf | None = None):
        self.spark, self.root, self.conf = spark, root.rstrip("/"), conf or EngineConf()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _versions(self, *parts: str) -> list[str]:
        """Names of a document's versions, the latest last."""
        place = self._path(*parts)
        if not self._fs.exists(place):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place) if f.getPath().getName().startswith("v"))

    def _read_json(self, *parts: str) -> dict | None:
        versions = self._versions(*parts)
        if not versions:
            return None
        stream = self._fs.open(self._path(*parts, versions[-1]))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _write_json(self, value: dict, *parts: str) -> None:
        """A further version, written aside and moved to its own name; older versions but the one before are cleared away."""
        versions = self._versions(*parts)
        number = int(versions[-1][1:-5]) + 1 if versions else 1
        self._fs.mkdirs(self._path(*parts))
        aside, target = self._path(*parts, f"_new-{number:012d}"), self._path(*parts, f"v{number:012d}.json")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(value).encode("utf-8")))
        stream.close()
        if not self._fs.rename(aside, target):
            raise OSError(f"cannot move {aside} to {target}")
        for old in versions[:-1]:
            self._fs.delete(self._path(*parts, old), False)

    def _documents(self, pattern: str, schema: str) -> DataFrame:
        """The latest version of all documents below the root that match."""
        places = self._fs.globStatus(self._path(pattern, "v*.json"))
        if not places:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).json("/".join([self.root, pattern, "v*.json"])).withColumn("_file", F.col("_metadata.file_path"))
        parts = F.split("_file", "/")
        latest = F.max_by(F.struct(*[c for c in read.columns if c != "_file"]), F.element_at(parts, -1))
        return read.groupBy(F.regexp_replace("_file", "/[^/]+$", "").alias("_document")).agg(latest.alias("_row")).select("_row.*")

    # repositories and runs

    @staticmethod
    def repo_id(full_name: str) -> str:
        return hashlib.sha256(full_name.encode()).hexdigest()[:32]

    def get_or_create_repository(self, full_name: str, clone_url: str, default_branch: str = "main") -> dict:
        """The repository's row; an existing one comes back as it is."""
        row = self._read_json("repositories", self.repo_id(full_name), "row")
        if row is None:
            row = {"id": self.repo_id(full_name), "full_name": full_name, "clone_url": clone_url, "default_branch": default_branch, "status": "pending", "created_at": time.time(), "updated_at": time.time()}
            self._write_json(row, "repositories", row["id"], "row")
        return self.get_repository(full_name)

    def get_repository(self, full_name: str) -> dict | None:
        """By name, with the active run."""
        row = self._read_json("repositories", self.repo_id(full_name), "row")
        return None if row is None else row | {"active_index_run_id": self.active_run(row["id"])}

    def update_repository_status(self, full_name: str, status: str) -> None:
        """W2, W14."""
        row = self._read_json("repositories", self.repo_id(full_name), "row")
        self._write_json(row | {"status": status, "updated_at": time.time()}, "repositories", row["id"], "row")

    def active_run(self, repo_id: str) -> str | None:
        pointer = self._read_json("repositories", repo_id, "active")
        return pointer and pointer["index_run_id"]

    def set_active_run(self, repo_id: str, run_id: str) -> None:
        """The commit point."""
        self._write_json({"repo_id": repo_id, "index_run_id": run_id, "at": time.time()}, "repositories", repo_id, "active")

    def create_run(self, repo_id: str, commit_sha: str, branch: str) -> dict:
        """W4."""
        started = time.time_ns()
        run = {
            "id": hashlib.sha256(f"{repo_id}:{commit_sha}:{branch}:{started}".encode()).hexdigest()[:32], "repo_id": repo_id, "commit_sha": commit_sha, "branch": branch, "status": "running",
            "embedding_model": self.conf.embedding_model, "chunking_version": self.conf.chunking_version, "parser_version": self.conf.parser_version, "started_at": started / 1e9,
        }
        self._write_json(run, "runs", repo_id, run["id"])
        return run

    def run(self, repo_id: str, run_id: str) -> dict | None:
        """The run with its derived status: completed but not active is superseded."""
        run = self._read_json("runs", repo_id, run_id)
        if run and run["status"] == "completed" and self.active_run(repo_id) not in (None, run_id):
            run["status"] = "superseded"
        return run

    def _finish(self, run: dict, **values) -> None:
        self._write_json(run | values | {"completed_at": time.time()}, "runs", run["repo_id"], run["id"])

    def complete_run(self, run: dict, **counters) -> None:
        """W5."""
        self._finish(run, status="completed", **counters)

    def fail_run(self, run: dict, error: str) -> None:
        """The pointer stays."""
        self._finish(run, status="failed", error_message=error)

    def repositories(self) -> DataFrame:
        """All repositories with their active run, in one job."""
        fields = "id string, full_name string, clone_url string, default_branch string, status string, created_at double, updated_at double"
        pointers = self._documents("repositories/*/active", "repo_id string, index_run_id string, at double").select(F.col("repo_id").alias("id"), F.col("index_run_id").alias("active_index_run_id"))
        return self._documents("repositories/*/row", fields).join(pointers, "id", "left")

    def runs(self) -> DataFrame:
        """All runs with their derived status, in one job."""
        fields = (
            "id string, repo_id string, commit_sha string, branch string, status string, embedding_model string, chunking_version string, parser_version string,"
            " files_processed int, chunks_created int, chunks_deleted int, error_message string, started_at double, completed_at double"
        )
        return superseded(self._documents("runs/*/*", fields), self.repositories())

    # chunks

    def run_chunks(self, repo_id: str, run_id: str) -> DataFrame | None:
        path = self._path("chunks", f"repo_id={repo_id}", f"index_run_id={run_id}")
        return self.spark.read.parquet(path.toString()).withColumn("index_run_id", F.lit(run_id)) if self._fs.exists(path) else None

    def active_chunks(self, repo_id: str) -> DataFrame | None:
        """S10; None without an active run."""
        run_id = self.active_run(repo_id)
        return None if run_id is None else self.run_chunks(repo_id, run_id)

    def write_chunks(self, chunks: DataFrame, repo_id: str, run_id: str) -> int:
        """Appends what is new to a run and tells how many rows that were."""
        rows = chunks.withColumn("index_run_id", F.lit(run_id))
        rows = rows.withColumn("id", chunk_id())
        existing = self.run_chunks(repo_id, run_id)
        rows = cut(unique_in_batch(rows) if existing is None else insertable(rows, existing))
        count = rows.count()
        if count or existing is None:
            path = self._path("chunks", f"repo_id={repo_id}", f"index_run_id={run_id}").toString()
            rows.select("id", *_CARRIED).withColumn("created_at", F.current_timestamp()).sortWithinPartitions("file_path").write.mode("append").parquet(path)
        return count

    def index(self, files: DataFrame, full_name: str, commit_sha: str, embedder: Embedder, *, clone_url: str = "", branch: str = "main", refresh_positions: bool = False, reuse_any_model: bool = False) -> IndexResult:
        """A new run of a repository from its files (rel_path, content): chunk, split, copy forward, embed, insert, commit (X11)."""
        repo = self.get_or_create_repository(full_name, clone_url, branch)
        self.update_repository_status(full_name, "indexing")
        run = self.create_run(repo["id"], commit_sha, branch)
        try:
            new = cut(chunk_files(files, max_lines=self.conf.chunk_max_lines, calls_kept=self.conf.calls_kept))
            active = self.active_run(repo["id"])
            existing = self.active_chunks(repo["id"])
            if existing is not None and not reuse_any_model and (self.run(repo["id"], active) or {}).get("embedding_model") != self.conf.embedding_model:
                existing = None
            copied, fresh = 0, new
            deleted = 0
            if existing is not None:
                copied = self.write_chunks(reusable(new, existing, refresh_positions), repo["id"], run["id"])
                fresh = to_embed(new, existing)
                deleted = deleted_chunks(new, existing).count()
            embedded = cut(
                embed(with_embedding_text(fresh, self.conf.calls_embedded), "embedding_text", embedder, batch=self.conf.embedding_batch, dimension=self.conf.embedding_dimension)
            )
            good = embedded.where(F.col("embedding").isNotNull())
            inserted = self.write_chunks(good.select(*_CARRIED), repo["id"], run["id"])
            total, failed = embedded.count(), embedded.where(F.col("embedding").isNull()).count()
            counts = new.agg(F.count_distinct("file_path")).first()[0]
            self.complete_run(run, chunks_created=copied + inserted, files_processed=counts, chunks_deleted=deleted)
            self.set_active_run(repo["id"], run["id"])
            self.update_repository_status(full_name, "indexed")
            return IndexResult(run["id"], copied, inserted, failed, total - failed - inserted, deleted, counts)
        except Exception as problem:
            self.fail_run(run, f"{type(problem).__name__}: {problem}"[:2000])
            self.update_repository_status(full_name, "failed")
            raise
