"""Repository events: signatures, routing, keyed deduplication and idempotent consumption (ST1-ST7, S7, S8, P13, P14, W13)."""

from __future__ import annotations

import hashlib
import hmac
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import EVENT_PAYLOAD

EVENTS = "event_id string, ts timestamp, event_type string, signature string, body binary"
#: A job key counts as pending for so long.
HORIZON = "1 hour"


def valid_signature(body: Column, signature: Column, secret: str) -> Column:
    """HMAC-SHA256 of the raw body against ``sha256=<hex>``, compared in constant time; a missing one is not valid."""
    key = secret.encode()

    def check(bodies: pd.Series, given: pd.Series) -> pd.Series:
        good = []
        for raw, text in zip(bodies, given):
            expected = "sha256=" + hmac.new(key, bytes(raw) if raw is not None else b"", hashlib.sha256).hexdigest()
            good.append(isinstance(text, str) and hmac.compare_digest(expected.encode(), text.encode()))
        return pd.Series(good)

    return F.pandas_udf(check, T.BooleanType())(body, signature)


def parsed(events: DataFrame) -> DataFrame:
    """Adds ``payload``; a body that is no JSON object gives null fields."""
    return events.withColumn("payload", F.from_json(F.col("body").cast("string"), EVENT_PAYLOAD))


def routed(events: DataFrame) -> DataFrame:
    """Jobs: kind, job_id, full_name, ref, pr_number, pr_title, commit_sha, ts. Stateless, so it works on streams and tables.

    Pushes count for the default branch only, pull requests when opened or updated; all else is left out. Reviews are keyed by commit too, so
    that a newer commit is never dropped as a repeat of an older one.
    """
    p = F.col("payload")
    repo = p["repository"]["full_name"]
    is_push = (F.col("event_type") == "push") & (p["ref"] == F.concat(F.lit("refs/heads/"), p["repository"]["default_branch"]))
    is_pull = (F.col("event_type") == "pull_request") & p["action"].isin("opened", "synchronize")
    number, sha = p["pull_request"]["number"], p["pull_request"]["head"]["sha"]
    job = F.when(is_push, F.concat_ws(":", F.lit("ingest"), repo, p["repository"]["default_branch"])).when(
        is_pull, F.concat_ws(":", F.lit("review"), repo, number.cast("string"), sha)
    )
    return parsed(events).where(is_push | is_pull).select(
        F.when(is_push, "ingest").otherwise("review").alias("kind"), job.alias("job_id"), repo.alias("full_name"),
        F.when(is_push, p["repository"]["default_branch"]).alias("ref"), F.when(is_pull, number).alias("pr_number"), F.when(is_pull, p["pull_request"]["title"]).alias("pr_title"), F.when(is_pull, sha).alias("commit_sha"), "ts",
    )


def deduplicated(jobs: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Streaming: the first job of each key within the horizon."""
    return jobs.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["job_id"])


def deduplicated_table(jobs: DataFrame, horizon_s: int = 3600) -> DataFrame:
    """The same over a table: a job is dropped if one of its key was kept at most ``horizon_s`` before it.

    Rows pass once, sorted by key and time, with the last kept time as the only state, so that no key is gathered in memory.
    Jobs of one key and time are one; a null time is never kept.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            times = batch.column("ts").cast(pa.int64()).to_pylist()
            keep = []
            for job, ts in zip(batch.column("job_id").to_pylist(), times):
                opens = ts is not None and (job != key or ts - last > horizon_s * 1_000_000)
                if opens:
                    key, last = job, ts
                keep.append(opens)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = jobs.dropDuplicates(["job_id", "ts"]).repartition("job_id").sortWithinPartitions("job_id", "ts")
    return ordered.mapInArrow(thin, jobs.schema)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The latest job of each key (latest wins, of equal times the greatest by its other columns); each task keeps its own before the shuffle."""
    rest = [c for c in jobs.columns if c != "job_id"]
    ordered = F.struct("ts", *[c for c in rest if c != "ts"])
    return jobs.groupBy("job_id").agg(F.max(ordered).alias("_last")).select(*[F.col("job_id") if c == "job_id" else F.col(f"_last.{c}").alias(c) for c in jobs.columns])


def read_events(spark: SparkSession, path: str, max_files: int = 5) -> DataFrame:
    """Unbounded intake of JSON files; ``max_files`` per trigger bounds the work in hand (ST6)."""
    return spark.readStream.schema(EVENTS.replace("body binary", "body string")).option("maxFilesPerTrigger", max_files).json(path).withColumn("body", F.col("body").cast("binary"))


class TransientError(Exception):
    """A failure after which another try may do."""


def is_transient(problem: Exception) -> bool:
    """Failures of connections and time are transient, all others are permanent."""
    return isinstance(problem, (TransientError, ConnectionError, TimeoutError))


def with_retries(work: Callable[[], None], *, tries: int = 3, delay_s: float = 30, limit_s: float = 600, transient: Callable[[Exception], bool] = is_transient, sleep=time.sleep, clock=time.monotonic) -> int:
    """Runs ``work`` and gives the number of tries; a transient failure is tried again after a delay, as long as tries and time last."""
    began = clock()
    for attempt in range(1, tries + 1):
        try:
            work()
            return attempt
        except Exception as problem:
            if not transient(problem) or attempt == tries or clock() - began + delay_s > limit_s:
                raise
            sleep(delay_s)
    return tries


def consume(
    jobs: DataFrame, history: Callable[[SparkSession], DataFrame], handle: Callable[[DataFrame], None], checkpoint: str, *, available_now: bool = True, **retries
):
    """Starts a query that hands each batch of jobs, less those whose commit is reviewed, to ``handle``; ``with_retries`` says when a failed batch is tried again (ST4, ST5)."""

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            reviewed = history(rows.sparkSession).select("full_name", "pr_number", "commit_sha").distinct()
            fresh = rows.join(reviewed, ["full_name", "pr_number", "commit_sha"], "left_anti")
            with_retries(lambda: handle(fresh), **retries)
        finally:
            rows.unpersist()

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
