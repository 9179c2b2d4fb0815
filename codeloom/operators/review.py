"""Prompts, structured reviews and their payloads for many pull requests at once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.diff import parse_diffs
from codeloom.operators.embedding import Embedder, embed
from codeloom.operators.search import HIT_COLUMNS, active_chunks, format_context, merge_hits, top_k_per_query
from codeloom.operators.symbols import file_queries
from codeloom.schemas import REVIEW, allowed

SYSTEM_PROMPT = (
    "You review pull requests. Point out defects, risks and unclear changes that the diff shows, with file and line. Say what you cannot judge."
    " Answer as JSON with body, event (APPROVE, REQUEST_CHANGES or COMMENT) and comments (path, line, body)."
)
CONTEXT_TITLE = "## Codebase Context\n"
WITHOUT_CONTEXT = CONTEXT_TITLE + "No excerpts of the codebase are at hand for this review. Judge by the diff alone and say so in the summary."
WITH_CONTEXT = CONTEXT_TITLE + "These excerpts of the codebase relate to the change; check the change against them.\n\n"


def diff_text(files: DataFrame, key: tuple[str, ...] = ("full_name", "pr_number", "commit_sha")) -> DataFrame:
    """Changed files of each pull request as text, in order."""
    head = F.concat(
        F.lit("### "), "filename", F.lit(" ["), "status", F.lit("] +"), F.col("additions").cast("string"), F.lit(" -"), F.col("deletions").cast("string"),
        F.when(F.col("old_filename") != "", F.concat(F.lit(" (renamed from "), "old_filename", F.lit(")"))).otherwise(""),
    )
    hunks = F.flatten(F.transform("hunks", lambda h: F.array(h["header"], h["content"])))
    body = F.when(F.size("hunks") > 0, F.array_join(hunks, "\n")).otherwise(F.lit("(no diff available for this file)"))
    listed = files.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("file_idx", F.concat(head, F.lit("\n"), body).alias("text")))).alias("_files"))
    return listed.select(*key, F.array_join(F.transform("_files", lambda f: f["text"]), "\n\n").alias("diff_text"))


def prompt(title: Column, diff: Column, context: Column, skipped: Column) -> Column:
    """Prompt for one pull request; without context it says so."""
    has = (F.coalesce(context, F.lit("")) != "") & ~F.coalesce(skipped, F.lit(False))
    section = F.when(has, F.concat(F.lit(WITH_CONTEXT), context)).otherwise(F.lit(WITHOUT_CONTEXT))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), section, F.lit("\n\n## Changes\n"), F.coalesce(diff, F.lit("(no files changed)")))


class Reviewer(Protocol):
    """A provider of reviews as JSON texts; it is sent to the executors with the job."""

    def review(self, prompt: str) -> str: ...


class RuleReviewer:
    """Offline provider: asks for changes where the prompt holds a marker of unfinished work."""

    def review(self, prompt: str) -> str:
        marked = [line for line in prompt.splitlines() if line.startswith("+") and ("TODO" in line or "FIXME" in line)]
        event = "REQUEST_CHANGES" if marked else "COMMENT"
        return json.dumps({"body": f"{len(marked)} added lines hold markers of unfinished work.", "event": event, "comments": []})


def analyze(requests: DataFrame, reviewer: Reviewer, text: str = "prompt") -> DataFrame:
    """Adds ``review`` and ``error``; rows that have an error already are passed by, and one failure stops no other row."""
    kept = requests.drop("review", "_answer", "_problem")
    kept = kept if "error" in kept.columns else kept.withColumn("error", F.lit(None).cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField("_answer", T.StringType()), T.StructField("_problem", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found: list[tuple[str | None, str | None]] = []
            for question, error in zip(rows.column(rows.schema.get_field_index(text)).to_pylist(), rows.column(rows.schema.get_field_index("error")).to_pylist()):
                if error is not None:
                    found.append((None, None))
                    continue
                try:
                    found.append((reviewer.review(question or ""), None))
                except Exception as problem:
                    found.append((None, f"analyze failed: {problem}"))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([a for a, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=[*rows.schema.names, "_answer", "_problem"])

    return validated(kept.mapInArrow(run, schema))


def validated(answers: DataFrame) -> DataFrame:
    """``_answer`` as a struct; a malformed one, an unknown event and a blank body are errors."""
    parsed = F.from_json("_answer", REVIEW)
    review = F.col("_review")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(review.isNull() | review["body"].isNull() | ~allowed(review["event"], "decision"), F.lit("analyze failed: the answer is no review"))
        .when(F.trim(review["body"]) == "", F.lit("analyze failed: the review is empty"))
    )
    out = answers.withColumn("_review", parsed).withColumn("error", problem)
    return out.withColumn("review", F.when(F.col("error").isNull(), F.col("_review"))).drop("_answer", "_problem", "_review")


def payload(commit_sha: Column, review: Column, drop_comments: bool = False) -> Column:
    """Body of the request that posts a review; comments are left out where there are none, or after a refusal of their lines."""
    comments = F.when(F.size(review["comments"]) > 0, review["comments"])
    fields = [commit_sha.alias("commit_id"), review["body"].alias("body"), review["event"].alias("event")]
    return F.to_json(F.struct(*fields, *([] if drop_comments else [comments.alias("comments")])))


def http_error_class(status: Column) -> Column:
    """Whether a failed call is worth another try (F30); null where the call did not fail or was not made."""
    transient = status.isin(429, 503, 504)
    return F.when(status >= 400, F.when(transient, "transient").otherwise("permanent"))


class Poster(Protocol):
    """Delivers the body of a review; it is sent to the executors with the job and answers with the status of the call."""

    def post(self, body: str) -> int: ...


def post(reviews: DataFrame, poster: Poster, commit: str = "commit_sha") -> DataFrame:
    """Adds ``status``, ``dropped_comments`` and ``post_error`` to rows with a ``review``.

    A review that is refused with 422 is sent once more without its comments, since lines outside the diff are what is refused; any other
    failure is reported with its class. Rows without a review are not sent.
    """
    kept = reviews.drop("status", "dropped_comments", "post_error", "_full", "_bare", "_commented")
    review = F.col("review")
    bodies = kept.select("*", F.when(review.isNotNull(), payload(F.col(commit), review)).alias("_full"), F.when(review.isNotNull(), payload(F.col(commit), review, True)).alias("_bare"), (F.size(review["comments"]) > 0).alias("_commented"))
    schema = T.StructType([*bodies.schema.fields, T.StructField("status", T.IntegerType()), T.StructField("dropped_comments", T.BooleanType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            full, bare, commented = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("_full", "_bare", "_commented"))
            found: list[tuple[int | None, bool]] = []
            for body, shorter, has in zip(full, bare, commented):
                if body is None:
                    found.append((None, False))
                    continue
                status, again = poster.post(body), False
                if status == 422 and has:
                    status, again = poster.post(shorter), True
                found.append((status, again))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([s for s, _ in found], pa.int32()), pa.array([d for _, d in found], pa.bool_())], names=[*rows.schema.names, "status", "dropped_comments"])

    return bodies.mapInArrow(send, schema).withColumn("post_error", http_error_class(F.col("status"))).drop("_full", "_bare", "_commented")


def review_changes(
    diffs: DataFrame, chunks: DataFrame, repositories: DataFrame, embedder: Embedder, reviewer: Reviewer, *, dimension: int, min_score: float = 0.70, query_top_k: int = 5, top_k: int = 10
) -> DataFrame:
    """From raw diffs (full_name, pr_number, commit_sha, pr_title, raw_diff) to reviews, all pull requests in one plan.

    Changed files give queries, which search the repository's active run; the excerpts found go into the prompt, and the reviewer's answer
    is validated. Pull requests without an indexed repository or without hits are reviewed by their diff alone.
    """
    files = parse_diffs(diffs)
    key = ["full_name", "pr_number", "commit_sha"]
    asked = file_queries(files).select(*key, "file_idx", "query")
    vectors = embed(asked, "query", embedder, dimension=dimension).where(F.col("embedding").isNotNull())
    known = repositories.where(F.col("active_index_run_id").isNotNull()).select(F.col("id").alias("repo_id"), "full_name", "active_index_run_id")
    # A scope of a search is one pull request over its repository's run; queries of one repository meet its chunks once.
    scoped = vectors.join(known, "full_name").select("repo_id", *key, "file_idx", F.col("embedding").alias("vector"), F.xxhash64(*key, "file_idx").alias("q_idx"))
    scope = active_chunks(chunks, repositories)
    hits = top_k_per_query(scope, scoped, top_k=query_top_k, min_score=min_score, scope="repo_id")
    per_change = hits.join(scoped.drop("vector").withColumnsRenamed({"repo_id": "_repo", "q_idx": "_q"}), (F.col("repo_id") == F.col("_repo")) & (F.col("q_idx") == F.col("_q")))
    ranked = merge_hits(per_change.withColumn("q_idx", F.col("file_idx")), top_k, ("repo_id", *key))
    found = ranked.join(scope.select("repo_id", "id", *HIT_COLUMNS), ["repo_id", "id"])
    contexts = format_context(found, tuple(key))
    texts = diffs.select(*key, "pr_title").dropDuplicates(key).join(diff_text(files), key, "left").join(contexts, key, "left")
    prompted = texts.withColumn("prompt", prompt(F.coalesce("pr_title", F.lit("")), F.col("diff_text"), F.col("context"), F.col("context").isNull()))
    return analyze(prompted.drop("diff_text", "context"), reviewer)
