"""Append-only review history and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["repo_id", "pr_number"]


def issues_found(decision: Column, comments: Column) -> Column:
    """The comments of a review that asks for changes, else none."""
    return F.when(decision == "REQUEST_CHANGES", comments).otherwise(F.lit(0))


def reviews_latest(reviews: DataFrame) -> DataFrame:
    """The latest review of each pull request; equal times are decided by id (Wn1)."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("id"))
    return reviews.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def reviews_first(reviews: DataFrame) -> DataFrame:
    """The first review of each pull request (Wn2)."""
    w = Window.partitionBy(*KEY).orderBy("created_at", "id")
    return reviews.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def review_progress(reviews: DataFrame) -> DataFrame:
    """First against latest review of each pull request, in one aggregation."""
    at = F.struct("created_at", "id")
    first = F.min_by(F.struct("pr_title", "issues_found", "review_decision", "created_at"), at)
    latest = F.max_by(F.struct("review_run", "issues_found", "issues_resolved", "review_decision", "created_at"), at)
    both = reviews.groupBy(*KEY).agg(first.alias("f"), latest.alias("l"))
    return both.select(
        *KEY,
        F.col("f.pr_title").alias("pr_title"),
        F.col("l.review_run").alias("total_runs"),
        F.col("f.issues_found").alias("initial_issues"),
        F.col("l.issues_found").alias("current_issues"),
        (F.col("f.issues_found") - F.col("l.issues_found")).alias("issues_fixed"),
        F.col("f.review_decision").alias("initial_decision"),
        F.col("l.review_decision").alias("latest_decision"),
        F.col("l.issues_resolved").alias("issues_resolved"),
        F.col("f.created_at").alias("first_reviewed_at"),
        F.col("l.created_at").alias("last_reviewed_at"),
    )


def next_run(reviews: DataFrame) -> DataFrame:
    """Number that the next review of each pull request gets (A1)."""
    return reviews.groupBy(*KEY).agg((F.count(F.lit(1)) + 1).cast("int").alias("next_run"))


def already_reviewed(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """Requests whose commit has no review yet."""
    return requests.join(reviews.select(*KEY, "commit_sha").distinct(), [*KEY, "commit_sha"], "left_anti")


def new_reviews(incoming: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows to append for incoming reviews: run numbers go on from the history, in order of time and id (W10, Wn5).

    ``incoming``: id, repo_id, pr_number, pr_title, commit_sha, review_decision, review_summary, comments_count, processing_ms, created_at.
    """
    before = reviews.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_before"))
    w = Window.partitionBy(*KEY).orderBy("created_at", "id")
    found = issues_found(F.col("review_decision"), F.col("comments_count")).cast("int")
    return (
        incoming.join(before, KEY, "left")
        .withColumn("review_run", (F.coalesce("_before", F.lit(0)) + F.row_number().over(w)).cast("int"))
        .select(
            "id", *KEY, "pr_title", "commit_sha", "review_run", "review_decision", "review_summary", "comments_count",
            found.alias("issues_found"), F.lit(0).alias("issues_resolved"), found.alias("issues_open"), "processing_ms", "created_at",
        )
    )
