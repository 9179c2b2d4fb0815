"""Repositories and runs as tables, the store's documents, search in scopes, posting and the whole review."""

import datetime as dt
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import embedding, index_store, review, run_log, search
from codeloom.operators.diff import parse_diffs
from codeloom.schemas import CODE_CHUNKS, INDEX_RUNS, REPOSITORIES


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def repositories(spark, *rows):
    return spark.createDataFrame([(i, name, "url", "main", None, status, at(1), at(1), active) for i, name, status, active in rows], REPOSITORIES)


def runs(spark, *rows):
    return spark.createDataFrame([(i, r, "sha" + i, branch, status, "m", "1", "1", 0, 0, 0, None, at(day), at(day, 1) if done else None) for i, r, branch, status, day, done in rows], INDEX_RUNS)


def chunk(i, repo, run, path="a.py", h="h", vector=None, kind="function", created=1, line=1):
    return (i, repo, run, path, kind, "f" + i, "", "py", "text " + i, h, line, line + 1, vector, None, at(created))


def test_repositories_are_made_once(spark):
    there = repositories(spark, ("a", "o/a", "indexed", "r1"))
    wanted = spark.createDataFrame([("o/a", "x", "dev", at(2)), ("o/b", "late", "dev", at(3)), ("o/b", "early", "main", at(2)), (None, "x", "y", at(2))], "full_name string, clone_url string, default_branch string, at timestamp")
    after = {r.full_name: r for r in run_log.get_or_create(there, wanted).collect()}
    assert set(after) == {"o/a", "o/b"} and after["o/a"].clone_url == "url" and after["o/b"].clone_url == "early" and after["o/b"].status == "pending"
    assert after["o/b"].id == index_store.IndexStore.repo_id("o/b")
    assert run_log.get_or_create(there, wanted.limit(0)).count() == 1 and run_log.get_or_create(there.limit(0), wanted).count() == 2
    changes = spark.createDataFrame([("a", "failed", at(5)), ("a", "indexing", at(4)), ("z", "failed", at(9))], "id string, status string, at timestamp")
    row = run_log.with_status(there, changes).first()
    assert (row.status, row.updated_at, row.created_at) == ("failed", at(5), at(1))
    assert [r.id for r in run_log.by_name(there.unionByName(repositories(spark, ("b", "o/b", "pending", None))), wanted.select("full_name")).orderBy("id").collect()] == ["a", "b"]


def test_runs_open_and_end(spark):
    asked = spark.createDataFrame([("a", "s", "main", at(1)), ("a", "s", "main", at(1)), ("a", "s", "main", at(2))], "repo_id string, commit_sha string, branch string, at timestamp")
    new = run_log.opened(asked)
    assert new.schema.simpleString() == spark.createDataFrame([], INDEX_RUNS).schema.simpleString()
    assert new.count() == 2 and {r.status for r in new.collect()} == {"running"}
    table = runs(spark, ("1", "a", "main", "running", 1, False), ("2", "a", "main", "running", 2, False), ("3", "a", "main", "completed", 3, True))
    chunks = spark.createDataFrame([chunk("x", "a", "1"), chunk("y", "a", "1"), chunk("z", "a", "3")], CODE_CHUNKS)
    done = {r.id: r for r in run_log.finished(table, chunks, F.lit(at(9))).collect()}
    assert [(done[k].status, done[k].files_processed, done[k].chunks_created) for k in "123"] == [("completed", 1, 2), ("completed", 0, 0), ("completed", 0, 0)]
    assert done["1"].completed_at == at(9) and done["3"].completed_at == at(3, 1)
    errors = spark.createDataFrame([("1", "x" * 3000), ("3", "late"), ("1", "y")], "id string, error string")
    broken = {r.id: r for r in run_log.failed(table, errors, F.lit(at(9))).collect()}
    assert (broken["1"].status, len(broken["1"].error_message), broken["2"].status, broken["3"].status) == ("failed", 2000, "running", "completed")
    repos = repositories(spark, ("a", "o/a", "indexed", "1"), ("b", "o/b", "indexed", "old"))
    assert {(r.id, r.active_index_run_id) for r in run_log.activated(repos, table).collect()} == {("a", "3"), ("b", "old")}
    left, kept = run_log.cascade(chunks, table, repos.where("id = 'b'"))
    assert left.count() == kept.count() == 0
    times = spark.range(1).select(run_log.elapsed_ms(F.lit(at(1)), F.lit(at(1, 1))).alias("a"), run_log.elapsed_ms(F.lit(at(2)), F.lit(at(1))).alias("b"), run_log.short_sha(F.lit("0123456789")).alias("c")).first()
    assert tuple(times) == (3_600_000, None, "01234567")


def test_pointer_is_never_away(spark, tmp_path):
    store = index_store.IndexStore(spark, str(tmp_path / "s"))
    store.set_active_run("r", "run-0")
    seen, stop = [], threading.Event()

    def read():
        reader = index_store.IndexStore(spark, str(tmp_path / "s"))
        while not stop.is_set():
            seen.append(reader.active_run("r"))

    thread = threading.Thread(target=read)
    thread.start()
    for k in range(1, 40):
        store.set_active_run("r", f"run-{k}")
    stop.set()
    thread.join()
    numbers = [int(s.split("-")[1]) for s in seen]
    assert numbers == sorted(numbers) and store.active_run("r") == "run-39"
    (tmp_path / "s" / "repositories" / "r" / "active" / "_new-000000000099").write_text("a writer that broke off")
    assert store.active_run("r") == "run-39"


def test_hot_hashes_and_copies_by_repository(spark):
    rows = [chunk("1", "a", "r1", h="h1", created=1), chunk("2", "a", "r1", h="h1", created=2), chunk("3", "b", "r2", h="h1", created=3), chunk("4", "a", "r1", h="h2")]
    old = spark.createDataFrame(rows, CODE_CHUNKS)
    assert {r.id for r in index_store.existing_by_hash(old).collect()} == {"3", "4"}
    assert {r.id for r in index_store.existing_by_hash(old, ["repo_id"]).collect()} == {"2", "3", "4"}
    new = spark.createDataFrame([chunk("9", "a", "r9", h="h1", line=7), chunk("8", "b", "r9", h="h2")], CODE_CHUNKS)
    carried = index_store.copied(new, old, F.lit("next"), by=["repo_id"]).collect()
    assert [(r.index_run_id, r.name, r.line_start) for r in carried] == [("next", "f2", 1)]
    moved = index_store.copied(new, old, F.lit("next"), True, by=["repo_id"]).first()
    assert moved.line_start == 7
    assert {r.id for r in index_store.to_embed(new, old, ["repo_id"]).collect()} == {"8"} and {r.id for r in index_store.deleted_chunks(new, old, ["repo_id"]).collect()} == {"3", "4"}


def brute(rows, queries, k, least):
    found = {}
    for s, q, v in queries:
        scored = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for t, i, w in rows if t == s)
        found[s, q] = [i for c, i in scored if -c >= least][:k]
    return {key: ids for key, ids in found.items() if ids}


@pytest.mark.parametrize("options", [{}, {"query_block": 3}, {"query_block": 3, "slice_rows": 20}])
def test_search_in_scopes(spark, options):
    rng = np.random.default_rng(7)
    rows = [("ab"[int(k > 15)], f"{k:03}", rng.standard_normal(6).astype(np.float32)) for k in range(90)]
    queries = [("abc"[k % 3], k, rng.standard_normal(6).astype(np.float32)) for k in range(21)]
    chunks = spark.createDataFrame([(s, i, [float(x) for x in v], 1) for s, i, v in rows] + [(None, "n", [0.0] * 6, 1), ("a", "m", None, 1)], "repo string, id string, embedding array<float>, q_idx int")
    asked = spark.createDataFrame([(s, q, [float(x) for x in v]) for s, q, v in queries], "repo string, q_idx int, vector array<float>")
    got = {}
    for r in search.top_k_per_query(chunks, asked, top_k=4, min_score=0.1, scope="repo", **options).orderBy("repo", "q_idx", "rnk").collect():
        got.setdefault((r.repo, r.q_idx), []).append(r.id)
    assert got == brute(rows, queries, 4, 0.1)
    one = search.top_k_per_query(chunks.where("repo is not null"), asked, top_k=4, min_score=0.1, **options)
    assert one.count() == sum(map(len, brute([("x", i, v) for _, i, v in rows], [("x", q, v) for _, q, v in queries], 4, 0.1).values()))
    with pytest.raises(ValueError):
        search.score_pairs(chunks, asked, 0.5, most_queries=3)


DIFF = "diff --git a/src/job.py b/src/job.py\n@@ -1 +1 @@\n+def load_rows(x): TODO\n"


def test_greatest_of_repeated_diffs(spark):
    rows = [("o/a", 1, "c", DIFF), ("o/a", 1, "c", DIFF + "+zeta\n"), ("o/a", 1, "c", None)]
    (f,) = parse_diffs(spark.createDataFrame(rows, "full_name string, pr_number int, commit_sha string, raw_diff string")).collect()
    assert f.additions == 2
    plan = parse_diffs(spark.createDataFrame(rows, "full_name string, pr_number int, commit_sha string, raw_diff string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def posters():
    class Refusing:
        def post(self, body):
            given = json.loads(body)
            return {"bad": 404, "busy": 503}.get(given["commit_id"], 422 if given.get("comments") else 200)

    return Refusing


def test_posting_falls_back_without_comments(spark):
    comment = [("p", 1, "b")]
    rows = [("ok", ("fine", "COMMENT", [])), ("refused", ("fine", "COMMENT", comment)), ("bad", ("fine", "COMMENT", [])), ("busy", ("fine", "COMMENT", comment)), ("none", None)]
    reviews = spark.createDataFrame(rows, "commit_sha string, review struct<body: string, event: string, comments: array<struct<path: string, line: int, body: string>>>")
    got = {r.commit_sha: (r.status, r.dropped_comments, r.post_error) for r in review.post(reviews, posters()()).collect()}
    assert got == {"ok": (200, False, None), "refused": (200, True, None), "bad": (404, False, "permanent"), "busy": (503, False, "transient"), "none": (None, False, None)}


def test_whole_review(spark):
    maker = embedding.HashEmbedder(16)
    vector = maker.embed(["src/job load_rows"])[0]
    chunks = spark.createDataFrame([chunk("1", "a", "r1", vector=vector), chunk("2", "a", "r0", vector=vector), chunk("3", "b", "r2", vector=vector)], CODE_CHUNKS)
    repos = repositories(spark, ("a", "o/a", "indexed", "r1"), ("c", "o/c", "pending", None))
    diffs = spark.createDataFrame([("o/a", 1, "c", "T", DIFF), ("o/c", 2, "c", None, DIFF.replace("TODO", "pass")), ("o/x", 3, "c", "T", "")], "full_name string, pr_number int, commit_sha string, pr_title string, raw_diff string")
    done = {r.pr_number: r for r in review.review_changes(diffs, chunks, repos, maker, review.RuleReviewer(), dimension=16).collect()}
    assert "[1] f1 (function) — a.py:1-2\ntext 1" in done[1].prompt and "text 2" not in done[1].prompt and done[1].review.event == "REQUEST_CHANGES"
    assert "No excerpts" in done[2].prompt and done[2].review.event == "COMMENT" and done[2].error is None
    assert "(no files changed)" in done[3].prompt
    assert review.review_changes(diffs.limit(0), chunks, repos, maker, review.RuleReviewer(), dimension=16).count() == 0
