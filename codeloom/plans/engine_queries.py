"""Registered queries of the engine's own operators over the code-review tables, with SQL for comparison."""

from __future__ import annotations

import io
import json
import tarfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions import text as tx
from codeloom.functions.vector import cosine_similarity, has_dimension, parse_vector
from codeloom.operators import chunking, diff, embedding, index_store, review, reviews, run_log, search, symbols
from codeloom.session import plain_path, shared_folder, table
from codeloom.sources import files
from codeloom.streaming import events as ev

T = table


def _utc(df, *columns):
    """Times as text, so that no comparison depends on a reader's time zone."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def _active(spark, d):
    return search.active_chunks(T(spark, d, "code_chunks"), T(spark, d, "repositories"))


def _vectors(spark, d):
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _every_hundredth(spark, d):
    return T(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q_idx"), F.col("embedding").alias("vector"))


# search


def vector_topk_per_query(spark, d):
    hits = search.top_k_per_query(_vectors(spark, d), _every_hundredth(spark, d), top_k=5, min_score=0.2, exclude_self=True)
    return hits.select("q_idx", "id", F.round("similarity", 6).alias("similarity"), "rnk")


def vector_search_filtered(spark, d):
    hits = search.top_k_per_query(_vectors(spark, d).where("label = 3"), _every_hundredth(spark, d), top_k=5, min_score=0.1, exclude_self=True)
    return hits.select("q_idx", "id", F.round("similarity", 6).alias("similarity"), "rnk")


def vector_multi_query_merge(spark, d):
    hits = search.top_k_per_query(_vectors(spark, d), _every_hundredth(spark, d), top_k=5, min_score=0.2, exclude_self=True)
    return search.merge_hits(hits, 10).select("id", F.round("best_score", 6).alias("best_score"), "position")


def vector_score_pairs(spark, d):
    return search.score_pairs(_vectors(spark, d), _every_hundredth(spark, d), 0.3).select("q_idx", "id", F.round("similarity", 6).alias("similarity"))


def search_context(spark, d):
    """The whole search over code: active runs, merged over all queries, capped."""
    found = search.search(T(spark, d, "code_chunks"), T(spark, d, "repositories"), _every_hundredth(spark, d), language="py", min_score=0.3)
    return found.select("position", "id", "file_path", "name")


def _asked_of_each(spark, d):
    """Every hundredth vector of the first two thousand asked of each repository."""
    asked = T(spark, d, "repositories").select(F.col("id").alias("repo_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1900).cast("long"), F.lit(100).cast("long"))).alias("q_idx"))
    return asked.join(_every_hundredth(spark, d), "q_idx")


def search_by_repository(spark, d):
    """The same with each repository as a scope of its own, functions alone."""
    found = search.search(T(spark, d, "code_chunks"), T(spark, d, "repositories"), _asked_of_each(spark, d), chunk_type="function", min_score=0.2, by_repository=True)
    return found.select("repo_id", "position", "id", "file_path", "name")


def vector_zero_norm(spark, d):
    v = _vectors(spark, d)
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    score = cosine_similarity(F.col("embedding"), zero)
    return v.agg(F.count_if(F.isnan(score)).alias("undefined"), F.count_if(score >= 0.7).alias("passing"), F.count(F.lit(1)).alias("n"))


def vector_dim_check(spark, d):
    c = T(spark, d, "code_chunks")
    return c.groupBy("language").agg(F.count_if(has_dimension(F.col("embedding"), 64)).alias("fitting"), F.count_if(~has_dimension(F.col("embedding"), 64)).alias("unfit"))


def vector_text_decode(spark, d):
    v = _vectors(spark, d)
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.floor(x * 1000).cast("string")), ","), F.lit("]"))
    back = parse_vector(text)
    return v.select("id", F.size(back).alias("n"), F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


_Q = """WITH q AS (SELECT vec_id AS q_idx, embedding::DOUBLE[] AS v FROM embeddings WHERE {which}),
s AS (SELECT q_idx, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS sim FROM q JOIN embeddings e ON e.vec_id <> q_idx {extra}),
r AS (SELECT q_idx, id, sim, row_number() OVER (PARTITION BY q_idx ORDER BY 1 - sim, id) AS rnk FROM s WHERE sim >= {least} QUALIFY rnk <= 5)
"""

# the store


def active_run_lookup(spark, d):
    return _active(spark, d).groupBy("repo_id", "index_run_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"))


def repository_by_name(spark, d):
    names = T(spark, d, "pr_reviews").select("repo_id").distinct().join(T(spark, d, "repositories").withColumnRenamed("id", "repo_id"), "repo_id").where(F.substring("repo_id", 1, 1) < "8").select("full_name")
    asked = names.unionByName(names).unionByName(spark.createDataFrame([("no/such",), (None,)], "full_name string"))
    return run_log.by_name(T(spark, d, "repositories"), asked).select("id", "full_name", "status", "active_index_run_id")


def content_hash_check(spark, d):
    c = T(spark, d, "code_chunks")
    value = tx.content_hash(F.col("content"), F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
    return c.select("id", value.alias("computed"), (value == F.lower("content_hash")).alias("agrees"))


def existing_chunks_by_hash(spark, d):
    return index_store.existing_by_hash(_active(spark, d)).select("content_hash", "id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


def _two_runs(spark, d):
    """Chunks of the current runs and of those before them; the operators compare within a repository."""
    runs = T(spark, d, "index_runs").where(F.col("status").isin("completed", "superseded"))
    chunks = T(spark, d, "code_chunks")
    old = chunks.join(runs.where("status = 'superseded'").select(F.col("id").alias("index_run_id")), "index_run_id", "left_semi")
    new = chunks.join(runs.where("status = 'completed'").select(F.col("id").alias("index_run_id")), "index_run_id", "left_semi")
    return new, old


def incremental_split_copy(spark, d):
    """Every chunk that need not be embedded again, with the row that it takes over."""
    new, old = _two_runs(spark, d)
    found = index_store.reusable(new, old, by=["repo_id"])
    return found.select("repo_id", "content_hash", "file_path", "name", "chunk_type", "line_start", F.size("embedding").alias("dimension"))


def incremental_copy_forward(spark, d):
    """The rows that the next run of each repository gets, under its id and ids of their own."""
    new, old = _two_runs(spark, d)
    rows = index_store.copied(new, old, F.concat(F.lit("next-"), F.col("repo_id")), by=["repo_id"])
    return rows.select("id", "index_run_id", "file_path", "content_hash", "name", "line_start")


def incremental_split_new(spark, d):
    new, old = _two_runs(spark, d)
    return index_store.to_embed(new, old, ["repo_id"]).select("id", "repo_id", "content_hash")


def deleted_chunks(spark, d):
    new, old = _two_runs(spark, d)
    return index_store.deleted_chunks(new, old, ["repo_id"]).select("id", "repo_id", "content_hash")


def idempotent_insert(spark, d):
    c = T(spark, d, "code_chunks")
    runs = T(spark, d, "index_runs")
    there = c.join(runs.where("status = 'superseded'").select(F.col("id").alias("index_run_id")), "index_run_id", "left_semi")
    return index_store.insertable(c, there).select("id", "index_run_id", "file_path", "content_hash")


def supersede_runs(spark, d):
    return index_store.superseded(T(spark, d, "index_runs"), T(spark, d, "repositories")).select("id", "repo_id", "status")


def run_files_processed(spark, d):
    return index_store.run_counts(T(spark, d, "code_chunks"))


def embed_batch_counts(spark, d):
    """Texts that get a vector and texts that get an error; notes without a word have none."""
    texts = T(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(" -- ")).otherwise(F.col("text")).alias("text"))
    return embedding.embed_counts(embedding.embed(texts, "text", embedding.HashEmbedder(64), dimension=64))


def orphan_chunks(spark, d):
    """Chunks whose run is not among the finished ones, and runs whose repository is not indexed."""
    runs, repositories = T(spark, d, "index_runs"), T(spark, d, "repositories").where("status = 'indexed'")
    finished = runs.where(F.col("status").isin("completed", "superseded"))
    chunks = schemas.orphans(T(spark, d, "code_chunks"), finished, "index_run_id").select("id", F.lit("chunk").alias("kind"))
    return chunks.unionByName(schemas.orphans(runs, repositories, "repo_id").select("id", F.lit("run").alias("kind")))


# text


def embedding_text(spark, d):
    return chunking.with_embedding_text(T(spark, d, "code_chunks")).select("id", F.sha2("embedding_text", 256).alias("text_hash"))


def oversize_flag(spark, d):
    n = tx.module_line_count(F.col("content"))
    return T(spark, d, "code_chunks").select("id", n.alias("line_count"), tx.oversized(n).alias("oversized"))


def module_names(spark, d):
    return T(spark, d, "code_chunks").select("file_path").distinct().select("file_path", tx.module_name(F.col("file_path")).alias("module"))


def path_parts(spark, d):
    p = F.col("rel_path")
    return T(spark, d, "source_files").select("index_run_id", "rel_path", tx.suffix(p).alias("suffix"), tx.stem(p).alias("stem"), tx.indexable(p).alias("indexable"))


def noncode_filter(spark, d):
    files = T(spark, d, "source_files").where(~tx.extension(F.col("rel_path")).isin(*tx.NON_CODE_EXTENSIONS))
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def symbol_extract(spark, d):
    """Symbols of whole texts, line by line."""
    return T(spark, d, "documents").select("doc_id", F.array_join(symbols.symbols_of(tx.split_lines(F.col("text"))), " ").alias("symbols"))


def format_context(spark, d):
    """The text that a repository's search gives to the prompt."""
    found = search.search(T(spark, d, "code_chunks"), T(spark, d, "repositories"), _asked_of_each(spark, d), chunk_type="function", min_score=0.2, by_repository=True)
    return search.format_context(found, ("repo_id",)).select("repo_id", F.sha2("context", 256).alias("context_hash"))


# reviews


def reviews_latest(spark, d):
    return _utc(reviews.reviews_latest(T(spark, d, "pr_reviews")), "created_at")


def reviews_first(spark, d):
    return _utc(reviews.reviews_first(T(spark, d, "pr_reviews")), "created_at")


def review_progress(spark, d):
    return _utc(reviews.review_progress(T(spark, d, "pr_reviews")), "first_reviewed_at", "last_reviewed_at")


def review_next_run(spark, d):
    return reviews.next_run(T(spark, d, "pr_reviews"))


def review_append(spark, d):
    r = T(spark, d, "pr_reviews")
    new = reviews.new_reviews(r.where("review_run > 1"), r.where("review_run = 1"))
    return new.select("id", "repo_id", "pr_number", "review_run", "issues_found", "issues_open")


def issues_found(spark, d):
    r = T(spark, d, "pr_reviews")
    return r.select("id", reviews.issues_found(F.col("review_decision"), F.col("comments_count")).alias("issues"))


def already_reviewed_anti(spark, d):
    r = T(spark, d, "pr_reviews")
    return reviews.already_reviewed(r.where("review_run > 1").select("id", "repo_id", "pr_number", "commit_sha"), r.where("review_run = 1")).select("id", "repo_id", "pr_number", "commit_sha")


# diffs


def _diffs(spark, d):
    """Diffs made of the pull-request texts: every document is a file that is added, changed, renamed or removed."""
    doc = F.col("doc_id")
    path = F.concat(F.lit("src/m"), (doc % 7).cast("string"), F.lit("/file_"), doc.cast("string"), F.element_at(F.array(*map(F.lit, (".py", ".ts", ".md"))), (doc % 3 + 1).cast("int")))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"))
    kind = (
        F.when(doc % 5 == 0, F.lit("new file mode 100644\n"))
        .when(doc % 5 == 1, F.lit("deleted file mode 100644\n"))
        .when(doc % 5 == 2, F.concat(F.lit("rename from old/"), path, F.lit("\nrename to "), path, F.lit("\n")))
        .otherwise(F.lit(""))
    )
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, F.lit("+")).when(i % 3 == 1, F.lit("-")).otherwise(F.lit(" ")), x)), "\n")
    hunk = F.concat(F.lit("@@ -1,3 +1,3 @@ head\n"), body, F.lit("\n"))
    raw = F.concat(F.lit("preamble\n"), head, kind, hunk, hunk)
    return T(spark, d, "documents").select(F.concat(F.lit("r"), (doc % 11).cast("string")).alias("full_name"), doc.cast("int").alias("pr_number"), F.lit("c").alias("commit_sha"), raw.alias("raw_diff"))


def diff_files(spark, d):
    files = diff.parse_diffs(_diffs(spark, d))
    hunks = F.array_join(F.transform("hunks", lambda h: F.concat(h["header"], F.lit("\n"), h["content"])), "\n")
    return files.select("full_name", "pr_number", "file_idx", "filename", "old_filename", "status", "additions", "deletions", F.size("hunks").alias("n_hunks"), F.sha2(hunks, 256).alias("hunks_hash"))


def diff_totals(spark, d):
    totals = diff.diff_totals(diff.parse_diffs(_diffs(spark, d)))
    return totals.select("full_name", "pr_number", "total_additions", "total_deletions", F.array_join("changed_filenames", ",").alias("names"))


def diff_queries(spark, d):
    return symbols.file_queries(diff.parse_diffs(_diffs(spark, d))).select("full_name", "pr_number", "query")


def review_prompts(spark, d):
    """Whole prompts, every other one with excerpts."""
    texts = review.diff_text(diff.parse_diffs(_diffs(spark, d)))
    title, context = F.concat(F.lit("change "), F.col("pr_number").cast("string")), F.when(F.col("pr_number") % 2 == 0, F.lit("[1] f (function) — a.py:1-2\ndef f(): pass"))
    return texts.select("full_name", "pr_number", F.sha2(review.prompt(title, F.col("diff_text"), context, F.col("pr_number") % 4 == 0), 256).alias("prompt_hash"))


def review_stub(spark, d):
    files = diff.parse_diffs(_diffs(spark, d))
    asked = review.diff_text(files).withColumn("prompt", review.prompt(F.lit("title"), F.col("diff_text"), F.lit(None).cast("string"), F.lit(False)))
    done = review.analyze(asked, review.RuleReviewer())
    return done.select("full_name", "pr_number", F.col("review.event").alias("event"), "error", review.payload(F.col("commit_sha"), F.col("review")).alias("payload"))


# events


def _events(spark, d):
    e = T(spark, d, "events")
    repo = F.concat(F.lit("org/repo"), (F.col("user_id") % 50).cast("string"))
    kind = F.when(F.col("event_type").isin("view", "click"), "push").when(F.col("event_type").isin("purchase", "signup"), "pull_request").otherwise("ping")
    ref = F.when(F.col("event_id") % 3 == 0, "refs/heads/dev").otherwise("refs/heads/main")
    action = F.element_at(F.array(*map(F.lit, ("opened", "synchronize", "closed"))), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.to_json(
        F.struct(
            ref.alias("ref"), action.alias("action"), F.struct(repo.alias("full_name"), F.lit("main").alias("default_branch")).alias("repository"),
            F.struct((F.col("user_id") % 20).cast("int").alias("number"), F.lit("t").alias("title"), F.struct((F.col("event_id") % 4).cast("string").alias("sha")).alias("head")).alias("pull_request"),
        )
    )
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"), F.lit(None).cast("string").alias("signature"), body.cast("binary").alias("body"))


def events_routing(spark, d):
    return ev.routed(_events(spark, d)).groupBy("kind", "job_id").agg(F.count(F.lit(1)).alias("jobs"), F.min(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("first_ts"))


def events_job_dedup(spark, d):
    return ev.latest_jobs(ev.routed(_events(spark, d)).dropDuplicates(["job_id", "ts"])).select("job_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("last_ts"))


def events_horizon_dedup(spark, d):
    return ev.deduplicated_table(ev.routed(_events(spark, d))).groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"))


def events_tumbling(spark, d):
    e = T(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def events_session(spark, d):
    e = T(spark, d, "events").where("user_id is not null")
    s = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), "n")


def http_error_class(spark, d):
    codes = F.element_at(F.array(*map(F.lit, (200, 401, 404, 422, 429, 500, 503, 504))), (F.col("event_id") % 8 + 1).cast("int"))
    return T(spark, d, "events").select("event_id", codes.alias("status")).select("event_id", review.http_error_class(F.col("status")).alias("kind"))


def events_signatures(spark, d):
    """Bodies signed by the rule for keyed hashes, every third one wrongly or not at all."""
    key = b"a shared secret"
    pad = lambda byte: F.lit(bytearray(x ^ byte for x in key.ljust(64, b"\0")))
    sha = lambda *parts: F.unhex(F.sha2(F.concat(*parts), 256))
    body = F.concat(F.lit("Grüße "), F.col("event_id").cast("string"), F.coalesce("props", F.lit(""))).cast("binary")
    signature = F.concat(F.lit("sha256="), F.lower(F.hex(sha(pad(0x5C), sha(pad(0x36), F.col("body"))))))
    given = F.when(F.col("event_id") % 3 != 0, signature).when(F.col("event_id") % 2 == 0, F.reverse(signature))
    signed = T(spark, d, "events").select("event_id", body.alias("body")).select("event_id", "body", given.alias("signature"))
    return signed.select("event_id", ev.valid_signature(F.col("body"), F.col("signature"), key.decode()).alias("valid"))


def events_stream(spark, d):
    """Events as files in the shared folder, taken in, routed and consumed by a stream in batches of bounded size; reviewed commits are left out."""
    place = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    _events(spark, d).withColumn("body", F.col("body").cast("string")).repartition(12).write.json(f"{place}/in")
    history = lambda s: s.createDataFrame([(f"org/repo{k}", k % 20, "1") for k in range(50)], "full_name string, pr_number int, commit_sha string")
    jobs = ev.routed(ev.read_events(spark, f"{place}/in", max_files=4))
    ev.consume(jobs, history, lambda rows: rows.write.mode("append").parquet(f"{place}/out"), f"{place}/state", delay_s=0).awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("kind", "job_id").agg(F.count(F.lit(1)).alias("jobs"), F.min(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("first_ts"))


# Python on the executors


def _chunked(spark, d):
    named = T(spark, d, "source_files").select(F.concat_ws("/", "index_run_id", "rel_path").alias("rel_path"), "content")
    return chunking.chunk_files(named)


def chunk_files(spark, d):
    found = _chunked(spark, d)
    return found.select("file_path", "chunk_type", "name", "parent_class", "line_start", "line_end", "content_hash", F.to_json("metadata").alias("metadata"))


def chunks_as_indexed(spark, d):
    """Chunks of Python files, and classes and methods of the others, against those that the current runs have on record; files recorded as one module are left out.

    A recorded chunk begins with the comments and decorators above it, so texts are compared from the definition on.
    """
    found = _chunked(spark, d).select(F.substring_index("file_path", "/", 1).alias("index_run_id"), F.expr("substring(file_path, instr(file_path, '/') + 1)").alias("path"), "chunk_type", "name", "parent_class", "language", "content")
    whole = T(spark, d, "code_chunks").where("chunk_type = 'module'").select("index_run_id", plain_path(F.col("file_path")).alias("path")).distinct()
    kept = found.where("chunk_type <> 'module' and (language = 'py' or chunk_type <> 'function')").join(whole, ["index_run_id", "path"], "left_anti")
    body = F.regexp_extract(F.replace("content", F.lit("\r"), F.lit("")), r"(?ms)^[ \t]*((?:async\s+)?(?:def|class)\s.*)", 1)
    return kept.select("index_run_id", "path", "chunk_type", "name", "parent_class", F.when(F.col("language") == "py", F.sha2(body, 256)).alias("body_hash")).distinct()


def chunk_places(spark, d):
    """Per file: chunks, and those whose text stands in the file at the lines they name, whose hash is right and whose size is flagged rightly."""
    found = _chunked(spark, d)
    files = T(spark, d, "source_files").select(F.concat_ws("/", "index_run_id", "rel_path").alias("file_path"), F.col("content").alias("_raw"))
    text = F.coalesce(F.try_validate_utf8(F.col("_raw").cast("string")), F.decode("_raw", "iso-8859-1"))
    lines = F.split(text, "\n", -1)
    at = F.array_join(F.slice(lines, F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    right = at.contains(F.col("content")) & (F.col("content_hash") == F.sha2(F.concat("content", "file_path"), 256))
    flagged = F.col("metadata.oversized") == (F.col("line_end") - F.col("line_start") + 1 > 80)
    counted = found.join(files, "file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(right).alias("in_place"), F.count_if(flagged).alias("flagged"))
    return counted.select("file_path", (F.col("in_place") == F.col("chunks")).alias("all_in_place"), (F.col("flagged") == F.col("chunks")).alias("all_flagged"))


def archive_members(spark, d):
    """Every source file packed into an archive of its own and unpacked again."""

    def pack(batches):
        for batch in batches:
            raws = []
            for path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist()):
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w:gz") as tar:
                    info = tarfile.TarInfo(f"repo-main/{path}")
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                raws.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("index_run_id"), pa.array(raws, pa.binary())], names=["archive", "content"])

    packed = T(spark, d, "source_files").select("index_run_id", "rel_path", "content").mapInArrow(pack, "archive string, content binary")
    return files.expand_archives(packed).select(F.col("archive").alias("index_run_id"), "rel_path", F.sha2("content", 256).alias("content_hash"), "error")


def embed_documents(spark, d):
    """Signs of the vectors' elements, which rounding leaves alone, and the errors of texts without a word."""
    texts = T(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(" -- ")).otherwise(F.col("text")).alias("text"))
    done = embedding.embed(texts, "text", embedding.HashEmbedder(64), dimension=64)
    signs = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * F.signum(x).cast("int")), F.lit(0), lambda a, x: a + x)
    return done.select("doc_id", "embed_error", F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"), signs.alias("signs"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("length"))


def review_posts(spark, d):
    """Reviews sent to a provider that refuses comments of every third pull request and fails for some."""

    class Choosy:
        def post(self, body):
            number = int(json.loads(body)["commit_id"])
            return 422 if number % 3 == 0 and json.loads(body).get("comments") else 503 if number % 7 == 0 else 200

    comment = F.array(F.struct(F.lit("p").alias("path"), F.lit(1).alias("line"), F.lit("b").alias("body")))
    made = F.struct(F.coalesce("review_summary", F.lit("")).alias("body"), F.lit("COMMENT").alias("event"), F.when(F.col("comments_count") > 0, comment).otherwise(F.slice(comment, 1, 0)).alias("comments"))
    reviews_ = T(spark, d, "pr_reviews").select("id", F.col("pr_number").cast("string").alias("commit_sha"), F.when(F.col("review_decision") != "APPROVE", made).alias("review"))
    return review.post(reviews_, Choosy()).select("id", "status", "dropped_comments", "post_error")


def review_whole(spark, d):
    """From raw diffs to answers: queries, search in the repository, prompts, reviews."""
    names = T(spark, d, "repositories").select(F.col("id").alias("repo_id"), F.col("full_name").alias("_name"))
    asked = _diffs(spark, d).join(T(spark, d, "documents").select(F.col("doc_id").cast("int").alias("pr_number"), "repo_id"), "pr_number").join(names, "repo_id").drop("full_name", "repo_id").withColumnRenamed("_name", "full_name")
    done = review.review_changes(asked.withColumn("pr_title", F.lit("t")), T(spark, d, "code_chunks"), T(spark, d, "repositories"), embedding.HashEmbedder(64), review.RuleReviewer(), dimension=64, min_score=-1.0)
    return done.select("full_name", "pr_number", F.col("review.event").alias("event"), F.col("prompt").contains("## Codebase Context\nThese").alias("with_excerpts"), "error")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_per_query, vector_search_filtered, vector_multi_query_merge, vector_score_pairs, search_context, vector_zero_norm, vector_dim_check, vector_text_decode,
        active_run_lookup, repository_by_name, content_hash_check, existing_chunks_by_hash, incremental_split_copy, incremental_split_new, deleted_chunks, idempotent_insert,
        supersede_runs, run_files_processed, embed_batch_counts, orphan_chunks, embedding_text, oversize_flag, module_names, path_parts, noncode_filter, symbol_extract, format_context,
        reviews_latest, reviews_first, review_progress, review_next_run, review_append, issues_found, already_reviewed_anti,
        diff_files, diff_totals, diff_queries, review_prompts, review_stub, events_routing, events_job_dedup, events_horizon_dedup, events_tumbling, events_session, http_error_class,
        events_signatures, events_stream, chunk_files, chunks_as_indexed, chunk_places, archive_members, embed_documents, review_posts, review_whole, search_by_repository, incremental_copy_forward,
    )
}

_ACTIVE = "SELECT c.* FROM code_chunks c WHERE c.index_run_id IN (SELECT active_index_run_id FROM repositories WHERE active_index_run_id IS NOT NULL)"
_OLD_NEW = """WITH o AS (SELECT c.* FROM code_chunks c JOIN index_runs r ON r.id = c.index_run_id AND r.status = 'superseded'),
n AS (SELECT c.* FROM code_chunks c JOIN index_runs r ON r.id = c.index_run_id AND r.status = 'completed'),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY repo_id, content_hash ORDER BY created_at DESC, id DESC) = 1)
"""
# Line breaks and white space of the expressions, in the notation of RE2.
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ID = r"[a-zA-Z_][\p{L}\p{N}_]*"


def _symbols_sql(lines: str) -> str:
    """List of symbols of a list of lines."""
    function, class_ = rf"regexp_extract(x, '^(?:async{_BLANK}+)?def{_BLANK}+({_ID})', 1)", rf"regexp_extract(x, '^class{_BLANK}+({_ID})', 1)"
    tokens = f"list_filter(regexp_extract_all(x, '{_ID}'), lambda t: regexp_matches(t, '^[A-Z][a-zA-Z0-9]+') OR (contains(t, '_') AND length(t) > 5))"
    found = f"flatten(list_transform({lines}, lambda x: CASE WHEN {function} <> '' THEN [{function}] WHEN {class_} <> '' THEN [{class_}] ELSE {tokens} END))"
    noise = ", ".join(f"'{w}'" for w in symbols.NOISE)
    kept = f"list_filter({found}, lambda t: length(t) > 3 AND t NOT IN ({noise}))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


_RUNS = "SELECT c.* FROM code_chunks c JOIN index_runs r ON r.id = c.index_run_id AND r.status = '{}'"


def _text(value: str) -> str:
    """A literal of SQL."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_LATEST = "SELECT * FROM pr_reviews QUALIFY row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY created_at DESC, id DESC) = 1"
_FIRST = "SELECT * FROM pr_reviews QUALIFY row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY created_at, id) = 1"
_UTC = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')"
_DOCS = rf"""WITH b AS (
  SELECT doc_id, 'src/m' || (doc_id % 7) || '/file_' || doc_id || ['.py', '.ts', '.md'][doc_id % 3 + 1] AS path, doc_id % 5 AS k,
         array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || x), chr(10)) AS body
  FROM documents
), d AS (
  SELECT doc_id, path, k, string_split_regex(body, '{_BREAK}') AS lines FROM b
), f AS (
  SELECT 'r' || (doc_id % 11) AS full_name, doc_id::INT AS pr_number, doc_id, path, lines, CASE WHEN k = 2 THEN 'old/' || path ELSE '' END AS old_filename,
         CASE k WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status,
         '@@ -1,3 +1,3 @@ head' || chr(10) || array_to_string(lines, chr(10)) || chr(10) AS hunk,
         (2 * len(list_filter(lines, lambda x: x[1] = '+' AND x[1:3] <> '+++')))::INT AS additions, (2 * len(list_filter(lines, lambda x: x[1] = '-' AND x[1:3] <> '---')))::INT AS deletions
  FROM d
), t AS (
  SELECT *, '### ' || path || ' [' || status || '] +' || additions || ' -' || deletions || CASE WHEN old_filename <> '' THEN ' (renamed from ' || old_filename || ')' ELSE '' END
         || chr(10) || hunk || chr(10) || hunk AS diff_text FROM f
)
"""
_JOBS = """WITH e AS (
  SELECT ts, 'org/repo' || (user_id % 50) AS repo, CASE WHEN event_type IN ('view', 'click') THEN 'push' WHEN event_type IN ('purchase', 'signup') THEN 'pull_request' ELSE 'ping' END AS kind, event_id, user_id
  FROM events
), j AS (
  SELECT 'ingest' AS kind, 'ingest:' || repo || ':main' AS job_id, ts FROM e WHERE kind = 'push' AND event_id % 3 <> 0
  UNION ALL
  SELECT 'review', 'review:' || repo || ':' || (user_id % 20) || ':' || (event_id % 4), ts FROM e WHERE kind = 'pull_request' AND event_id % 3 IN (0, 1)
)
"""

_EACH = """WITH q AS (SELECT vec_id AS q_idx, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0 AND vec_id < 2000),
 c AS (SELECT * FROM ({active}) WHERE chunk_type = 'function' AND len(embedding) = 64),
 s AS (SELECT q_idx, repo_id, id, list_cosine_similarity(c.embedding::DOUBLE[], q.v) AS sim FROM q CROSS JOIN c),
 r AS (SELECT q_idx, repo_id, id, sim, row_number() OVER (PARTITION BY repo_id, q_idx ORDER BY CASE WHEN isnan(sim) THEN 'infinity'::DOUBLE ELSE 1 - sim END, id) AS rnk FROM s WHERE sim >= 0.2 OR isnan(sim) QUALIFY rnk <= 5),
 b AS (SELECT repo_id, id, max(CASE WHEN isnan(sim) THEN '-infinity'::DOUBLE ELSE sim END) AS best, min(q_idx * 1000 + rnk) AS arrival FROM r GROUP BY 1, 2),
 p AS (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY best DESC, arrival)::INT AS position FROM b QUALIFY position <= 10)
""".format(active=_ACTIVE)

ORACLE = {
    "vector_topk_per_query": _Q.format(which="vec_id % 100 = 0", extra="", least=0.2) + "SELECT q_idx, id, round(sim, 6) AS similarity, rnk FROM r",
    "vector_search_filtered": _Q.format(which="vec_id % 100 = 0", extra="AND e.label = 3", least=0.1) + "SELECT q_idx, id, round(sim, 6) AS similarity, rnk FROM r",
    "vector_multi_query_merge": _Q.format(which="vec_id % 100 = 0", extra="", least=0.2)
    + ", b AS (SELECT id, max(sim) AS best, min(q_idx * 1000 + rnk) AS arrival FROM r GROUP BY id)"
    + " SELECT id, round(best, 6) AS best_score, row_number() OVER (ORDER BY best DESC, arrival) AS position FROM b QUALIFY position <= 10",
    "search_context": f"""WITH q AS (SELECT vec_id AS q_idx, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT * FROM ({_ACTIVE}) WHERE language = 'py' AND len(embedding) = 64),
 s AS (SELECT q_idx, id, list_cosine_similarity(c.embedding::DOUBLE[], q.v) AS sim FROM q CROSS JOIN c),
 r AS (SELECT q_idx, id, sim, row_number() OVER (PARTITION BY q_idx ORDER BY 1 - sim, id) AS rnk FROM s WHERE sim >= 0.3 QUALIFY rnk <= 5),
 b AS (SELECT id, max(CASE WHEN isnan(sim) THEN '-infinity'::DOUBLE ELSE sim END) AS best, min(q_idx * 1000 + rnk) AS arrival FROM r GROUP BY id),
 p AS (SELECT id, row_number() OVER (ORDER BY best DESC, arrival) AS position FROM b QUALIFY position <= 10)
 SELECT position::INT AS position, p.id, c.file_path, c.name FROM p JOIN c USING (id)""",
    "vector_score_pairs": "SELECT q.vec_id AS q_idx, e.vec_id AS id, round(least(1.0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity"
    " FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3",
    "vector_zero_norm": "SELECT count(*) AS undefined, count(*) AS passing, count(*) AS n FROM embeddings",
    "vector_dim_check": "SELECT language, count(*) FILTER (WHERE coalesce(len(embedding) = 64, false)) AS fitting, count(*) FILTER (WHERE NOT coalesce(len(embedding) = 64, false)) AS unfit FROM code_chunks GROUP BY 1",
    "vector_text_decode": "SELECT vec_id AS id, len(embedding)::INT AS n, list_sum(list_transform(embedding, lambda x: floor(x * 1000::FLOAT)::BIGINT))::BIGINT AS total FROM embeddings",
    "active_run_lookup": f"SELECT repo_id, index_run_id, count(*) AS chunks, count(DISTINCT file_path) AS files FROM ({_ACTIVE}) GROUP BY 1, 2",
    "repository_by_name": "SELECT id, full_name, status, active_index_run_id FROM repositories WHERE id IN (SELECT repo_id FROM pr_reviews) AND id < '8'",
    "content_hash_check": r"""SELECT id, sha256(content || regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '')) AS computed, computed = lower(content_hash) AS agrees FROM code_chunks""",
    "existing_chunks_by_hash": f"SELECT content_hash, id, {_UTC.format('created_at')} AS created_at FROM (SELECT *, created_at AS made FROM ({_ACTIVE})) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY made DESC, id DESC) = 1",
    "incremental_split_copy": _OLD_NEW + "SELECT n.repo_id, n.content_hash, l.file_path, l.name, l.chunk_type, l.line_start, len(l.embedding)::INT AS dimension FROM n JOIN l USING (repo_id, content_hash)",
    "incremental_split_new": _OLD_NEW + "SELECT id, repo_id, content_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo_id = n.repo_id AND o.content_hash = n.content_hash)",
    "deleted_chunks": _OLD_NEW + "SELECT id, repo_id, content_hash FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.repo_id = n.repo_id AND o.content_hash = n.content_hash)",
    "idempotent_insert": "SELECT c.id, c.index_run_id, c.file_path, c.content_hash FROM code_chunks c WHERE c.index_run_id NOT IN (SELECT id FROM index_runs WHERE status = 'superseded')"
    " QUALIFY row_number() OVER (PARTITION BY index_run_id, file_path, content_hash ORDER BY line_start NULLS FIRST, name, c.id) = 1",
    "supersede_runs": "SELECT r.id, r.repo_id, CASE WHEN r.status = 'completed' AND p.active_index_run_id IS NOT NULL AND r.id <> p.active_index_run_id THEN 'superseded' ELSE r.status END AS status"
    " FROM index_runs r LEFT JOIN repositories p ON p.id = r.repo_id",
    "run_files_processed": "SELECT index_run_id, count(DISTINCT file_path) AS files_processed, count(*) AS chunks_created FROM code_chunks GROUP BY 1",
    "embed_batch_counts": "SELECT count(*) FILTER (doc_id % 9 <> 0 AND regexp_matches(text, '[A-Za-z0-9_]')) AS embedded, count(*) FILTER (doc_id % 9 = 0 OR NOT regexp_matches(text, '[A-Za-z0-9_]')) AS failed FROM documents",
    "orphan_chunks": "SELECT id, 'chunk' AS kind FROM code_chunks WHERE index_run_id NOT IN (SELECT id FROM index_runs WHERE status IN ('completed', 'superseded'))"
    " UNION ALL SELECT id, 'run' FROM index_runs WHERE repo_id NOT IN (SELECT id FROM repositories WHERE status = 'indexed')",
    "embedding_text": """SELECT id, sha256('file: ' || file_path || chr(10) || 'type: ' || chunk_type || chr(10) || 'name: ' || name
 || CASE WHEN parent_class <> '' THEN chr(10) || 'class: ' || parent_class ELSE '' END
 || CASE WHEN metadata.docstring <> '' THEN chr(10) || 'description: ' || metadata.docstring ELSE '' END
 || CASE WHEN len(metadata.calls) > 0 THEN chr(10) || 'calls: ' || array_to_string(metadata.calls[1:10], ', ') ELSE '' END || chr(10) || chr(10) || content) AS text_hash FROM code_chunks""",
    "oversize_flag": "SELECT id, len(string_split(content, chr(10)))::INT AS line_count, len(string_split(content, chr(10))) > 80 AS oversized FROM code_chunks",
    "module_names": r"""SELECT DISTINCT file_path, regexp_replace(array_to_string(string_split(replace(file_path, '\', '/'), '/')[-2:], '/'), '\.[^/]+$', '') AS module FROM code_chunks""",
    "path_parts": r"""SELECT index_run_id, rel_path, regexp_extract(string_split(rel_path, '/')[-1], '^.+(\.[^.]+)$', 1) AS suffix, regexp_extract(string_split(rel_path, '/')[-1], '^(.+?)(\.[^.]+)?$', 1) AS stem,
 NOT list_has_any(string_split(rel_path, '/'), ['.git', '.github', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build', '.next', 'coverage', '.pytest_cache', 'migrations'])
 AND regexp_matches(rel_path, '\.(py|js|ts|tsx|jsx)$') AS indexable FROM source_files""",
    "noncode_filter": "SELECT language, count(*) AS files FROM source_files GROUP BY 1",
    "symbol_extract": f"SELECT doc_id, array_to_string({_symbols_sql(f"string_split_regex(text, '{_BREAK}')")}, ' ') AS symbols FROM documents",
    "format_context": _EACH + """SELECT p.repo_id, sha256(string_agg('[' || position || '] ' || CASE WHEN parent_class <> '' THEN parent_class || '.' ELSE '' END || name || ' (' || chunk_type || ') — ' || file_path || ':' || coalesce(line_start::VARCHAR, 'None') || '-' || coalesce(line_end::VARCHAR, 'None')
 || chr(10) || content, chr(10) || chr(10) ORDER BY position)) AS context_hash FROM p JOIN c ON c.repo_id = p.repo_id AND c.id = p.id GROUP BY 1""",
    "reviews_latest": f"SELECT * REPLACE ({_UTC.format('created_at')} AS created_at) FROM ({_LATEST})",
    "reviews_first": f"SELECT * REPLACE ({_UTC.format('created_at')} AS created_at) FROM ({_FIRST})",
    "review_progress": f"""SELECT f.repo_id, f.pr_number, f.pr_title, l.review_run AS total_runs, f.issues_found AS initial_issues, l.issues_found AS current_issues, f.issues_found - l.issues_found AS issues_fixed,
 f.review_decision AS initial_decision, l.review_decision AS latest_decision, l.issues_resolved, {_UTC.format('f.created_at')} AS first_reviewed_at, {_UTC.format('l.created_at')} AS last_reviewed_at
 FROM ({_FIRST}) f JOIN ({_LATEST}) l ON f.repo_id = l.repo_id AND f.pr_number = l.pr_number""",
    "review_next_run": "SELECT repo_id, pr_number, (count(*) + 1)::INT AS next_run FROM pr_reviews GROUP BY 1, 2",
    "review_append": """WITH b AS (SELECT repo_id, pr_number, count(*) AS n FROM pr_reviews WHERE review_run = 1 GROUP BY 1, 2), i AS (SELECT * FROM pr_reviews WHERE review_run > 1)
 SELECT i.id, i.repo_id, i.pr_number, (coalesce(b.n, 0) + row_number() OVER (PARTITION BY i.repo_id, i.pr_number ORDER BY created_at, id))::INT AS review_run,
 CASE WHEN review_decision = 'REQUEST_CHANGES' THEN comments_count ELSE 0 END AS issues_found, CASE WHEN review_decision = 'REQUEST_CHANGES' THEN comments_count ELSE 0 END AS issues_open
 FROM i LEFT JOIN b USING (repo_id, pr_number)""",
    "issues_found": "SELECT id, CASE WHEN review_decision = 'REQUEST_CHANGES' THEN comments_count ELSE 0 END AS issues FROM pr_reviews",
    "already_reviewed_anti": "SELECT id, repo_id, pr_number, commit_sha FROM pr_reviews q WHERE review_run > 1 AND NOT EXISTS (SELECT 1 FROM pr_reviews r WHERE r.review_run = 1 AND r.repo_id = q.repo_id AND r.pr_number = q.pr_number AND r.commit_sha = q.commit_sha)",
    "diff_files": _DOCS + "SELECT full_name, pr_number, 0 AS file_idx, path AS filename, old_filename, status, additions, deletions, 2 AS n_hunks, sha256(hunk || chr(10) || hunk) AS hunks_hash FROM f",
    "diff_totals": _DOCS + "SELECT full_name, pr_number, additions::BIGINT AS total_additions, deletions::BIGINT AS total_deletions, path AS names FROM f",
    "events_routing": _JOBS + "SELECT kind, job_id, count(*) AS jobs, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first_ts FROM j GROUP BY 1, 2",
    "events_job_dedup": _JOBS + "SELECT job_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_ts FROM j GROUP BY 1",
    "events_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS gap FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "http_error_class": "SELECT event_id, [NULL, 'permanent', 'permanent', 'permanent', 'transient', 'permanent', 'transient', 'transient'][event_id % 8 + 1] AS kind FROM events",
    "search_by_repository": _EACH + "SELECT p.repo_id, position, p.id, c.file_path, c.name FROM p JOIN c ON c.repo_id = p.repo_id AND c.id = p.id",
    "incremental_copy_forward": _OLD_NEW
    + """, k AS (SELECT DISTINCT 'next-' || n.repo_id AS index_run_id, l.file_path, n.content_hash, l.name, l.line_start FROM n JOIN l USING (repo_id, content_hash))
 SELECT substr(sha256(index_run_id || chr(31) || file_path || chr(31) || content_hash), 1, 32) AS id, index_run_id, file_path, content_hash, name, line_start FROM k""",
    "diff_queries": _DOCS
    + f""", c AS (SELECT full_name, pr_number, regexp_replace(path, '^src/(.*)[.][a-z]+$', '\\1') AS module,
 {_symbols_sql(f"list_transform(list_filter(lines, lambda x: x[1] IN ('+', '-')), lambda x: regexp_replace(regexp_replace(x[2:], '^{_BLANK}+', ''), '{_BLANK}+$', ''))")} AS l FROM f WHERE status <> 'removed' AND path NOT LIKE '%.md')
 SELECT full_name, pr_number, module || CASE WHEN len(l) > 0 THEN ' ' || array_to_string(l[1:8], ' ') ELSE '' END AS query FROM c""",
    "review_prompts": _DOCS
    + f"""SELECT full_name, pr_number, sha256('# change ' || pr_number || chr(10) || chr(10) || CASE WHEN pr_number % 2 = 0 AND pr_number % 4 <> 0
 THEN {_text(review.WITH_CONTEXT)} || '[1] f (function) — a.py:1-2' || chr(10) || 'def f(): pass' ELSE {_text(review.WITHOUT_CONTEXT)} END || chr(10) || chr(10) || '## Changes' || chr(10) || diff_text) AS prompt_hash FROM t""",
    "review_stub": _DOCS
    + """, m AS (SELECT full_name, pr_number, 2 * len(list_filter(lines, lambda x: x[1] = '+' AND (contains(x, 'TODO') OR contains(x, 'FIXME')))) AS n FROM t)
 SELECT full_name, pr_number, CASE WHEN n > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event, NULL::VARCHAR AS error,
 '{"commit_id":"c","body":"' || n || ' added lines hold markers of unfinished work.","event":"' || CASE WHEN n > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END || '"}' AS payload FROM m""",
    "events_horizon_dedup": _JOBS.replace("WITH e", "WITH RECURSIVE e")
    + """, kept AS (SELECT job_id, min(ts) AS ts FROM j GROUP BY 1 UNION ALL
 SELECT kept.job_id, min(j.ts) FROM kept JOIN j ON j.job_id = kept.job_id AND j.ts > kept.ts + INTERVAL 1 HOUR GROUP BY kept.job_id, kept.ts)
 SELECT job_id, count(*) AS kept FROM kept GROUP BY 1""",
    "events_signatures": "SELECT event_id, event_id % 3 <> 0 AS valid FROM events",
    "events_stream": _JOBS
    + """SELECT kind, job_id, count(*) AS jobs, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first_ts FROM j
 WHERE NOT regexp_matches(job_id, '^review:org/repo') OR NOT (split_part(job_id, ':', 4) = '1' AND split_part(job_id, ':', 3)::INT = replace(split_part(job_id, ':', 2), 'org/repo', '')::INT % 20) GROUP BY 1, 2""",
    "chunks_as_indexed": r"""WITH c AS (SELECT index_run_id, regexp_replace(replace(file_path, chr(92), '/'), '^(\./)+', '') AS path, chunk_type, name, parent_class, language, content
 FROM code_chunks WHERE index_run_id IN (SELECT id FROM index_runs WHERE status = 'completed'))
 SELECT DISTINCT index_run_id, path, chunk_type, name, parent_class,
 CASE WHEN language = 'py' THEN sha256(regexp_extract(replace(content, chr(13), ''), '(?ms)^[ \t]*((?:async\s+)?(?:def|class)\s.*)', 1)) END AS body_hash
 FROM c WHERE chunk_type <> 'module' AND (language = 'py' OR chunk_type <> 'function')
 AND NOT EXISTS (SELECT 1 FROM c m WHERE m.chunk_type = 'module' AND m.index_run_id = c.index_run_id AND m.path = c.path)""",
    "chunk_places": r"""SELECT index_run_id || '/' || rel_path AS file_path, true AS all_in_place, true AS all_flagged FROM source_files
 WHERE NOT list_has_any(string_split(rel_path, '/'), ['.git', '.github', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build', '.next', 'coverage', '.pytest_cache', 'migrations'])
 AND regexp_matches(rel_path, '\.(py|js|ts|tsx|jsx)$') AND regexp_matches(hex(content), '^(?:..)*?(?:0[0-8EF]|1[0-9ABDEF]|[2-9A-F].)')""",
    "archive_members": "SELECT index_run_id, rel_path, sha256(content) AS content_hash, NULL::VARCHAR AS error FROM source_files",
    "embed_documents": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents WHERE doc_id % 9 <> 0),
 h AS (SELECT doc_id, ('0x' || substr(md5(lower(w)), 1, 7))::BIGINT % 64 + 1 AS i, CASE WHEN substr(md5(lower(w)), 32, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END AS n FROM w),
 v AS (SELECT doc_id, i, sum(n) AS n FROM h GROUP BY 1, 2),
 g AS (SELECT doc_id, count(*) FILTER (n > 0) AS positive, sum(i * sign(n))::INT AS signs, max(abs(n)) AS most FROM v GROUP BY 1)
 SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN 'ValueError: empty text' END AS embed_error, positive::INT AS positive, signs,
 CASE WHEN most > 0 THEN 1.0 WHEN most = 0 THEN 0.0 END::DOUBLE AS length FROM documents d LEFT JOIN g USING (doc_id)""",
    "review_posts": """WITH r AS (SELECT id, review_decision <> 'APPROVE' AS has, comments_count > 0 AND pr_number % 3 = 0 AND review_decision <> 'APPROVE' AS refused, pr_number FROM pr_reviews)
 SELECT id, CASE WHEN has THEN CASE WHEN pr_number % 7 = 0 THEN 503 ELSE 200 END END::INT AS status, refused AS dropped_comments, CASE WHEN has AND pr_number % 7 = 0 THEN 'transient' END AS post_error FROM r""",
    "review_whole": _DOCS
    + f""", a AS (SELECT DISTINCT repo_id FROM ({_ACTIVE}) WHERE len(embedding) = 64)
 SELECT p.full_name, f.pr_number, CASE WHEN len(list_filter(lines, lambda x: x[1] = '+' AND (contains(x, 'TODO') OR contains(x, 'FIXME')))) > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event,
 f.status <> 'removed' AND path NOT LIKE '%.md' AND p.id IN (FROM a) AS with_excerpts, NULL::VARCHAR AS error
 FROM f JOIN documents d ON d.doc_id = f.doc_id JOIN repositories p ON p.id = d.repo_id""",
}
