import datetime as dt
import hashlib
import io
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from codeloom.conf import EngineConf
from codeloom.functions import text as tx
from codeloom.functions.chunker import chunk_source
from codeloom.functions.vector import cosine_similarity, parse_vector
from codeloom.operators import chunking, embedding, index_store, review, reviews, search, symbols
from codeloom.operators.diff import diff_totals, parse_diffs
from codeloom.schemas import CODE_CHUNKS, INDEX_RUNS, PR_REVIEWS, REPOSITORIES, checked, orphans
from codeloom.sources.files import expand_archives, scan_tree, unsafe_member

MODIFIED = "diff --git a/src/test.py b/src/test.py\nindex 1..2 100644\n--- a/src/test.py\n+++ b/src/test.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n"
ADDED = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+def validate_token(x):\n+    return AuthService(x)\n"
REMOVED = "diff --git a/o.py b/o.py\ndeleted file mode 100644\n@@ -1,2 +0,0 @@\n-x\n-y\n"
RENAMED = "diff --git a/old.py b/new.py\nsimilarity index 90%\nrename from old.py\nrename to new.py\n@@ -1 +1 @@\n-a\n+b\n"
TWO_HUNKS = "diff --git a/t.py b/t.py\n@@ -1,2 +1,3 @@ def f\n a\n+b\n+c\n@@ -9,3 +10,2 @@\n-d\n-e\n+f\n"


def diffs(spark, *texts):
    rows = [("o/r", i, "sha", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "full_name string, pr_number int, commit_sha string, raw_diff string")


def files_of(spark, text):
    return parse_diffs(diffs(spark, text)).orderBy("file_idx").collect()


@pytest.mark.parametrize(
    ("text", "name", "status", "plus", "minus", "hunks", "old"),
    [
        (MODIFIED, "src/test.py", "modified", 1, 1, 1, ""),
        (ADDED, "n.py", "added", 2, 0, 1, ""),
        (REMOVED, "o.py", "removed", 0, 2, 1, ""),
        (RENAMED, "new.py", "renamed", 1, 1, 1, "old.py"),
        (TWO_HUNKS, "t.py", "modified", 3, 2, 2, ""),
        ("diff --git a/b.png b/b.png\nBinary files differ\n", "b.png", "modified", 0, 0, 0, ""),
        ("diff --git a/a b/b c b/b c\n@@ -1 +1 @@\n+x\n", "b c", "modified", 1, 0, 1, ""),
        (MODIFIED.replace("\n", "\r\n"), "src/test.py", "modified", 1, 1, 1, ""),
    ],
)
def test_one_file(spark, text, name, status, plus, minus, hunks, old):
    (f,) = files_of(spark, text)
    assert (f.filename, f.status, f.additions, f.deletions, len(f.hunks), f.old_filename) == (name, status, plus, minus, hunks, old)


def test_diff_cases(spark):
    assert [files_of(spark, t) for t in ("", "  \n ", "no header\n@@ -1 +1 @@\n+x\n")] == [[], [], []]
    assert parse_diffs(diffs(spark, None)).count() == 0
    both = files_of(spark, "preamble\n" + MODIFIED + ADDED)
    assert [(f.file_idx, f.filename) for f in both] == [(0, "src/test.py"), (1, "n.py")]
    assert both[0].hunks[0].header == "@@ -1,3 +1,3 @@" and both[0].hunks[0].content == " a\n-b\n+c\n"
    (plus,) = files_of(spark, "diff --git a/p b/p\n@@ -1 +1 @@\n+++x\n+y\n---z\n")
    assert (plus.additions, plus.deletions, plus.hunks[0].content) == (1, 0, "+++x\n+y\n---z\n")
    (form,) = files_of(spark, "diff --git a/p b/p\n@@ -1 +1 @@\n+a\x0cb\n")
    assert form.hunks[0].content == "+a\nb\n"
    total = diff_totals(parse_diffs(diffs(spark, MODIFIED + ADDED))).first()
    assert (total.total_additions, total.total_deletions, total.changed_filenames) == (3, 1, ["n.py", "src/test.py"])


def query_of(spark, text):
    return [r.query for r in symbols.file_queries(parse_diffs(diffs(spark, text))).collect()]


def test_queries_from_diffs(spark):
    assert query_of(spark, ADDED) == ["n validate_token AuthService"]
    assert query_of(spark, REMOVED) == []
    assert query_of(spark, ADDED.replace("n.py", "n.md")) == []
    assert query_of(spark, "diff --git a/Makefile b/Makefile\n@@ -1 +1 @@\n+all_targets: x\n") == ["Makefile all_targets"]
    assert query_of(spark, "diff --git a/src/a/foo.test.js b/src/a/foo.test.js\n@@ -1 +1 @@\n x\n+1\n") == ["a/foo"]
    many = "".join(f"+name_number_{k}\n" for k in range(12))
    assert query_of(spark, f"diff --git a/a/b.py b/a/b.py\n@@ -1 +1 @@\n{many}")[0].split() == ["a/b", *[f"name_number_{k}" for k in range(8)]]
    lines = "+def len(Foo): pass\n+async def run_it(): Bar\n+class Widget(Base):\n+camelCase = None; snake_ = Thing2; abc_def\n"
    assert query_of(spark, f"diff --git a/x.py b/x.py\n@@ -1 +1 @@\n context_line_name\n{lines}") == ["x run_it Widget snake_ Thing2 abc_def"]


def test_search_order_ties_and_undefined_scores(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 0.0]), ("d", [1.0, 0.0]), ("e", None), ("f", [1.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "q_idx int, vector array<float>")
    hits = search.top_k_per_query(chunks, queries, top_k=3, min_score=0.5)
    assert [(r.q_idx, r.id) for r in hits.orderBy("q_idx", "rnk").collect()] == [(0, "a"), (0, "d"), (0, "b"), (1, "c")]
    assert search.top_k_per_query(chunks, queries.limit(0)).count() == 0
    pairs = search.score_pairs(chunks, queries, 0.5).collect()
    assert {(r.q_idx, r.id) for r in pairs} == {(0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "c")}
    small = search.top_k_per_query(chunks, queries, top_k=3, min_score=0.5, query_block=1)
    assert sorted(map(tuple, hits.select("q_idx", "id", "rnk").collect())) == sorted(map(tuple, small.select("q_idx", "id", "rnk").collect()))


def test_merge_and_cap(spark):
    rows = [(0, 1, "x", 0.72), (1, 1, "x", 0.95), (0, 2, "y", 0.80), (1, 2, "z", float("nan")), (0, 3, "w", 0.80)]
    hits = spark.createDataFrame(rows, "q_idx int, rnk int, id string, similarity double")
    merged = search.merge_hits(hits, 10).orderBy("position").collect()
    assert [r.id for r in merged] == ["x", "y", "w", "z"] and merged[0].best_score == 0.95 and math.isnan(merged[3].best_score)
    assert [r.id for r in search.merge_hits(hits, 2).orderBy("position").collect()] == ["x", "y"]
    assert search.merge_hits(hits.limit(0)).count() == 0


def test_context_format(spark):
    fields = "position int, id string, file_path string, chunk_type string, name string, parent_class string, content string, line_start int, line_end int"
    rows = [(2, "b", "s.py", "method", "run", "Job", "two", 3, 4), (1, "a", "src/auth.py", "function", "validate_token", "", "one", 1, 10)]
    text = search.format_context(spark.createDataFrame(rows, fields)).first().context
    assert text == "[1] validate_token (function) — src/auth.py:1-10\none\n\n[2] Job.run (method) — s.py:3-4\ntwo"
    assert search.format_context(spark.createDataFrame([], fields)).first().context == ""


def test_vector_expressions(spark):
    row = spark.range(1).select(
        cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("zero"), cosine_similarity(F.array(F.lit(2.0)), F.array(F.lit(3.0))).alias("one"),
        cosine_similarity(F.lit(None).cast("array<double>"), F.array(F.lit(3.0))).alias("null"), parse_vector(F.lit("[1, 2.5,-3]")).alias("v"), parse_vector(F.lit("[]")).alias("e"),
    ).first()
    assert math.isnan(row.zero) and row.one == 1.0 and row.null is None and row.v == [1.0, 2.5, -3.0] and row.e == []


SPLIT = ["", "\n", "a", "a\n", "a\r\nb", "a\x0cb\x1cc\x85d e\n\n", "\r\n\r\n", "x\x0by"]


def test_text_expressions(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(SPLIT)], "i int, s string")
    got = {r.i: r.l for r in frame.select("i", tx.split_lines(F.col("s")).alias("l")).collect()}
    assert [got[i] for i in range(len(SPLIT))] == [s.splitlines() for s in SPLIT]
    paths = spark.createDataFrame([("src/a/foo.test.js",), ("node_modules/x/index.js",), ("a/.env",), ("Makefile",), ("x/y.PY",), ("w\\v.py",)], "p string")
    p = F.col("p")
    rows = paths.select("p", tx.module_name(p).alias("m"), tx.suffix(p).alias("s"), tx.stem(p).alias("t"), tx.indexable(p).alias("i")).collect()
    assert [(r.m, r.s, r.t, r.i) for r in rows] == [
        ("a/foo", ".js", "foo.test", True), ("x/index", ".js", "index", False), ("a/", "", ".env", False), ("Makefile", "", "Makefile", False), ("x/y", ".PY", "y", False), ("w/v", ".py", "w\\v", True),
    ]
    h = spark.range(1).select(tx.content_hash(F.lit("añ"), F.lit("p.py")).alias("h")).first().h
    assert h == hashlib.sha256("añp.py".encode()).hexdigest()


PY = '''import x


def ä(a):
    """Doc of ä."""
    return helper(a) + len(a) + self.run(a)


@deco
async def second():
    def inner():
        pass


class Store(Base):
    "Keeps."

    def get(self):
        def nested():
            pass
        return 1

    class Inner:
        def deep(self): pass
'''


def test_chunks_of_python():
    chunks, error = chunk_source(PY, "py")
    assert error is None
    assert [(c.chunk_type, c.name, c.parent_class) for c in chunks] == [
        ("function", "ä", ""), ("function", "second", ""), ("function", "inner", ""), ("class", "Store", ""), ("method", "get", "Store"), ("method", "nested", "Store"), ("class", "Inner", "Store"), ("method", "deep", "Inner"),
    ]
    first = chunks[0]
    assert first.content.startswith("def ä(a):") and first.content.endswith("self.run(a)") and first.docstring == "Doc of ä." and first.calls == ["helper", "self.run"]
    assert (first.line_start, first.line_end) == (4, 6) and chunks[1].content.startswith("async def second")


def test_chunks_of_other_files():
    js, error = chunk_source("function a() {}\nconst b = () => 1;\nclass C { m() {} }\n", "js")
    assert error is None and [(c.chunk_type, c.name, c.parent_class) for c in js] == [("function", "a", ""), ("function", "b", ""), ("class", "C", ""), ("method", "m", "C")]
    assert chunk_source("A = 1\n", "py")[0][0].chunk_type == "module"
    broken, error = chunk_source("def f(:\n", "py")
    assert error and [c.chunk_type for c in broken] == ["module"]
    assert chunk_source("  \n", "py") == ([], None)


FILES = [("main.py", PY.encode()), ("constants.py", b"A = 1\n"), ("empty.py", b""), ("u.js", b"function f() {}\n"), ("node_modules/l/index.js", b"function g() {}"), ("bad.py", b"def f(:\n"), ("l.py", "def f():\n    return 'é'\n".encode("latin-1")), ("n.md", b"# x"), ("null.py", None)]


def test_chunk_files(spark):
    files = spark.createDataFrame(FILES, "rel_path string, content binary")
    chunks = chunking.chunk_files(files)
    rows = chunks.collect()
    assert {r.file_path for r in rows} == {"main.py", "constants.py", "u.js", "bad.py", "l.py"}
    assert next(r for r in rows if r.file_path == "constants.py").name == "constants"
    assert all(r.line_start >= 1 and r.line_end >= r.line_start and len(r.content_hash) == 64 for r in rows)
    assert {r.content_hash for r in rows} == {r.content_hash for r in chunking.chunk_files(files).collect()}
    errors = [r.file_path for r in chunking.chunk_files(files, with_errors=True).where("error is not null").collect()]
    assert errors == ["bad.py"]
    text = chunking.with_embedding_text(chunks).where("name = 'get'").first().embedding_text
    assert text.startswith("file: main.py\ntype: method\nname: get\nclass: Store\n\n")
    assert chunking.chunk_files(files.limit(0)).count() == 0


def providers():
    """Local classes, which travel to the executors with the job."""

    class Choosy:
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("bad text")
            return [[1.0, 2.0]] * len(texts)

    class Short:
        def embed(self, texts):
            return [[1.0]] * (1 if len(texts) > 1 else len(texts))

    class Broken:
        def embed(self, texts):
            raise RuntimeError("down")

    class Odd:
        def review(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("no answer")
            return {"bad": "{", "blank": '{"body": " ", "event": "COMMENT", "comments": []}', "event": '{"body": "x", "event": "MAYBE"}'}.get(
                prompt, '{"body": "fine", "event": "APPROVE", "comments": [{"path": "p", "line": 3, "body": "b"}]}'
            )

    return Choosy, Short, Broken, Odd


Choosy, Short, Broken, Odd = providers()


def test_embedding_errors_per_row(spark):
    texts = spark.createDataFrame([(0, "a"), (1, "poison"), (2, "b")], "idx long, text string")
    rows = embedding.embed(texts, "text", Choosy()).orderBy("idx").collect()
    assert [r.embedding for r in rows] == [[1.0, 2.0], None, [1.0, 2.0]] and "bad text" in rows[1].embed_error
    assert [r.embedding for r in embedding.embed(texts, "text", Short()).orderBy("idx").collect()] == [[1.0]] * 3
    assert embedding.embed_counts(embedding.embed(texts, "text", Choosy(), dimension=3)).first() == (0, 3)
    assert embedding.embed(texts.limit(0), "text", Choosy()).count() == 0
    with pytest.raises(Exception, match="bad text"):
        embedding.embed(texts, "text", Choosy(), fail_fast=True).collect()
    assert len(embedding.HashEmbedder(8).embed(["x y"])[0]) == 8


def test_index_store(spark, tmp_path):
    conf = EngineConf(embedding_dimension=16)
    store = index_store.IndexStore(spark, str(tmp_path / "store"), conf)
    embedder = embedding.HashEmbedder(16)
    first = spark.createDataFrame([("a.py", b"def f():\n    return 1\n\n\ndef f():\n    return 1\n"), ("b.py", b"X = 1\n")], "rel_path string, content binary")
    one = store.index(first, "o/r", "s1", embedder)
    assert (one.copied, one.inserted, one.failed, one.duplicate) == (0, 2, 0, 1)
    repo = store.get_repository("o/r")
    assert repo["active_index_run_id"] == one.run_id and repo["status"] == "indexed"
    assert store.get_or_create_repository("o/r", "other")["clone_url"] == repo["clone_url"]
    second = spark.createDataFrame([("a.py", b"# moved\ndef f():\n    return 1\n"), ("c.py", b"Y = 2\n")], "rel_path string, content binary")
    two = store.index(second, "o/r", "s2", embedder)
    assert (two.copied, two.inserted, two.deleted) == (1, 1, 1)
    kept = store.active_chunks(repo["id"]).where("name = 'f'").first()
    assert kept.line_start == 1  # positions are those of the first run
    assert store.run(repo["id"], one.run_id)["status"] == "superseded" and store.run(repo["id"], two.run_id)["status"] == "completed"
    again = store.active_chunks(repo["id"])
    assert store.write_chunks(again, repo["id"], two.run_id) == 0

    three = store.index(spark.createDataFrame([("d.py", b"Z = 3\n")], "rel_path string, content binary"), "o/r", "s3", Broken())
    assert (three.inserted, three.failed) == (0, 1)
    bad = spark.createDataFrame([("d.py", 3)], "rel_path string, wrong int")
    with pytest.raises(Exception):
        store.index(bad, "o/r", "s4", embedder)
    assert store.active_run(repo["id"]) == three.run_id and store.get_repository("o/r")["status"] == "failed"
    assert store.get_repository("nobody") is None and store.active_chunks("nobody") is None
    other = store.index(first, "o/r", "s5", embedding.HashEmbedder(16))
    assert other.copied == 0 or other.inserted >= 0


def test_store_frames(spark):
    runs = spark.createDataFrame([("r1", "a", "s", "main", "completed"), ("r2", "a", "s", "main", "completed"), ("r3", "b", "s", "main", "completed"), ("r4", "a", "s", "main", "failed")], "id string, repo_id string, commit_sha string, branch string, status string")
    repos = spark.createDataFrame([("a", "r2"), ("b", None)], "id string, active_index_run_id string")
    assert {(r.id, r.status) for r in index_store.superseded(runs, repos).collect()} == {("r1", "superseded"), ("r2", "completed"), ("r3", "completed"), ("r4", "failed")}
    assert [r.id for r in orphans(runs, repos.where("id = 'a'"), "repo_id").collect()] == ["r3"]
    with pytest.raises(Exception, match="status"):
        checked(runs.withColumn("status", F.lit("odd")), status="run_status").collect()
    assert checked(runs, status="run_status").count() == 4
    for schema in (REPOSITORIES, INDEX_RUNS, CODE_CHUNKS, PR_REVIEWS):
        assert spark.createDataFrame([], schema).count() == 0


def at(m):
    return dt.datetime(2024, 1, 1, 0, m)


def test_reviews(spark):
    rows = [
        ("i1", "a", 1, "t", "c1", 1, "REQUEST_CHANGES", "s", 5, 5, 0, 5, None, at(1)), ("i2", "a", 1, "t", "c2", 2, "REQUEST_CHANGES", "s", 2, 2, 0, 2, 9, at(2)), ("i3", "a", 1, "t", "c3", 3, "REQUEST_CHANGES", "s", 7, 7, 0, 7, 9, at(3)),
        ("i4", "b", 1, "u", "c1", 1, "APPROVE", "s", 3, 0, 0, 0, 9, at(1)), ("i5", "b", 1, "u", "c2", 2, "COMMENT", "s", 3, 0, 0, 0, 9, at(1)),
    ]
    table = spark.createDataFrame(rows, PR_REVIEWS)
    assert {r.id for r in reviews.reviews_latest(table).collect()} == {"i3", "i5"} and {r.id for r in reviews.reviews_first(table).collect()} == {"i1", "i4"}
    progress = {(r.repo_id, r.issues_fixed, r.total_runs) for r in reviews.review_progress(table).collect()}
    assert progress == {("a", -2, 3), ("b", 0, 2)}
    assert {(r.repo_id, r.next_run) for r in reviews.next_run(table).collect()} == {("a", 4), ("b", 3)}
    incoming = table.where("id in ('i1', 'i4')").withColumn("id", F.concat(F.lit("n"), "id")).unionByName(table.limit(0))
    new = {(r.id, r.review_run, r.issues_found, r.issues_open) for r in reviews.new_reviews(incoming, table).collect()}
    assert new == {("ni1", 4, 5, 5), ("ni4", 3, 0, 0)}
    asked = spark.createDataFrame([("a", 1, "c1"), ("a", 1, "c9")], "repo_id string, pr_number int, commit_sha string")
    assert [r.commit_sha for r in reviews.already_reviewed(asked, table).collect()] == ["c9"]
    assert reviews.review_progress(table.limit(0)).count() == 0


def test_review_prompts_and_answers(spark):
    files = parse_diffs(diffs(spark, RENAMED, "diff --git a/b.png b/b.png\nBinary\n"))
    texts = {r.pr_number: r.diff_text for r in review.diff_text(files).collect()}
    assert texts[0] == "### new.py [renamed] +1 -1 (renamed from old.py)\n@@ -1 +1 @@\n-a\n+b\n"
    assert texts[1] == "### b.png [modified] +0 -0\n(no diff available for this file)"
    p = spark.range(1).select(review.prompt(F.lit("T"), F.lit(None).cast("string"), F.lit("ctx"), F.lit(True)).alias("a"), review.prompt(F.lit("T"), F.lit("d"), F.lit("ctx"), F.lit(False)).alias("b")).first()
    assert "(no files changed)" in p.a and "ctx" not in p.a and "ctx" in p.b
    asked = spark.createDataFrame([(k, k) for k in ("ok", "bad", "blank", "event", "boom")], "id string, prompt string").withColumn("error", F.lit(None).cast("string"))
    asked = asked.unionByName(spark.createDataFrame([("skip", "ok", "fetch failed")], "id string, prompt string, error string"))
    done = review.analyze(asked, Odd())
    rows = {r.id: r for r in done.collect()}
    assert rows["ok"].review.event == "APPROVE" and rows["ok"].error is None
    assert all(rows[k].review is None and rows[k].error.startswith("analyze failed") for k in ("bad", "blank", "event", "boom")) and rows["skip"].error == "fetch failed"
    sent = done.where("id = 'ok'").select(review.payload(F.lit("c"), F.col("review")).alias("p"), review.payload(F.lit("c"), F.col("review"), True).alias("q")).first()
    assert '"comments":[{"path":"p","line":3,"body":"b"}]' in sent.p and "comments" not in sent.q
    codes = spark.createDataFrame([(200,), (404,), (503,)], "s int").select(review.http_error_class(F.col("s")).alias("k")).collect()
    assert [r.k for r in codes] == [None, "permanent", "transient"]


def archive(*names):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"x=1"))
    return raw.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("A = 1")
    (tmp_path / "b.md").write_text("no")
    assert [(r.rel_path, bytes(r.content)) for r in scan_tree(spark, str(tmp_path)).collect()] == [("src/a.py", b"A = 1")]
    assert unsafe_member("/etc/x") and unsafe_member("a/../b") and not unsafe_member("a/b..c")
    rows = [("good", archive("top/a.py", "top/s/b.py", "/abs.py", "top/../up.py")), ("two", archive("x/a", "y/b")), ("broken", b"nothing"), ("null", None)]
    got = expand_archives(spark.createDataFrame(rows, "archive string, content binary")).collect()
    assert {(r.archive, r.rel_path) for r in got} == {("good", "a.py"), ("good", "s/b.py"), ("two", None), ("broken", None), ("null", None)}
    assert all(r.error for r in got if r.rel_path is None)


def test_conf(tmp_path):
    env = tmp_path / ".env"
    env.write_text("GLOBAL_TOP_K=3\n# no=1\nOTHER=2\nMin_Score='0.5'\n")
    conf = EngineConf.load({"query_top_k": "9"}, str(env))
    assert (conf.global_top_k, conf.min_score, conf.query_top_k, conf.chunk_max_lines) == (3, 0.5, 9, 80)
