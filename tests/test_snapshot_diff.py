import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions.bitmap import Bitmap
from codeloom.operators.snapshot_diff import chunk_changes, chunk_ordinals, key_ordinals, snapshot_changes

RUNS = "id string, repo_id string, branch string, status string, started_at timestamp"
CHUNKS = "id string, index_run_id string, file_path string, parent_class string, name string, chunk_type string, content_hash string, block int"


def at(day):
    return dt.datetime(2024, 1, day)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=200), st.sets(st.integers(0, 300_000), max_size=200))
def test_bitmap_is_a_set(a, b):
    x, y = Bitmap.of(np.array(sorted(a), np.int64)), Bitmap.of(np.array(sorted(b), np.int64))
    assert x.minus(y).ordinals().tolist() == sorted(a - b)
    assert x.both(y).ordinals().tolist() == sorted(a & b)
    assert len(x) == len(a)


def test_dense_bitmap():
    a, b = Bitmap.of(np.arange(100_000)), Bitmap.of(np.arange(50_000, 150_000))
    assert a.minus(b).ordinals().tolist() == list(range(50_000))
    assert len(a.both(b)) == 50_000


def make(spark, rows, runs):
    chunks = spark.createDataFrame([(f"c{i}", *r, 0) for i, r in enumerate(rows)], CHUNKS)
    return chunk_changes(chunks, spark.createDataFrame(runs, RUNS))


def test_steps_with_empty_and_broken_runs(spark):
    runs = [
        ("r1", "a", "main", "superseded", at(1)),
        ("rx", "a", "main", "failed", at(2)),
        ("r2", "a", "main", "superseded", at(3)),
        ("r3", "a", "main", "superseded", at(4)),  # empty
        ("r4", "a", "main", "completed", at(5)),
    ]
    rows = [
        ("r1", "./p.py", "", "f", "function", "AA"),
        ("r1", "p.py", "", "g", "function", "bb"),
        ("r1", "p.py", "", "g", "function", "BB"),  # repeated
        ("rx", "p.py", "", "z", "function", "zz"),
        ("r2", "p.py", "", "f", "function", "aa"),  # the same but for case and path
        ("r2", "p.py", "", "g", "function", "cc"),
        ("r4", "p\\q.py", None, "h", "function", None),
    ]
    got = {(r.prev_run_id, r.run_id, r.file_path, r.name, r.change) for r in make(spark, rows, runs).collect()}
    assert got == {
        ("r1", "r2", "p.py", "g", "changed"),
        ("r2", "r3", "p.py", "f", "removed"),
        ("r2", "r3", "p.py", "g", "removed"),
        ("r3", "r4", "p/q.py", "h", "added"),
    }


def test_empty_tables(spark):
    assert make(spark, [], []).count() == 0
    assert make(spark, [("r1", "p", "", "f", "function", "a")], []).count() == 0
    assert make(spark, [], [("r1", "a", "main", "completed", at(1))]).count() == 0


def test_against_sets_in_many_blocks_and_with_a_dictionary(spark):
    rng = np.random.default_rng(5)
    runs, rows, truth = [], [], set()
    for stream in ("x", "y"):
        before, prev = {}, None
        for step in range(5):
            run = f"{stream}{step}"
            runs.append((run, stream, "main", "completed" if step == 4 else "superseded", at(step + 1)))
            now = {f"k{k}": str(rng.integers(3)) for k in rng.choice(60, 40, replace=False)}
            rows += [(run, k, v) for k, v in now.items()]
            if prev is not None:
                truth |= {(prev, run, k, "added") for k in now.keys() - before.keys()} | {(prev, run, k, "removed") for k in before.keys() - now.keys()}
                truth |= {(prev, run, k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
            before, prev = now, run
    frame = spark.createDataFrame(rows, "run string, k string, v string")
    listed = spark.createDataFrame(runs, RUNS).withColumnRenamed("id", "run")
    options = dict(snapshot="run", stream=["repo_id", "branch"], order=["started_at"], key=["k"], value="v", block_rows=25)
    got = snapshot_changes(frame, listed, **options)
    assert {(r.prev_snapshot, r.snapshot, r.k, r.change) for r in got.collect()} == truth
    keyed = frame.join(listed.select("run", "repo_id", "branch"), "run")
    first = key_ordinals(keyed.where("k < 'k3'"), stream=["repo_id", "branch"], key=["k"])
    whole = key_ordinals(keyed.where("k > 'k2'"), stream=["repo_id", "branch"], key=["k"], dictionary=first, block_rows=20)
    kept = {(r.repo_id, r.k): (r.blocks, r.ordinal) for r in whole.collect()}
    assert {b for b, _ in kept.values()} == {4}
    assert all(kept[(r.repo_id, r.k)][1] == r.ordinal for r in first.collect())
    assert len(kept) == len({(r.repo_id, r.k) for r in keyed.collect()})
    blocks = whole.selectExpr("repo_id", "pmod(xxhash64(k), blocks) as b", "ordinal")
    assert blocks.distinct().count() == len(kept)
    for known in (first, whole):
        again = snapshot_changes(frame, listed, dictionary=known, **options)
        assert {(r.prev_snapshot, r.snapshot, r.k, r.change) for r in again.collect()} == truth


def test_dictionary_of_chunks_goes_on(spark):
    runs = [("r1", "a", "main", "superseded", at(1)), ("r2", "a", "main", "completed", at(2))]
    rows = [("r1", "p.py", "", "f", "function", "a"), ("r1", "q.py", None, "g", "function", "a"), ("r2", "a.py", "", "f", "function", "a"), ("r2", "q.py", None, "g", "function", "b")]
    chunks = spark.createDataFrame([(f"c{i}", *r, 0) for i, r in enumerate(rows)], CHUNKS)
    listed = spark.createDataFrame(runs, RUNS)
    first = chunk_ordinals(chunks, listed.where("id = 'r1'"))
    both = chunk_ordinals(chunks, listed, first)
    assert {(r.file_path, r.ordinal) for r in first.collect()} == {("p.py", 0), ("q.py", 1)}
    assert {(r.file_path, r.ordinal) for r in both.collect()} == {("p.py", 0), ("q.py", 1), ("a.py", 2)}
    got = {(r.prev_run_id, r.file_path, r.change) for r in chunk_changes(chunks, listed, first).collect()}
    assert got == {("r1", "p.py", "removed"), ("r1", "q.py", "changed"), ("r1", "a.py", "added")}
