import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from codeloom.streaming import events as ev


def body(**values):
    base = {"ref": "refs/heads/main", "action": "opened", "repository": {"full_name": "o/r", "default_branch": "main"}, "pull_request": {"number": 7, "title": "t", "head": {"sha": "abc"}}}
    return json.dumps(base | values).encode()


def at(m):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)


def sign(raw, secret="s"):
    return "sha256=" + hmac.new(secret.encode(), raw, hashlib.sha256).hexdigest()


ROWS = [
    ("1", at(0), "push", body()), ("2", at(1), "push", body(ref="refs/heads/dev")), ("3", at(2), "pull_request", body()), ("4", at(3), "pull_request", body(action="closed")),
    ("5", at(4), "ping", body()), ("6", at(5), None, body()), ("7", at(6), "push", b"no json"), ("8", at(50), "push", body()), ("9", at(90), "push", body()), ("10", at(95), "pull_request", body(action="synchronize")),
]


def events(spark):
    return spark.createDataFrame([(i, t, k, sign(b), b) for i, t, k, b in ROWS], ev.EVENTS)


def test_signatures(spark):
    e = events(spark).limit(1)
    check = lambda s: ev.valid_signature(F.col("body"), s, "s")
    row = e.select(check(F.col("signature")).alias("a"), check(F.lit("sha256=00")).alias("b"), check(F.lit(None).cast("string")).alias("c"), check(F.lit("ünï")).alias("d")).first()
    assert tuple(row) == (True, False, False, False)


def test_routing_and_dedup(spark):
    jobs = ev.routed(events(spark))
    assert [(r.kind, r.job_id) for r in jobs.orderBy("ts").collect()] == [("ingest", "ingest:o/r:main"), ("review", "review:o/r:7:abc"), ("ingest", "ingest:o/r:main"), ("ingest", "ingest:o/r:main"), ("review", "review:o/r:7:abc")]
    kept = [(r.job_id.split(":")[0], r.ts) for r in ev.deduplicated_table(jobs).orderBy("ts").collect()]
    assert kept == [("ingest", at(0)), ("review", at(2)), ("ingest", at(90)), ("review", at(95))]
    assert {(r.kind, r.ts) for r in ev.latest_jobs(jobs).collect()} == {("ingest", at(90)), ("review", at(95))}
    assert ev.routed(events(spark).limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, (name, t, kind, raw) in enumerate(ROWS):
        (source / f"{i}.json").write_text(json.dumps({"event_id": name, "ts": t.isoformat(), "event_type": kind, "signature": sign(raw), "body": raw.decode()}))
    stream = ev.routed(ev.read_events(spark, str(source), max_files=3))
    seen = []
    query = ev.consume(stream, lambda s: s.createDataFrame([("o/r", 7, "old")], "full_name string, pr_number int, commit_sha string"), lambda rows: seen.extend(rows.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.job_id, r.ts) for r in seen) == sorted((r.job_id, r.ts) for r in ev.routed(events(spark)).collect())


def test_streaming_dedup_and_idempotence(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, (name, t, kind, raw) in enumerate(ROWS):
        (source / f"{i}.json").write_text(json.dumps({"event_id": name, "ts": t.isoformat(), "event_type": kind, "signature": None, "body": raw.decode()}))
    jobs = ev.deduplicated(ev.routed(ev.read_events(spark, str(source), max_files=100)))
    seen, calls = [], []

    def handle(rows):
        calls.append(1)
        if len(calls) == 1:
            raise ConnectionError("once")
        seen.extend(rows.collect())

    done = lambda s: s.createDataFrame([("o/r", 7, "abc")], "full_name string, pr_number int, commit_sha string")
    ev.consume(jobs, done, handle, str(tmp_path / "cp"), delay_s=0).awaitTermination(120)
    assert [r.job_id for r in seen] == ["ingest:o/r:main"]


def test_retries():
    waits, left = [], [TimeoutError("a"), ev.TransientError("b")]

    def work():
        if left:
            raise left.pop()

    assert ev.with_retries(work, sleep=waits.append) == 3 and waits == [30, 30]
    for problem, options in ((ValueError("permanent"), {}), (ConnectionError("last try"), {"tries": 1}), (ConnectionError("no time left"), {"limit_s": 10})):
        left = [problem]
        with pytest.raises(type(problem)):
            ev.with_retries(work, sleep=waits.append, **options)
    assert waits == [30, 30]
