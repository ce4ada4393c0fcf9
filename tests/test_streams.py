"""Streams: the ticket protocol over several micro-batches and restarts, and the pace of batches."""

import datetime as dt
import json
import tempfile
import time

from pyspark.sql import functions as F

from airlock.operators import service
from airlock.sources import requests
from airlock.sources.tables import append, append_stream, stream
from airlock.streaming.messages import scan_stream
from airlock.streaming.tickets import answer_stream, read_answers

SCHEMA = "ticket string, ts timestamp, seq long, is_use boolean, choice string"
STEPS = [
    [("a", 0, False), ("a", 10, True), ("b", 0, False), ("z", 5, True), (None, 0, False), (None, 1, True)],
    [("a", 20, True), ("a", 61, True), ("b", 60, True)],
    [("q", 5000, True)],
    [("a", 5001, True)],
]
WANTED = [
    {("a", "user allowed"), ("z", "unknown ticket"), (None, "unknown ticket")},
    {("a", "replay blocked"), ("a", "expired ticket"), ("b", "user allowed")},
    {("q", "unknown ticket")},
    {("a", "unknown ticket")},
]


def test_steps_on_one_checkpoint(spark):
    """Every step restarts the stream from its checkpoint."""
    where = tempfile.mkdtemp(prefix="spark-")
    seen = set()
    for n, (rows, wanted) in enumerate(zip(STEPS, WANTED, strict=True)):
        data = [(t, dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s), 100 * n + i, u, "ALLOW" if u else None) for i, (t, s, u) in enumerate(rows)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")
        answer_stream(spark.readStream.schema(SCHEMA).parquet(f"{where}/in"), f"{where}/out", f"{where}/checkpoint").awaitTermination()
        got = {(r.ticket, r.seq, r.reason) for r in read_answers(spark, f"{where}/out").collect()}
        assert {(t, why) for t, _, why in got - seen} == wanted
        seen = got


def _lines(path, name, rows):
    with open(f"{path}/{name}", "w") as f:
        for ts_ms, seq, endpoint, body in rows:
            f.write(json.dumps({"ts_ms": ts_ms, "seq": seq, "endpoint": endpoint, "line": body}) + "\n")
    time.sleep(0.02)


def test_a_replay_fails(spark):
    """Decide, use, the same use again: one file and micro-batch each, a restart before the last. The
    stream answers as the batch does."""
    where, path = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    ticket = spark.range(1).select(requests.ticket_id(F.lit(7).cast("long"))).first()[0]
    use = json.dumps({"ticket": ticket, "choice": "allow"})
    _lines(path, "1.txt", [(1000, 7, "decide", json.dumps({"product": "claude", "meta": {"preview": "pwd = 123456", "secrets": ["Password"], "risk": 85}})), (1001, 8, "decide", "{broken")])
    _lines(path, "2.txt", [(2000, 9, "consume", use), (2001, 10, "consume", "[")])

    def answered():
        lines = requests.stream_requests(spark, path, files_per_batch=1)
        answer_stream(service.protocol_rows(lines), where, f"{where}/checkpoint").awaitTermination()
        return {(r.seq, r.decision, r.reason) for r in read_answers(spark, where).collect()}

    assert answered() == {(9, "ALLOW", "user allowed")}
    _lines(path, "3.txt", [(3000, 11, "consume", use)])
    _lines(path, "4.txt", [(70_000, 12, "consume", use), (70_000, 13, "consume", "{}")])
    got = answered()
    assert got == {(9, "ALLOW", "user allowed"), (11, "DENY", "replay blocked"), (12, "DENY", "expired ticket"), (13, "DENY", "unknown ticket")}
    assert read_answers(spark, where).select("batch").distinct().count() >= 3

    lines = requests.read_requests(spark, path)
    audit = f"{tempfile.mkdtemp(prefix='spark-')}/audit"
    log = service.served(lines, F.expr("INTERVAL 60 SECOND"))
    append(log, audit)
    kept = spark.read.parquet(audit)
    assert {(r.seq, r.decision, r.reason) for r in kept.where("kind = 'CONSUME'").collect()} == got
    asked = kept.where("kind = 'DECIDE'").collect()
    assert [(r.ticket, r.risk, r.preflight, r.secrets) for r in asked] == [(ticket, 85, "WARN", 1)]
    append(log, audit)
    assert spark.read.parquet(audit).count() == 2 * kept.count()
    meta = service.issued_tickets(lines).first().meta
    assert (meta.product, meta.host, meta.risk, meta.preflight) == ("claude", None, 85, "WARN") and json.loads(meta.meta)["risk"] == 85
    assert requests.rejected(requests.parsed(lines)).count() == 2


def test_batches_at_an_interval(spark):
    where = tempfile.mkdtemp(prefix="spark-")
    write = lambda k: spark.createDataFrame([(k, "password: hunter2")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{where}/documents.parquet")
    write(1)
    said = scan_stream(stream(spark, where, "documents"), ["doc_id"])
    query = append_stream(said, f"{where}/out", f"{where}/checkpoint", every="1 second")
    try:
        for k in (2, 3):
            query.processAllAvailable()
            write(k)
        query.processAllAvailable()
        assert query.isActive and len({p["batchId"] for p in query.recentProgress}) >= 3
    finally:
        query.stop()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{where}/out").where("label = 'high'").collect()) == [1, 2, 3]


def test_missing_counters_are_zero(spark):
    from airlock.operators.metrics import displayed

    row = displayed(spark.createDataFrame([(None, 3)], "total long, allowed long")).first()
    assert (row.total, row.allowed, row.denied, row.replay_blocked, row.secrets_caught) == (0, 3, 0, 0, 0)
