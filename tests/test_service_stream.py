"""The service as a stream: batches committed whole, crashes between two writes, the ticket table's cost."""

import datetime as dt
import json
import tempfile
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from airlock.operators import audit, metrics, service
from airlock.plans import fixtures
from airlock.sources import requests
from airlock.streaming import commits, tickets
from airlock.streaming.tickets import EVENTS, MANIFEST, answer_stream, read_answers, read_counters, read_events, read_feed

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _rows(df):
    return sorted(map(str, df.select(*sorted(set(df.columns) - {"batch"})).collect()))


@pytest.fixture(scope="module")
def request_dir(spark, sf_dir):
    """Request files, one for each batch, in the order of time."""
    path = tempfile.mkdtemp(prefix="spark-")
    lines = [r.value for r in fixtures.request_log(spark, sf_dir).orderBy(F.get_json_object("value", "$.seq").cast("long")).limit(200).collect()]
    keys = [json.loads(x)["seq"] // 4 for x in lines]
    for n in range(4):
        part = [x for x, k in zip(lines, keys, strict=True) if k % 4 == n]
        with open(f"{path}/{n}.txt", "w") as f:
            f.write("\n".join(part) + "\n")
        time.sleep(0.02)
    return path


def _start(spark, request_dir, path, **more):
    lines = requests.stream_requests(spark, request_dir, files_per_batch=1)
    return answer_stream(service.protocol_rows(lines), path, f"{path}/checkpoint", opened=START, **more)


def _batch_log(spark, request_dir):
    return service.served(requests.read_requests(spark, request_dir), F.expr("INTERVAL 60 SECOND"), spark.createDataFrame([(START,)], "ts timestamp"))


def test_stream_equals_batch_through_crashes(spark, request_dir, monkeypatch):
    """The stream breaks off after each of its writes in turn, and once after its commit; what readers
    see in between is always a whole batch, and in the end what the batch form gives."""
    path = tempfile.mkdtemp(prefix="spark-")
    plan = {("events", 1), ("feed", 1), ("tickets", 1), ("events", 2), ("manifest", 2)}
    real_add, real_commit = commits.add, commits.commit

    def breaking_add(rows, where, table, number, *by):
        real_add(rows, where, table, number, *by)
        if (table, number) in plan:
            plan.remove((table, number))
            raise RuntimeError("lost")

    def breaking_commit(spark, where, number, fields, values):
        real_commit(spark, where, number, fields, values)
        if ("manifest", number) in plan:
            plan.remove(("manifest", number))
            raise RuntimeError("lost")

    monkeypatch.setattr(tickets, "add", breaking_add)
    monkeypatch.setattr("airlock.streaming.ticket_table.add", breaking_add)
    monkeypatch.setattr(tickets, "commit", breaking_commit)
    crashes, seen = 0, 0
    while True:
        try:
            _start(spark, request_dir, path).awaitTermination()
            break
        except StreamingQueryException as e:
            assert "lost" in str(e)
            crashes += 1
            last = commits.last_commit(spark, path, MANIFEST)
            log = read_events(spark, path)
            assert log.agg(F.max("batch")).first()[0] == last["batch"] and last["batch"] >= seen
            seen = last["batch"]
            assert read_counters(spark, path).first() == metrics.counters(log).first()
            assert _rows(read_feed(spark, path)) == _rows(audit.feed(log))
    assert crashes == 5 and not plan
    want = _batch_log(spark, request_dir)
    assert want.where("kind = 'DECIDE'").count() > 20 and {r.reason for r in want.where("kind = 'CONSUME'").select("reason").distinct().collect()} >= {"user allowed", "unknown ticket", "replay blocked"}
    assert _rows(read_events(spark, path)) == _rows(want)
    assert read_counters(spark, path).first() == metrics.counters(want).first() and read_counters(spark, path).first().secrets_caught > 0
    assert _rows(read_feed(spark, path)) == _rows(audit.feed(want))
    assert read_events(spark, path).select("batch").distinct().count() == 4


def test_feed_after_each_batch(spark, request_dir, monkeypatch):
    """After every batch the kept feed is the newest rows of the log so far."""
    path, steps = tempfile.mkdtemp(prefix="spark-"), []
    real = audit.feed
    monkeypatch.setattr(audit, "feed", lambda events, rows=7: real(events, rows))

    def commit(spark, where, number, fields, values):
        commits.commit(spark, where, number, fields, values)
        log = read_events(spark, where)
        steps.append((_rows(read_feed(spark, where)) == _rows(real(log, 7)), read_feed(spark, where).count(), read_counters(spark, where).first() == metrics.counters(log).first()))

    monkeypatch.setattr(tickets, "commit", commit)
    _start(spark, request_dir, path).awaitTermination()
    assert steps == [(True, 7, True)] * 4


def test_state_written_grows_with_the_batch(spark):
    """Many tickets first, then small batches: these write few rows of tickets, whatever is remembered,
    and still know the old ones."""
    path, where = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    schema = "ticket string, ts timestamp, seq long, is_use boolean, choice string"

    def put(rows, n):
        data = [(t, START + dt.timedelta(seconds=s), seq, u, "ALLOW" if u else None) for t, s, seq, u in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        answer_stream(spark.readStream.schema(schema).parquet(f"{where}/in"), path, f"{path}/checkpoint").awaitTermination()
        return commits.last_commit(spark, path, MANIFEST)

    put([(f"t{k}", 0, k, False) for k in range(3000)], 0)
    for n in range(1, 8):
        last = put([(f"t{n}", n, 10_000 + n, True), (f"n{n}", n, 20_000 + n, False)], n)
        assert [p["rows"] for p in last["parts"]][0] == 3000 and sum(p["rows"] for p in last["parts"]) == 3000 + 2 * n
        assert len(last["parts"]) <= 1 + n.bit_length()
    got = {r.ticket: r.reason for r in read_answers(spark, path).collect()}
    assert got == {f"t{n}": "user allowed" for n in range(1, 8)}
    put([("t3", 9, 30_000, True), ("n2", 9, 30_001, True), ("no", 9, 30_002, True), ("t9", 61, 30_003, True)], 8)
    got = {r.ticket: r.reason for r in read_answers(spark, path).where("seq >= 30000").collect()}
    assert got == {"t3": "replay blocked", "n2": "user allowed", "no": "unknown ticket", "t9": "expired ticket"}
    # Parts whose rows are all past their retention go without being read.
    put([("late", 5000, 40_000, False)], 9)
    last = put([("t5", 5001, 40_001, True)], 10)
    assert sum(p["rows"] for p in last["parts"]) < 50
    assert {r.reason for r in read_answers(spark, path).where("seq = 40001").collect()} == {"unknown ticket"}


def test_odd_rows(spark):
    """No rows, null times, null tickets, several decides of one ticket, in one batch and over two."""
    path, where = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    schema = "ticket string, ts timestamp, seq long, is_use boolean, choice string, secrets long"
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    steps = [[], [("a", at(1), 1, False, None, 2), ("a", at(0), 0, False, None, 1), (None, at(0), 2, False, None, 1), ("z", None, 3, False, None, 5), ("a", None, 4, True, "ALLOW", None)], [("a", at(2), 5, False, None, 9), ("a", at(3), 6, True, "no", None), ("z", at(3), 7, True, "ALLOW", None), (None, at(3), 8, True, "ALLOW", None)]]
    assert read_events(spark, path).isEmpty() and read_feed(spark, path).isEmpty() and read_counters(spark, path).first().total == 0
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        answer_stream(spark.readStream.schema(schema).parquet(f"{where}/in"), path, f"{path}/checkpoint").awaitTermination()
    log = read_events(spark, path)
    assert log.drop("batch").schema.simpleString() == spark.createDataFrame([], EVENTS).schema.simpleString()
    assert {(r.ticket, r.seq, r.secrets) for r in log.where("kind = 'DECIDE'").collect()} == {("a", 0, 1), ("z", 3, 5)}
    assert {(r.seq, r.reason) for r in log.where("kind = 'CONSUME'").collect()} == {(4, "unknown ticket"), (6, "user blocked"), (7, "unknown ticket"), (8, "unknown ticket")}
