"""Two logs as two streams: answers in the order of time, tickets that expire unused, default deny."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from airlock.operators.tickets import decide_uses
from airlock.sources.tables import append_stream
from airlock.streaming.joins import abandoned_stream, denied_offline_stream
from airlock.streaming.tickets import answer_stream, read_answers, read_counters

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _at(s):
    return None if s is None else START + dt.timedelta(seconds=s)


def _stream(spark, schema, files):
    """A stream of one file a batch."""
    where = tempfile.mkdtemp(prefix="spark-")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def _all(spark, df):
    where = tempfile.mkdtemp(prefix="spark-")
    append_stream(df, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/out").collect()


def test_shuffled_logs_are_answered_in_order(spark):
    """Uses that come before their decides, a third of all on one ticket; the same answers as in a batch."""
    rng = random.Random(8)
    decides = [(f"t{k}", _at(k * 7), k) for k in range(40)]
    uses = [("t5" if rng.random() < 0.33 else f"t{rng.randrange(44)}", _at(rng.randrange(330)), 1000 + k, rng.choice(["ALLOW", "DENY"])) for k in range(240)]
    late = lambda rows, i: sorted(rows, key=lambda r: r[i] + dt.timedelta(seconds=rng.randrange(50)))
    cut = lambda rows, i: [[r for r in late(rows, i) if n * 95 <= (r[i] - START).total_seconds() + 25 < (n + 1) * 95] for n in range(4)]
    d = _stream(spark, "ticket string, ts timestamp, seq long", [*cut(decides, 1), [(None, _at(1000), -1)]])
    u = _stream(spark, "ticket string, ts timestamp, seq long, choice string", [*cut(uses, 1), []])
    rows = d.withColumn("is_use", F.lit(False)).withColumn("choice", F.lit(None).cast("string")).unionByName(u.withColumn("is_use", F.lit(True)))
    path = tempfile.mkdtemp(prefix="spark-")
    answer_stream(rows, path, f"{path}/checkpoint", wait_ms=100_000).awaitTermination()
    want = decide_uses(spark.createDataFrame(decides, "ticket string, issued timestamp, seq long").drop("seq"), spark.createDataFrame(uses, "ticket string, ts timestamp, seq long, choice string"), F.expr("INTERVAL 60 SECOND"))
    key = lambda df: sorted((r.seq, r.ticket, r.decision, r.reason) for r in df.collect())
    assert key(read_answers(spark, path)) == key(want) and {r[3] for r in key(want)} == {"unknown ticket", "expired ticket", "replay blocked", "user allowed", "user blocked"}
    assert read_counters(spark, path).first().total == len(uses)
    assert read_answers(spark, path).select("batch").distinct().count() >= 2


def test_abandoned_as_they_expire(spark):
    decides = [[("used", _at(0)), ("late", _at(0)), ("never", _at(1)), (None, _at(1)), ("open", None)], [("edge", _at(20))], [("beat", _at(500))], [("other", _at(501))]]
    uses = [[("used", _at(5)), ("used", _at(6))], [("late", _at(61)), ("edge", _at(80)), ("none", _at(3))], [("beat", _at(500))], [("never", _at(502))]]
    d, u = _stream(spark, "ticket string, issued timestamp", decides), _stream(spark, "ticket string, ts timestamp", uses)
    got = _all(spark, abandoned_stream(d, u, ttl_ms=60_000, lateness_ms=100_000))
    assert sorted((r.ticket, r.expires - r.issued) for r in got) == [("late", dt.timedelta(seconds=60)), ("never", dt.timedelta(seconds=60))]


def test_default_deny_after_the_wait(spark):
    actions = [[(1, _at(0), "a"), (2, _at(0), "b"), (3, _at(1), "c"), (3, _at(1), "c")], [(4, _at(30), None), (None, _at(2), "x")], [(-1, _at(900), "beat")]]
    decides = [[(1, _at(4))], [(2, _at(31)), (4, _at(60))], [(-1, _at(900))]]
    a, d = _stream(spark, "msg_id long, ts timestamp, note string", actions), _stream(spark, "msg_id long, issued timestamp", decides)
    got = _all(spark, denied_offline_stream(a, d, "msg_id", wait_ms=30_000, lateness_ms=60_000))
    assert sorted((r.msg_id, r.note, r.decision, r.label, r.findings) for r in got) == [(2, "b", "DENY", "high", "Guard offline"), (3, "c", "DENY", "high", "Guard offline"), (3, "c", "DENY", "high", "Guard offline")]
