"""Tickets, requests, the audit log and its counters."""

import datetime as dt

from pyspark.sql import functions as F

from airlock.operators import audit, metrics, pages, tickets
from airlock.sources import requests

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
USE = "ticket string, ts timestamp_ntz, seq long, choice string"


def _decide(spark, decides, uses):
    d = spark.createDataFrame([(t, at(s)) for t, s in decides], "ticket string, issued timestamp_ntz")
    u = spark.createDataFrame([(t, at(s), i, c) for i, (t, s, c) in enumerate(uses)], USE)
    ttl = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))
    return [r.reason for r in tickets.decide_uses(d, u, ttl).orderBy("seq").collect()]


def test_order_of_checks(spark):
    uses = [("x", 5, "ALLOW"), ("a", 60, "ALLOW"), ("a", 60, "ALLOW"), ("a", 61, "ALLOW"), ("b", -1, "ALLOW"), ("b", 1, "DENY"), ("b", 2, "ALLOW"), ("c", 70, "ALLOW"), ("c", 10, "maybe")]
    got = _decide(spark, [("a", 0), ("b", 0), ("c", 0)], uses)
    assert got == ["unknown ticket", "user allowed", "replay blocked", "expired ticket", "unknown ticket", "user blocked", "replay blocked", "expired ticket", "user blocked"]


def test_an_expired_use_does_not_use_up(spark):
    assert _decide(spark, [("a", 0)], [("a", 100, "ALLOW"), ("a", 3, "ALLOW")]) == ["expired ticket", "user allowed"]


def test_no_rows(spark):
    assert _decide(spark, [], []) == []


def test_requests(spark):
    lines = [
        '{"product":"claude","meta":{"preview":"pwd:123456","secrets":["Password"],"risk":85}}',
        '{"meta":{"preview":123,"secrets":"x"}}', "{}", "5", "[]", '{"ticket":"T","choice":"allow"}', '{"ticket":"T","choice":true}', '{"ticket":"T"}',
        '{"ticket":"A","ticket":"B"}', "{bad", "", None,
    ]
    df = requests.parsed(spark.createDataFrame(list(enumerate(lines)), "k int, line string"))
    assert sorted(r.k for r in requests.rejected(df).collect()) == [9, 10, 11]
    good = requests.accepted(df)
    asked = {r.k: (r.risk, r.preflight, r.secrets) for r in requests.decide_fields(good, ["k"]).collect()}
    assert asked[0] == (85, "WARN", 1) and all(asked[k] == (10, "ALLOW", 0) for k in range(1, 9))
    used = {r.k: (r.ticket, r.choice) for r in requests.use_fields(good, ["k"]).collect()}
    assert used[5] == ("T", "ALLOW") and used[6] == used[7] == ("T", "DENY") and used[8] == ("B", "DENY") and used[3] == ("", "DENY")


def test_ticket_ids(spark):
    ids = [r[0] for r in spark.range(3).select(requests.ticket_id(F.col("id"))).collect()]
    assert len(set(ids)) == 3 and all([len(p) for p in i.split("-")] == [8, 4, 4, 4, 12] for i in ids)


def _log(spark, n=7):
    rows = [(at(i), i, "CONSUME" if i % 3 else "DECIDE", "ALLOW" if i % 2 else "DENY", "replay blocked" if i % 5 == 0 else "user allowed", None if i % 3 else i) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, seq long, kind string, decision string, reason string, secrets long")


def test_counters_add_up(spark):
    c = metrics.counters(_log(spark, 50)).first()
    assert c.total == c.allowed + c.denied and c.total == 33 and c.secrets_caught == 16


def test_running_and_feed_depth(spark):
    events = _log(spark, 50)
    last = metrics.running(events, 5).orderBy("position").collect()[-1]
    total = metrics.counters(events).first()
    assert (last.position, last.total, last.denied) == (50, total.total, total.denied)
    depth = metrics.feed_depth(events, 10)
    newest = depth.where("seq = 49").first()
    shown = metrics.dashboard(audit.feed(events, 10)).first()
    assert (newest.depth, newest.feed_total, newest.feed_allowed) == (10, shown.total, shown.allowed)
    assert depth.where("depth > 10").isEmpty()


def test_log_at_one_instant(spark):
    """90 % of the log at one time: the parts stay even, and every event's counters and feed are those of
    counting by hand, also where a part is shorter than the feed."""
    rows = [(None if i < 3 else at(0 if i < 40 else 5 if i < 1900 else i), i, "CONSUME" if i % 3 else "DECIDE", "ALLOW" if i % 2 else "DENY", "replay blocked" if i % 5 == 0 else "x", None) for i in range(2000)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, kind string, decision string, reason string, secrets long").repartition(3)
    sizes = [r["count"] for r in metrics._counted(events, 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    use = [int(r[2] == "CONSUME") for r in rows]
    blocked = [u * int(r[4] == "replay blocked") for u, r in zip(use, rows, strict=True)]
    got = {r.seq: r for r in metrics.running(events, 8).collect()}
    assert all(got[i].position == i + 1 and got[i].total == sum(use[: i + 1]) and got[i].replay_blocked == sum(blocked[: i + 1]) for i in range(0, 2000, 37))
    for feed in (7, 600):
        got = {r.seq: r for r in metrics.feed_depth(events, feed, 8).collect()}
        assert len(got) == 2000
        assert all(got[i].depth == min(i + 1, feed) and got[i].feed_total == sum(use[max(0, i + 1 - feed) : i + 1]) for i in range(0, 2000, 37))
    assert metrics.running(events.limit(0)).isEmpty() and metrics.feed_depth(events.limit(0)).isEmpty()


def test_lines(spark):
    df = spark.createDataFrame(
        [(at(3661), "CONSUME", "abcdefghij", "DENY", "replay blocked", None), (at(0), "", None, None, None, "hello")],
        "ts timestamp_ntz, kind string, ticket string, decision string, reason string, message string",
    )
    assert [r[0] for r in df.select(audit.line()).collect()] == ["01:01:01  CONSUME DENY (replay blocked) abcdefgh...", "00:00:00  ? hello"]


def test_clicks_and_pages(spark):
    rows = [("button", None, None, None, None, "composer-submit"), ("div", "button", "Send", None, None, None), ("div", None, "Send", None, None, None), ("BUTTON", None, None, "submit", None, None), ("button", None, None, None, " Send ", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    assert [r[0] for r in df.select(pages.is_send(*map(F.col, "abcdef"))).collect()] == [False, True, False, True, True]
    urls = spark.createDataFrame([("https://claude.ai/x",), ("http://claude.ai/x",), ("https://a.claude.ai/",), ("not a url",), (None,)], "u string")
    assert [r[0] for r in urls.select(pages.is_protected(F.col("u"))).collect()] == [True, False, False, False, False]


def test_policy_default(spark):
    acts = spark.createDataFrame([("a",), ("b",)], "tool string")
    policy = spark.createDataFrame([("a", "Low")], "tool string, tier string")
    assert {r.tool: r.tier for r in tickets.with_policy(acts, policy).collect()} == {"a": "Low", "b": "High"}
