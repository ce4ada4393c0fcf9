"""The service on a live stream: tickets, answers, audit log, counters and feed, batch by batch.

Every micro-batch is a join of its rows with what is remembered of their tickets. Its events go to the
audit log once; all else follows from them as they were written: the tickets it has issued and used up,
the counters, and the newest rows for the feed. One manifest commits the batch (see commits), so log,
tickets, counters and feed always belong together. No row passes through Python.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from airlock.functions import catalog as c
from airlock.operators import audit, metrics
from airlock.operators.tickets import decide_uses
from airlock.sources.tables import remove
from airlock.streaming.commits import add, commit, committed, last_commit, of_batch, one_row
from airlock.streaming.ticket_table import BUCKETS, PARTS, TicketTable, learnt_from, learnt_sums

#: How long a used or expired ticket is remembered. Later uses of it are unknown instead of expired.
RETENTION_MS = 10 * c.TICKET_MS
#: Columns of answers, besides the batch that gave them.
ANSWERS = "ticket string, ts timestamp, seq long, choice string, decision string, reason string"
EVENTS = "ts timestamp, seq long, kind string, ticket string, risk int, preflight string, reason string, secrets long, decision string, choice string, message string, port int"
COUNTED = (*metrics.COUNTERS, "secrets_caught")
MANIFEST = f"latest timestamp, parts {PARTS}, " + ", ".join(f"{n} long" for n in COUNTED)
#: What a decide may say besides its ticket and time.
_SAID = {"risk": "int", "preflight": "string", "said": "string", "secrets": "long"}
#: The rows of the protocol.
ROWS = "ticket string, ts timestamp, seq long, is_use boolean, choice string, " + ", ".join(f"{n} {kind}" for n, kind in _SAID.items())


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _interval(ms: int):
    return F.expr(f"INTERVAL '{ms / 1000}' SECOND")


def batch_events(rows: DataFrame, known: DataFrame, ttl_ms: int) -> DataFrame:
    """The audit events of a micro-batch's rows: one for each ticket that is new, one for each use.

    Within a batch a ticket's rows are taken in the order of ts, decides before uses, seq. Of several
    decides of one ticket the first counts. A use that comes in an earlier batch than its decide is
    unknown, and so is one without a ticket. `known` (ticket, issued, used) is remembered from
    earlier batches.
    """
    first = rows.where(~F.col("is_use") & F.col("ticket").isNotNull()).groupBy("ticket").agg(F.min(F.struct(F.col("ts").isNull().alias("timeless"), "ts", "seq", *_SAID)).alias("d"))
    tickets = known.withColumn("before", F.lit(True)).join(first, "ticket", "full")
    of = lambda n, other: F.coalesce(n, other).alias(n)
    tickets = tickets.select("ticket", of("issued", "d.ts"), of("used", F.lit(False)), of("before", F.lit(False)), "d")
    new = tickets.where(~F.col("before")).select("ticket", "issued", "d.seq", "d.risk", "d.preflight", F.col("d.said").alias("reason"), "d.secrets")
    uses = rows.where("is_use").select("ticket", "ts", "seq", "choice")
    return audit.log(audit.decide_events(new), audit.consume_events(decide_uses(tickets, uses, _interval(ttl_ms))))


def answer_stream(rows: DataFrame, path: str, checkpoint: str, ttl_ms: int = c.TICKET_MS, retention_ms: int = RETENTION_MS, lateness_ms: int | None = None, every: str | None = None, opened: dt.datetime | None = None, buckets: int = BUCKETS, wait_ms: int = 0) -> StreamingQuery:
    """Answers the uses in a stream of (ticket, ts timestamp, seq, is_use, choice) and keeps the service's
    tables under a path: read_events, read_answers, read_counters and read_feed read them.

    Rows of decides may carry risk, preflight, said (the reason) and secrets. Every use is answered,
    however late. `lateness_ms` is the retention unless given. `every` is an interval between batches
    such as "2 seconds"; without it, what is there now is read. `opened` is the time of a STARTUP event
    in the first batch; without it there is none. `buckets` stays the same for a path.

    With `wait_ms` rows are taken in the order of their times: a row waits until a time so much later
    has been seen, so uses and decides may come as two streams (united) and in any order within that
    time, and are answered as the batch form answers them. What waits is a table of its own, as
    large as that time's rows. Rows that come later still are taken when they come. A stream that ends
    needs a last row (a decide without a ticket will do) for the ones before it to stop waiting.
    """
    late = retention_ms if lateness_ms is None else lateness_ms
    kept_ms = ttl_ms + retention_ms + late

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = last_commit(spark, path, MANIFEST)
        if done is not None and done["batch"] >= number:
            return
        missing = {n: F.lit(None).cast(kind) for n, kind in _SAID.items() if n not in batch.columns}
        rows = batch.withColumns(missing).select(*_columns(ROWS))
        if wait_ms and done is not None:
            rows = rows.unionByName(of_batch(spark, path, "waiting", ROWS, done["batch"]))
        rows = rows.persist()
        try:
            _run(spark, rows, number, done)
        finally:
            rows.unpersist()

    def _run(spark: SparkSession, rows: DataFrame, number: int, done) -> None:
        latest, seen = done["latest"] if done else None, rows.agg(F.max("ts")).first()[0]
        newest = max((t for t in (latest, seen) if t is not None), default=None)
        if wait_ms:
            ready = F.coalesce(F.col("ts") <= F.lit(newest).cast("timestamp") - _interval(wait_ms), F.lit(True))
            add(rows.where(~ready), path, "waiting", number)
            rows = rows.where(ready)
        table = TicketTable(spark, path, list(done["parts"]) if done else [], latest - dt.timedelta(milliseconds=kept_ms) if latest else None, buckets)
        mine = rows.where("ticket is not null").groupBy("ticket").agg(F.max("ts").alias("ts"))
        touched = mine.agg(F.collect_set(table.bucket())).first()[0] if table.parts else []
        events = batch_events(rows, table.known(mine, touched), ttl_ms)
        if opened is not None and number == 0:
            events = audit.log(audit.startup(one_row(spark, "ts timestamp", (opened,))), events)
        add(events, path, "events", number)
        written = of_batch(spark, path, "events", EVENTS, number)

        shown = written if done is None else written.unionByName(of_batch(spark, path, "feed", EVENTS, done["batch"]))
        add(audit.feed(shown).coalesce(1), path, "feed", number)
        sums = metrics.counters(written, *learnt_sums()).first()
        parts, old = [tuple(p) for p in table.parts], []
        if sums["rows"]:
            parts, old = table.extended(number, learnt_from(written), sums["rows"], sums["newest"])
        commit(spark, path, number, MANIFEST, (newest, parts, *(sums[n] + (done[n] if done else 0) for n in COUNTED)))
        # Nobody needs these any more: a reader that has begun with the manifest before keeps its feed.
        gone = [f"tickets/batch={v}" for v in old] + ([f"{t}/batch={done['batch'] - 1}" for t in ("feed", "waiting")] if done else [])
        for folder in gone:
            remove(spark, f"{path}/{folder}")

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _last(spark: SparkSession, path: str):
    return last_commit(spark, path, MANIFEST)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The audit log of all committed batches."""
    done = _last(spark, path)
    return committed(spark, path, "events", EVENTS, done["batch"] if done else None)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(ticket, ts, seq, choice, decision, reason, batch) of all uses in committed batches."""
    return read_events(spark, path).where("kind = 'CONSUME'").select("ticket", "ts", "seq", "choice", "decision", "reason", "batch")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row: the five counters as of the last committed batch."""
    done = _last(spark, path)
    return one_row(spark, ", ".join(f"{n} long" for n in COUNTED), tuple(done[n] if done else 0 for n in COUNTED))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The newest events as of the last committed batch, newest first."""
    done = _last(spark, path)
    rows = of_batch(spark, path, "feed", EVENTS, done["batch"]) if done else spark.createDataFrame([], EVENTS)
    return audit.feed(rows)
