"""The audit log, its feed and its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.functions import catalog

COLUMNS = ("ts", "seq", "kind", "ticket", "risk", "preflight", "reason", "secrets", "decision", "choice", "message", "port")


def startup(opened: DataFrame, message: str = "audit log opened", port: int = catalog.PORT) -> DataFrame:
    """One STARTUP row at the time in `opened` (one row, column ts)."""
    return opened.select("ts", F.lit(-1).cast("long").alias("seq"), F.lit("STARTUP").alias("kind"), F.lit(message).alias("message"), F.lit(port).alias("port"))


def decide_events(decides: DataFrame) -> DataFrame:
    return decides.select(F.col("issued").alias("ts"), "seq", F.lit("DECIDE").alias("kind"), "ticket", "risk", "preflight", "reason", "secrets")


def consume_events(decided: DataFrame) -> DataFrame:
    """Every well-formed use is logged, those of unknown tickets too."""
    return decided.select("ts", "seq", F.lit("CONSUME").alias("kind"), "ticket", "decision", "reason", "choice")


def log(*events: DataFrame) -> DataFrame:
    """All events, none merged, in one layout."""
    both = events[0]
    for more in events[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    missing = {n: F.lit(None).cast(kind) for n, kind in (("message", "string"), ("port", "int")) if n not in both.columns}
    return both.withColumns(missing).select(*COLUMNS)


def feed(events: DataFrame, rows: int = catalog.FEED_ROWS) -> DataFrame:
    """The newest rows, newest first."""
    return events.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(rows)


def line() -> Column:
    """An event as a line of text; what is null or empty is left out."""
    part = lambda c, before, after="": F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit(after)), F.lit(""))
    short = F.substring(F.nullif(F.col("ticket"), F.lit("")), 1, 8)
    return F.concat(
        F.date_format("ts", "HH:mm:ss"),
        F.lit("  "),
        F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("?")),
        part(F.col("decision"), " "),
        part(F.col("reason"), " (", ")"),
        part(short, " ", "..."),
        part(F.col("message"), " "),
    )


#: The fields of an event's data in the feed.
DATA = ("ticket", "risk", "preflight", "decision", "reason", "choice", "secrets", "message", "port")
FEED_SCHEMA = "array<struct<ts_ms: long, kind: string, data: struct<ticket: string, risk: int, preflight: string, decision: string, reason: string, choice: string, secrets: long, message: string, port: int>>>"


def feed_json(shown: DataFrame) -> DataFrame:
    """One row, `events`: the feed's rows as a JSON array, newest first; fields that an event doesn't
    have are left out. `shown` is a feed, and so of bounded size."""
    event = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "kind", F.struct(*DATA).alias("data"))
    rows = F.sort_array(F.collect_list(F.struct("ts", "seq", event.alias("event"))), asc=False)
    return shown.agg(F.to_json(F.transform(rows, lambda r: r["event"])).alias("events"))


def feed_events(feed: DataFrame) -> DataFrame:
    """(pos, ts_ms, kind, and the fields of data) read back from the JSON array."""
    rows = feed.select(F.posexplode(F.from_json("events", FEED_SCHEMA)).alias("pos", "e"))
    return rows.select("pos", "e.ts_ms", "e.kind", "e.data.*")
