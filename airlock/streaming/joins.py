"""Absences on a stream: tickets that expire unused, and actions that never got a ticket.

Both are outer joins of two streams with a bound in time. A row without a partner is emitted once the
watermarks of both streams have passed the last moment at which a partner could still come; until then
it waits in Spark's state store (with many open tickets, set the session's state store to RocksDB). A
stream whose rows stop coming keeps the last ones open: send heartbeats, rows with a key of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlock.functions import catalog as c


def _without(left: DataFrame, key: str, at: str, right: DataFrame, right_at: str, within_ms: int, lateness_ms: int) -> DataFrame:
    """Rows of `left` that no row of `right` with their key follows within the time; null keys are left out."""
    late = f"{lateness_ms} milliseconds"
    mine = left.where(F.col(key).isNotNull()).withWatermark(at, late)
    theirs = right.select(F.col(key).alias("_key"), F.col(right_at).alias("_at")).withWatermark("_at", late)
    bound = F.expr(f"INTERVAL '{within_ms / 1000}' SECOND")
    follows = (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col(at)) & (F.col("_at") <= F.col(at) + bound)
    return mine.join(theirs, follows, "leftOuter").where(F.col("_key").isNull()).drop("_key", "_at")


def abandoned_stream(decides: DataFrame, uses: DataFrame, ttl_ms: int = c.TICKET_MS, lateness_ms: int = c.TICKET_MS) -> DataFrame:
    """(ticket, issued, expires) of each ticket that was not used in its lifetime, once that is certain.

    Each such ticket gives one row. A use after the lifetime, or one that comes later than the lateness
    allows, gives and takes nothing. Rows without a ticket or a time are left out.
    """
    open_tickets = decides.select("ticket", "issued")
    lost = _without(open_tickets, "ticket", "issued", uses, "ts", ttl_ms, lateness_ms)
    return lost.withColumn("expires", F.col("issued") + F.expr(f"INTERVAL '{ttl_ms / 1000}' SECOND"))


def denied_offline_stream(actions: DataFrame, decides: DataFrame, key: str, wait_ms: int = c.TICKET_MS, lateness_ms: int = c.TICKET_MS) -> DataFrame:
    """Actions (key, ts, ...) that no decide (key, issued) has followed in time: denied, and shown as high
    risk. A decide that comes after that changes nothing; repeated actions are denied each."""
    lone = _without(actions, key, "ts", decides, "issued", wait_ms, lateness_ms)
    return lone.withColumns({"decision": F.lit("DENY"), "label": F.lit("high"), "findings": F.lit("Guard offline")})
