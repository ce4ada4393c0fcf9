"""From request lines to tickets, answers and the audit log: the service's loop as joins.

`lines` are (ts, seq, endpoint, line) as the readers in sources.requests give them, in a batch or as
a stream. A line that is not JSON leaves no trace in what follows (see requests.rejected).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.functions.risk import service_columns
from airlock.operators.audit import consume_events, decide_events, log, startup
from airlock.operators.tickets import decide_uses
from airlock.sources import requests


def issued_tickets(lines: DataFrame) -> DataFrame:
    """(seq, issued, ticket, secrets, client_risk, risk, preflight, reason, meta) of every decide request.

    A ticket's id follows from its request's number, so a replay of the lines gives it again."""
    asked = requests.accepted(requests.parsed(lines.where(F.col("endpoint") == requests.DECIDE)))
    v = F.col("v")
    read = asked.select("seq", F.col("ts").alias("issued"), "v", requests.string_at(v, "$.meta.preview", "").alias("preview"), requests.array_length_at(v, "$.meta.secrets").alias("secrets"), requests.client_risk(v).alias("client_risk"))
    scored = service_columns(read, "preview", ["seq", "issued", "v", "secrets", "client_risk"])
    meta = requests.ticket_meta(v, F.col("risk"), F.col("preflight"), F.col("reason"))
    return scored.select("seq", "issued", requests.ticket_id(F.col("seq")).alias("ticket"), "secrets", "client_risk", "risk", "preflight", "reason", meta.alias("meta"))


def asked_uses(lines: DataFrame) -> DataFrame:
    """(seq, ts, ticket, choice) of every consume request."""
    used = requests.accepted(requests.parsed(lines.where(F.col("endpoint") == requests.CONSUME)))
    return requests.use_fields(used, ["seq", "ts"])


def served(lines: DataFrame, ttl: Column, opened: DataFrame | None = None) -> DataFrame:
    """The audit log of all requests: an event for each ticket issued and for each use asked, and one for
    the start of the service at the time in `opened` (one row, column ts), if given."""
    tickets = issued_tickets(lines)
    decided = decide_uses(tickets.select("ticket", "issued"), asked_uses(lines), ttl)
    events = (decide_events(tickets), consume_events(decided))
    return log(*events) if opened is None else log(startup(opened), *events)


def protocol_rows(lines: DataFrame) -> DataFrame:
    """(ticket, ts, seq, is_use, choice, risk, preflight, said, secrets) for streaming.tickets, of both endpoints."""
    nothing = {"risk": "int", "preflight": "string", "said": "string", "secrets": "long"}
    issued = issued_tickets(lines).select("ticket", F.col("issued").alias("ts"), "seq", F.lit(False).alias("is_use"), F.lit(None).cast("string").alias("choice"), "risk", "preflight", F.col("reason").alias("said"), "secrets")
    asked = asked_uses(lines).select("ticket", "ts", "seq", F.lit(True).alias("is_use"), "choice", *(F.lit(None).cast(kind).alias(n) for n, kind in nothing.items()))
    return issued.unionByName(asked)
