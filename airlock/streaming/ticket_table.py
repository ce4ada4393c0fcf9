"""The tickets that a stream remembers, as parts that are added and merged, never rewritten whole.

A batch adds a part with what it has learnt: tickets that were issued, and tickets that were used up. A
part is split into buckets by the ticket's hash, so a batch reads the buckets of its own tickets only.
What is known of a ticket is the earliest time of issue and whether any row says used, so parts can be
merged in any order. Parts are merged when the newer ones together are as large as the one before: a row
is rewritten about as often as the remembered tickets can be halved to the size of a batch, so what
a batch writes grows with its own rows. Parts whose rows are all forgotten are dropped unread.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from airlock.functions import catalog as c
from airlock.streaming.commits import add, of_batch

#: A row of a part: `at` is the time of the issue or of the use.
ROW = "ticket string, issued timestamp, used boolean, at timestamp"
PARTS = "array<struct<version: long, rows: long, newest: timestamp>>"
BUCKETS = 16


@dataclass
class TicketTable:
    """`parts`, oldest first, are (version, rows, newest), as the manifest holds them; rows whose time is
    `horizon` or earlier are forgotten."""

    spark: SparkSession
    path: str
    parts: list[Row]
    horizon: dt.datetime | None
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        if self.horizon is not None:
            self.parts = [p for p in self.parts if p["newest"] > self.horizon]

    def bucket(self):
        return F.pmod(F.xxhash64("ticket"), F.lit(self.buckets)).cast("int")

    def _rows(self, parts: list[Row]) -> DataFrame:
        rows = None
        for p in parts:
            part = of_batch(self.spark, self.path, "tickets", f"{ROW}, bucket int", p["version"])
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self.spark.createDataFrame([], f"{ROW}, bucket int")
        return rows if self.horizon is None else rows.where(F.col("at") > F.lit(self.horizon))

    def known(self, tickets: DataFrame, buckets: list[int]) -> DataFrame:
        """(ticket, issued, used) of those of the tickets (one row each) that are remembered."""
        mine = self._rows(self.parts)
        if len(buckets) < self.buckets:
            mine = mine.where(F.col("bucket").isin(buckets))
        mine = mine.join(tickets.select("ticket"), "ticket", "left_semi")
        return mine.groupBy("ticket").agg(F.min("issued").alias("issued"), F.max("used").alias("used")).where("issued is not null")

    def extended(self, number: int, learnt: DataFrame, rows: int, newest: dt.datetime) -> tuple[list[tuple], list[int]]:
        """Writes a batch's part, with those that are merged into it. Returns the parts after that, and
        the versions that are no longer among them."""
        kept, size = list(self.parts), rows
        while kept and kept[-1]["rows"] <= size:
            size += kept.pop()["rows"]
        old = self.parts[len(kept) :]
        if old:
            both = self._rows(old).select("ticket", "issued", "used", "at").unionByName(learnt)
            learnt = both.groupBy("ticket").agg(F.min("issued").alias("issued"), F.max("used").alias("used"), F.max("at").alias("at"))
        dealt = learnt.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket")
        add(dealt, self.path, "tickets", number, "bucket")
        newest = max([newest, *(p["newest"] for p in old)])
        after = [(p["version"], p["rows"], p["newest"]) for p in kept] + [(number, size, newest)]
        return after, [p["version"] for p in old]


def _issue():
    return (F.col("kind") == "DECIDE") & F.col("ts").isNotNull()


def _spent():
    return (F.col("kind") == "CONSUME") & F.col("reason").isin(c.ALLOWED, c.BLOCKED) & F.col("ts").isNotNull()


def learnt_from(events: DataFrame) -> DataFrame:
    """What the events of a batch say of tickets; without a time they say nothing."""
    issued = F.when(_issue(), F.col("ts"))
    return events.where(_issue() | _spent()).select("ticket", issued.alias("issued"), _spent().alias("used"), F.col("ts").alias("at"))


def learnt_sums() -> list[Column]:
    """How many rows learnt_from gives, and their newest time, as aggregates over the events."""
    tells = _issue() | _spent()
    return [F.count_if(tells).alias("rows"), F.max(F.when(tells, F.col("ts"))).alias("newest")]
