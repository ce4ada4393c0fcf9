"""Counters: in total, over the feed, and as of any moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlock.functions import catalog as c
from airlock.sources.tables import kept

COUNTERS = ("total", "allowed", "denied", "replay_blocked")


def _flags() -> dict[str, Column]:
    use = F.col("kind") == "CONSUME"
    return {
        "total": use,
        "allowed": use & (F.col("decision") == "ALLOW"),
        "denied": use & (F.col("decision") == "DENY"),
        "replay_blocked": use & (F.col("reason") == c.REPLAY),
    }


def counts() -> list[Column]:
    """The counters of uses as aggregates."""
    return [F.count_if(flag).alias(name) for name, flag in _flags().items()]


def counters(events: DataFrame, *more: Column) -> DataFrame:
    """One row: uses, and how they were decided; and decide requests with a secret. And `more` aggregates."""
    secret = (F.col("kind") == "DECIDE") & (F.col("secrets") > 0)
    return events.agg(*counts(), F.count_if(secret).alias("secrets_caught"), *more)


def dashboard(feed: DataFrame) -> DataFrame:
    """The counts that a display takes from the feed's rows."""
    return feed.where(F.col("kind") == "CONSUME").agg(*counts())


def feed_against_counters(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Both, and how many uses the feed no longer shows. Each side is one row."""
    shown = dashboard(feed).select(*(F.col(n).alias(f"feed_{n}") for n in COUNTERS))
    both = counters(events).select(*COUNTERS).crossJoin(shown)
    return both.select("*", *((F.col(n) - F.col(f"feed_{n}")).alias(f"missing_{n}") for n in COUNTERS))


def displayed(stats: DataFrame) -> DataFrame:
    """stats with all counters: one that is missing, as a value or as a column, is shown as 0."""
    have = set(stats.columns)
    shown = {n: F.coalesce(F.col(n), F.lit(0)).cast("long") if n in have else F.lit(0).cast("long") for n in (*COUNTERS, "secrets_caught")}
    return stats.withColumns(shown)


_IN_PART = (1 << 33) - 1


def _counted(events: DataFrame, parts: int | None = None) -> DataFrame:
    """running(), with the part of the log that an event is in and its place there (from 0)."""
    flagged = events.select("ts", "seq", "kind", *(F.coalesce(f, F.lit(False)).cast("long").alias(n) for n, f in _flags().items()))
    dealt = flagged.repartitionByRange(parts, "ts", "seq").sortWithinPartitions("ts", "seq") if parts else flagged.orderBy("ts", "seq")
    rows = kept(dealt.withColumn("_row", F.monotonically_increasing_id()), "log")
    cut = rows.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(_IN_PART)})
    names = ("position", *COUNTERS)
    totals = cut.groupBy("_part").agg(F.count("*").alias("position"), *(F.sum(n).alias(n) for n in COUNTERS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    base = totals.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut.select("ts", "seq", "kind", "_part", "_at", (F.col("_at") + 1).alias("position"), *(F.sum(n).over(inside).alias(n) for n in COUNTERS))
    return sums.join(F.broadcast(base), "_part").select("ts", "seq", "kind", "_part", "_at", *((F.col(n) + F.col(f"_{n}")).alias(n) for n in names))


def running(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Each event with its position in the log (from 1) and the counters as of it.

    Two levels: sums inside parts of the log, plus the totals of all earlier parts. The parts are those
    of one sort by time and number, so they hold about as many events each, also where a burst has them
    all at one instant. Events without a time come first.
    """
    return _counted(events).drop("_part", "_at")


def feed_depth(events: DataFrame, rows: int = c.FEED_ROWS, parts: int | None = None) -> DataFrame:
    """As of each event: how many rows the feed has and what a display counts in them.

    A feed of the last rows is the running counters less those of `rows` events ago. Those are found in
    the event's own part of the log, by a shift; only the first `rows` events of each part look them up
    by position.
    """
    now = kept(_counted(events, parts), "running")
    inside = Window.partitionBy("_part").orderBy("_at")
    shifted = now.select("seq", "kind", "position", "_at", *COUNTERS, *(F.lag(n, rows).over(inside).alias(f"_{n}") for n in COUNTERS))
    far = now.where(F.col("_at") < rows).select((F.col("position") - rows).alias("position"))
    past = now.join(far, "position", "left_semi").select((F.col("position") + rows).alias("position"), *(F.col(n).alias(f"_{n}") for n in COUNTERS))
    early = shifted.where(F.col("_at") < rows).drop(*(f"_{n}" for n in COUNTERS)).join(past, "position", "left")
    both = shifted.where(F.col("_at") >= rows).unionByName(early)
    return both.select("seq", "kind", F.least("position", F.lit(rows)).alias("depth"), *((F.col(n) - F.coalesce(f"_{n}", F.lit(0))).alias(f"feed_{n}") for n in COUNTERS))


def incidence(scored: DataFrame) -> DataFrame:
    """(product, label, finding, n) from rows with an array `findings`; null for rows without one."""
    return scored.select("product", "label", F.explode_outer("findings").alias("finding")).groupBy("product", "label", "finding").agg(F.count("*").alias("n"))


def agreement(scored: DataFrame) -> DataFrame:
    """How often sender and service agree on a message: score and risk of both, and if both are high."""
    high = lambda x: F.col(x) >= c.HIGH
    return scored.groupBy("score", "risk").agg(F.count("*").alias("n")).withColumn("agree", high("score") == high("risk"))
