"""Single-use tickets: which uses are allowed, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.functions import catalog as c


def decide_uses(decides: DataFrame, uses: DataFrame, ttl: Column) -> DataFrame:
    """uses (ticket, ts, seq, choice, ...) with decision and reason.

    decides has one row (ticket, issued) for each ticket. Checked in this order: a ticket that was
    not issued yet is unknown, and so is one at no time (null); after issued + ttl it is expired; the first use that is neither uses
    the ticket up, whatever its choice; later ones are replays. The first use is found by a minimum
    for each ticket; it then joins the tickets, so the uses meet their tickets in one join each time.

    decides may also say which tickets are `used` already, and which were known `before` any of the
    uses, whatever their times.
    """
    have = set(decides.columns)
    known = decides.select("ticket", "issued", *(F.col(n) if n in have else F.lit(False).alias(n) for n in ("used", "before")))
    early = F.col("issued").isNull() | F.col("ts").isNull() | (~F.col("before") & (F.col("ts") < F.col("issued")))
    late = F.col("ts") > F.col("issued") + ttl
    live = uses.select("ticket", "ts", "seq").join(known.where(~F.col("used")), "ticket").where(~early & ~late)
    firsts = live.groupBy("ticket").agg(F.min(F.struct("ts", "seq")).alias("_first"))
    told = uses.join(known.join(firsts, "ticket", "left"), "ticket", "left")
    is_first = (F.col("ts") == F.col("_first.ts")) & (F.col("seq") == F.col("_first.seq"))
    reason = F.when(early, c.UNKNOWN).when(late, c.EXPIRED).when(~F.coalesce(is_first, F.lit(False)), c.REPLAY).when(F.col("choice") == "ALLOW", c.ALLOWED).otherwise(c.BLOCKED)
    told = told.withColumn("reason", reason).drop("_first", "issued", "used", "before")
    return told.withColumn("decision", F.when(F.col("reason") == c.ALLOWED, "ALLOW").otherwise("DENY"))


def answers(decided: DataFrame) -> DataFrame:
    """The response to each use."""
    return decided.select("seq", F.lit(True).alias("ok"), "decision", "reason")


def released(actions: DataFrame, decided: DataFrame) -> DataFrame:
    """Actions whose ticket was used and allowed."""
    return actions.join(decided.where(F.col("decision") == "ALLOW").select("ticket"), "ticket", "left_semi")


def denied_offline(actions: DataFrame, decides: DataFrame, key: str) -> DataFrame:
    """Actions for which no ticket was issued: denied, and shown as high risk."""
    lone = actions.join(decides.select(key), key, "left_anti")
    return lone.withColumns({"decision": F.lit("DENY"), "label": F.lit("high"), "findings": F.lit("Guard offline")})


def abandoned(decides: DataFrame, uses: DataFrame, as_of: Column, ttl: Column) -> DataFrame:
    """Tickets that were never used, and if they are expired as of a time."""
    return decides.join(uses.select("ticket"), "ticket", "left_anti").withColumn("expired", as_of > F.col("issued") + ttl)


def need_decision(clicks: DataFrame, released_keys: DataFrame, key: str, order: str) -> DataFrame:
    """Clicks without those that pass once: the first click on each released message."""
    first = clicks.join(released_keys.select(key), key, "left_semi").groupBy(key).agg(F.min(order).alias(order))
    return clicks.join(first, [key, order], "left_anti")


def with_policy(actions: DataFrame, policy: DataFrame, default_tier: str = "High") -> DataFrame:
    """Actions with the tier and reason of their tool. The policy is a table of constants (see
    catalog.POLICY); a larger one is joined without the hint."""
    small = policy if policy.count() > 10_000 else F.broadcast(policy)
    return actions.join(small, "tool", "left").withColumn("tier", F.coalesce("tier", F.lit(default_tier)))
