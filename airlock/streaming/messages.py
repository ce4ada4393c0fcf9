"""Messages scanned and counted as they arrive, with the columns of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlock.functions.risk import label, message_score
from airlock.functions.scan import findings_text
from airlock.functions.text import capped


def scan_stream(messages: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, findings, score and label of every message; stateless, so also good for a batch."""
    cut = messages.select(*keep, capped(F.col(text)).alias("_text"))
    found = cut.select(*keep, F.length("_text").alias("_length"), findings_text(F.col("_text")).alias("findings"))
    scored = found.select(*keep, "findings", message_score(F.col("_length"), F.col("findings") != "").alias("score"))
    return scored.withColumn("label", label(F.col("score")))
