"""Scores, labels, reasons and the texts of a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlock.functions import catalog as c
from airlock.functions.scan import markers_text
from airlock.functions.text import measured


def message_score(length: Column, found: Column) -> Column:
    """The sender's score: both length rules add up."""
    score = F.lit(c.BASE_SCORE) + F.when(found, c.FOUND_SCORE).otherwise(0) + F.when(length > c.LONG, c.LONG_SCORE).otherwise(0) + F.when(length > c.LONGER, c.LONGER_SCORE).otherwise(0)
    return F.least(F.lit(c.MOST_SCORE), score)


def label(score: Column, high: int = c.HIGH, medium: int = c.MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def preview_score(n_bytes: Column, found: Column) -> Column:
    """The service's score: one length rule, in bytes."""
    longer = F.when(n_bytes > c.LONGER, c.LONG_SCORE + c.LONGER_SCORE).when(n_bytes > c.LONG, c.LONG_SCORE).otherwise(0)
    return F.least(F.lit(c.MOST_SCORE), F.lit(c.BASE_SCORE) + F.when(found, c.FOUND_SCORE).otherwise(0) + longer)


def preflight(score: Column, high: int = c.HIGH, medium: int = c.MEDIUM) -> Column:
    return F.when(score >= high, "WARN").when(score >= medium, "REVIEW").otherwise("ALLOW")


def reason(markers: Column, n_bytes: Column) -> Column:
    """Why the service scored as it did; `markers` joined, empty if none."""
    size = F.when(n_bytes > c.LONGER, F.concat(F.lit("Very large message ("), n_bytes.cast("string"), F.lit(" chars)"))).when(
        n_bytes > c.LONG, F.concat(F.lit("Large message ("), n_bytes.cast("string"), F.lit(" chars)"))
    )
    found = F.when(markers != "", F.concat(F.lit("Sensitive patterns: "), markers))
    return F.coalesce(F.nullif(F.concat_ws("; ", found, size), F.lit("")), F.lit("No issues detected"))


def service_columns(df, text: str, keep: list[str]):
    """df's `keep` columns with risk, preflight and reason of the text, which the service sees whole."""
    seen = df.select(*keep, F.lower(text).alias("_lower"), measured(F.col(text), "bytes").alias("_bytes"))
    marked = seen.withColumn("_markers", markers_text(F.col("_lower")))
    scored = marked.withColumn("risk", preview_score(F.col("_bytes"), F.col("_markers") != ""))
    return scored.select(*keep, "risk", preflight(F.col("risk")).alias("preflight"), reason(F.col("_markers"), F.col("_bytes")).alias("reason"))


def alert_needed(found: Column, label: Column) -> Column:
    return found | (label != "low")


def prompt_texts(found_text: Column, label: Column, prompt: Column, product: Column) -> dict[str, Column]:
    """Title, description, badge, button and line of a prompt; the first two only if it alerts."""
    found = found_text != ""
    alert = alert_needed(found, label)
    around = lambda text, said: F.concat(F.lit(said[0]), text, F.lit(said[1]))
    return {
        "alert": alert,
        "title": F.when(alert, F.when(found, c.TITLE_FOUND).otherwise(c.TITLE_LONG)),
        "description": F.when(alert, F.when(found, around(found_text, c.DETECTED)).otherwise(around(F.length(prompt).cast("string"), c.UNUSUAL))),
        "badge": F.when(label == "high", c.BADGES["high"]).when(label == "medium", c.BADGES["medium"]).otherwise(c.BADGES["low"]),
        "button": F.when(label == "high", c.BUTTON_HIGH).otherwise(c.BUTTON),
        "line": around(F.upper(product), c.SENDING),
    }
