"""Requests as lines of JSON: decide requests, uses of tickets, and what is rejected.

Requests arrive as text files. Each line is an envelope that the service's front end wrote: when the
request arrived (ts_ms), its number (seq), the endpoint, and the body as it came. A body must be
JSON; nothing else is checked. A field that is missing or has another type than expected counts as
its default. Of repeated keys the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlock.functions import catalog
from airlock.functions.risk import service_columns


ENVELOPE = "ts_ms long, seq long, endpoint string, line string"
DECIDE, CONSUME = "decide", "consume"


def _opened(lines: DataFrame) -> DataFrame:
    read = lines.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")
    return read.select(F.timestamp_millis("ts_ms").alias("ts"), "seq", "endpoint", "line")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(ts, seq, endpoint, line) of every request in the text files under a path."""
    return _opened(spark.read.text(path))


def stream_requests(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream of the files."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _opened(reader.text(path))


def envelope(ts_ms: Column, seq: Column, endpoint: str, line: Column) -> Column:
    """A request as a line that read_requests reads."""
    return F.to_json(F.struct(ts_ms.alias("ts_ms"), seq.alias("seq"), F.lit(endpoint).alias("endpoint"), line.alias("line")))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with `v`, a variant, null where the line is not JSON."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.withColumn("v", F.try_parse_json(F.nullif(F.col(line), F.lit(""))))


def rejected(df: DataFrame) -> DataFrame:
    """Quarantine: no ticket, no event and no counter comes from these."""
    return df.where(F.col("v").isNull()).drop("v")


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("v").isNotNull())


def _inner(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_at(v: Column, path: str, default: str) -> Column:
    """A string field; the default also if it is of another type."""
    is_text = F.schema_of_variant(_inner(v, path)) == "STRING"
    return F.coalesce(F.when(is_text, F.try_variant_get(v, path, "string")), F.lit(default))


def array_length_at(v: Column, path: str) -> Column:
    is_array = F.schema_of_variant(_inner(v, path)).startswith("ARRAY")
    return F.coalesce(F.when(is_array, F.size(F.try_variant_get(v, path, "array<variant>"))), F.lit(0)).cast("long")


def normal_choice(choice: Column) -> Column:
    """ALLOW in any case allows; everything else, also nothing, denies."""
    return F.when(F.upper(F.coalesce(choice, F.lit("DENY"))) == "ALLOW", "ALLOW").otherwise("DENY")


def decide_fields(df: DataFrame, keep: list[str]) -> DataFrame:
    """What the service takes from a decide request: the preview's risk and the number of secrets."""
    read = df.select(*keep, string_at(F.col("v"), "$.meta.preview", "").alias("preview"), array_length_at(F.col("v"), "$.meta.secrets").alias("secrets"))
    return service_columns(read, "preview", [*keep, "secrets"])


def use_fields(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, string_at(F.col("v"), "$.ticket", "").alias("ticket"), normal_choice(string_at(F.col("v"), "$.choice", "DENY")).alias("choice"))


def ticket_meta(v: Column, risk: Column, preflight: Column, reason: Column) -> Column:
    """What a ticket remembers of its request: the request's own fields, as they came, with the
    service's risk, preflight and reason. A field that is no string is null."""
    text = lambda path: F.when(F.schema_of_variant(_inner(v, path)) == "STRING", F.try_variant_get(v, path, "string"))
    sent = F.to_json(_inner(v, "$.meta"))
    return F.struct(text("$.product").alias("product"), text("$.host").alias("host"), text("$.action").alias("action"), sent.alias("meta"), risk.alias("risk"), preflight.alias("preflight"), reason.alias("reason"))


def client_risk(v: Column) -> Column:
    """The sender's own score, null if it is no number."""
    return F.try_variant_get(v, "$.meta.risk", "int")


def ticket_id(*parts: Column) -> Column:
    """An id in the shape of a UUID that a replay of the same rows gives again."""
    h = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def expiry_ms(issued_ms: Column, ttl_ms: int = catalog.TICKET_MS) -> Column:
    return issued_ms + F.lit(ttl_ms).cast("long")


def request_struct(product: Column, host: Column, length: Column, preview: Column, secrets: Column, risk: Column) -> Column:
    meta = F.struct(length.alias("length"), preview.alias("preview"), secrets.alias("secrets"), risk.alias("risk"))
    return F.struct(product.alias("product"), host.alias("host"), F.lit(catalog.ACTION).alias("action"), meta.alias("meta"))


def pending(df: DataFrame) -> DataFrame:
    """Answers to decide requests: always ok and pending."""
    return df.withColumns({"ok": F.lit(True), "decision": F.lit("PENDING")})
