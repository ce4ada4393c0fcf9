"""The registered queries: each applies operators to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlock.functions import catalog as c
from airlock.functions import risk, scan, text
from airlock.operators import audit, metrics, pages, service, tickets
from airlock.plans import fixtures
from airlock.sources import requests
from airlock.sources.tables import append, append_stream, shared_dir, stream, table
from airlock.streaming.joins import abandoned_stream, denied_offline_stream
from airlock.streaming.messages import scan_stream
from airlock.streaming.tickets import answer_stream, read_answers, read_counters, read_events, read_feed


def _cut(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, text.capped(F.col("msg")).alias("t"))


def _scored(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, length, score and label of messages."""
    measured = _cut(df, keys).withColumn("length", text.measured(F.col("t")))
    return measured.withColumn("score", risk.message_score(F.col("length"), scan.any_finding(F.col("t")))).withColumn("label", risk.label(F.col("score")))


def _found(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, the findings as a text, and score and label, for which the patterns aren't tried again."""
    found = _cut(df, keys).withColumn("findings", scan.findings_text(F.col("t")))
    return found.withColumn("score", risk.message_score(text.measured(F.col("t")), F.col("findings") != "")).withColumn("label", risk.label(F.col("score")))


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _cut(fixtures.documents(spark, d), ["doc_id"]).select("doc_id", scan.findings_text(t).alias("findings"), scan.findings_count(t).alias("n_findings"))


def scan_findings_conversations(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _cut(fixtures.messages(spark, d), ["msg_id"]).select("msg_id", scan.findings_text(t).alias("findings"), scan.findings_count(t).alias("n_findings"))


def scan_wide_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Findings where every space of a message is another sign that browsers count as white space."""
    wide = fixtures.pick(F.col("doc_id") % len(fixtures.WIDE), fixtures.WIDE)
    t = F.col("t")
    cut = _cut(fixtures.documents(spark, d).select("doc_id", F.replace("msg", F.lit(" "), wide).alias("msg")), ["doc_id"])
    return cut.select("doc_id", scan.findings_text(t).alias("findings"), scan.findings_count(t).alias("n_findings"))


def scan_exploded(spark: SparkSession, d: str) -> DataFrame:
    return scan.exploded(_cut(fixtures.documents(spark, d), ["doc_id"]), "doc_id", "t")


def scan_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    scored = _found(fixtures.documents(spark, d), ["doc_id"])
    product = fixtures.pick(F.col("doc_id") % 3, ("chatgpt", "claude", "web"))
    return metrics.incidence(scored.select(product.alias("product"), "label", F.filter(F.split("findings", ", "), lambda x: x != "").alias("findings")))


def marker_scan(spark: SparkSession, d: str) -> DataFrame:
    low = fixtures.documents(spark, d).select("doc_id", F.lower("msg").alias("t"))
    return low.select("doc_id", scan.markers_text(F.col("t")).alias("markers"), scan.markers_count(F.col("t")).alias("n_markers"))


def risk_message(spark: SparkSession, d: str) -> DataFrame:
    return _scored(fixtures.documents(spark, d), ["doc_id"]).select("doc_id", "length", "score", "label")


def risk_preview(spark: SparkSession, d: str) -> DataFrame:
    seen = fixtures.documents(spark, d).select("doc_id", text.preview(F.col("msg")).alias("p"))
    return risk.service_columns(seen, "p", ["doc_id"])


def risk_full_text_service(spark: SparkSession, d: str) -> DataFrame:
    return risk.service_columns(fixtures.documents(spark, d), "msg", ["doc_id"])


def alert_texts(spark: SparkSession, d: str) -> DataFrame:
    scored = _found(fixtures.documents(spark, d), ["doc_id"]).withColumn("prompt", F.substring("t", 1, c.PROMPT_CHARS))
    product = fixtures.pick(F.col("doc_id") % 3, ("chatgpt", "claude", "web"))
    texts = risk.prompt_texts(F.col("findings"), F.col("label"), F.col("prompt"), product)
    return scored.select("doc_id", *(x.alias(n) for n, x in texts.items()), text.shown(F.col("prompt")).alias("shown"))


def score_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(fixtures.documents(spark, d), ["doc_id"]).groupBy("label", "score").agg(F.count("*").alias("n"))


def agreement_matrix(spark: SparkSession, d: str) -> DataFrame:
    both = fixtures.documents(spark, d)
    sender = _scored(both, ["doc_id", "msg"])
    return metrics.agreement(risk.service_columns(sender.withColumn("p", text.preview(F.col("msg"))), "p", ["doc_id", "score"]))


def product_of_host(spark: SparkSession, d: str) -> DataFrame:
    hosts = fixtures.pages(spark, d).select("page_id", pages.host(F.col("url")).alias("host"))
    return hosts.withColumn("product", pages.product(F.col("host")))


def protected_pages(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pages(spark, d).where(pages.is_protected(F.col("url"))).select("page_id", "url")


def badge_pages(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pages(spark, d).where(pages.refreshes_badge(F.col("url"), F.col("status"))).select("page_id", "url")


def send_clicks(spark: SparkSession, d: str) -> DataFrame:
    send = pages.is_send(*(F.col(x) for x in ("tag", "role", "aria_label", "title", "inner_text", "test_id")))
    return fixtures.clicks(spark, d).select("event_id", send.alias("is_send"))


def compose_choice(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.drafts(spark, d).select("msg_id", text.capped(text.chosen_text(F.col("rich"), F.col("plain"), F.col("editor"))).alias("text"))


def base_url_norm(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pages(spark, d).select("page_id", pages.without_slash(F.col("url")).alias("base_url"))


def ticket_shape(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("event_id") % 4, F.concat(F.lit("t"), F.col("event_id").cast("string"))
    shapes = [F.when(k == 0, t).otherwise(""), F.when(k == 1, t), F.when(k == 2, t)]
    return table(spark, d, "events").select("event_id", pages.ticket_of_response(*shapes).alias("ticket"))


def _decide_requests(spark: SparkSession, d: str) -> DataFrame:
    said = _scored(fixtures.messages(spark, d).where(F.col("role") == "user"), ["msg_id", "conv_id"])
    host = fixtures.pick(F.col("conv_id") % 3, ("chatgpt.com", "claude.ai", "example.org"))
    named = said.withColumn("host", host).withColumn("product", pages.product(F.col("host")))
    request = requests.request_struct(F.col("product"), F.col("host"), F.col("length"), text.preview(F.col("t")), scan.findings(F.col("t")), F.col("score"))
    sent = named.select("msg_id", request.alias("r")).select("msg_id", "r.product", "r.host", "r.action", "r.meta.length", F.col("r.meta.preview").alias("p"), F.size("r.meta.secrets").alias("secrets"), F.col("r.meta.risk").alias("client_risk"))
    keep = ["msg_id", "product", "host", "action", "length", "secrets", "client_risk"]
    issued = F.col("msg_id") * 1000 + 1704067200000
    answered = requests.pending(risk.service_columns(sent, "p", keep))
    return answered.withColumns({"ticket": requests.ticket_id(F.col("msg_id")), "exp_ms": requests.expiry_ms(issued)})


def secrets_caught(spark: SparkSession, d: str) -> DataFrame:
    return _decide_requests(spark, d).agg(F.count_if(F.col("secrets") > 0).alias("secrets_caught"))


def request_intake(spark: SparkSession, d: str) -> DataFrame:
    good = requests.accepted(requests.parsed(fixtures.request_lines(spark, d)))
    asked = requests.decide_fields(good, ["msg_id", "v"])
    return requests.use_fields(asked, ["msg_id", "secrets", "risk", "preflight", "reason"])


def request_rejects(spark: SparkSession, d: str) -> DataFrame:
    return requests.rejected(requests.parsed(fixtures.request_lines(spark, d)))


def ticket_decisions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.decided(spark, d).select("seq", "ticket", "choice", "decision", "reason")


def ticket_answers(spark: SparkSession, d: str) -> DataFrame:
    return tickets.answers(fixtures.decided(spark, d))


def _used_actions(actions: DataFrame) -> DataFrame:
    choice = requests.normal_choice(F.col("choice"))
    return actions.where(F.col("ticket").isNotNull() & F.col("used")).select("ticket", choice.alias("decision"))


def released_actions(spark: SparkSession, d: str) -> DataFrame:
    actions = fixtures.actions(spark, d)
    return tickets.released(actions, _used_actions(actions)).select("msg_id", "ticket")


def offline_denied(spark: SparkSession, d: str) -> DataFrame:
    actions = fixtures.actions(spark, d)
    return tickets.denied_offline(actions, actions.where(F.col("ticket").isNotNull()), "msg_id").select("msg_id", "decision", "label", "findings")


def abandoned_tickets(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").agg(F.max("ts").alias("now"))
    issued = fixtures.decides(spark, d).crossJoin(last)  # one row
    return tickets.abandoned(issued, fixtures.uses(spark, d), F.col("now"), fixtures.ttl()).select("ticket", "expired")


def bypass_clicks(spark: SparkSession, d: str) -> DataFrame:
    actions = fixtures.actions(spark, d)
    released = tickets.released(actions, _used_actions(actions))
    clicks = released.select("msg_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("click"))
    return tickets.need_decision(clicks, released, "msg_id", "click")


def _written(events: DataFrame) -> DataFrame:
    """Numbers that not every event has, as text: null then looks the same to every reader."""
    return events.withColumns({n: F.col(n).cast("string") for n in ("risk", "secrets", "port")})


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    return _written(fixtures.audit_log(spark, d))


def audit_feed(spark: SparkSession, d: str) -> DataFrame:
    return _written(audit.feed(fixtures.audit_log(spark, d)))


def audit_lines(spark: SparkSession, d: str) -> DataFrame:
    return audit.feed(fixtures.audit_log(spark, d)).select("seq", audit.line().alias("line"))


def feed_json(spark: SparkSession, d: str) -> DataFrame:
    """The feed as one JSON array, read back."""
    return _written(audit.feed_events(audit.feed_json(audit.feed(fixtures.audit_log(spark, d)))))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(fixtures.audit_log(spark, d))


def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dashboard(audit.feed(fixtures.audit_log(spark, d)))


def feed_vs_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.feed_against_counters(fixtures.audit_log(spark, d), audit.feed(fixtures.audit_log(spark, d)))


def running_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running(fixtures.audit_log(spark, d)).select("seq", "kind", "position", *metrics.COUNTERS)


def feed_depth(spark: SparkSession, d: str) -> DataFrame:
    return metrics.feed_depth(fixtures.audit_log(spark, d))


def policy_join(spark: SparkSession, d: str) -> DataFrame:
    tool = F.coalesce(*(F.when(F.col("event_type") == e, t) for e, t in fixtures.TOOLS.items()))
    policy = spark.createDataFrame(list(c.POLICY), "tool string, tier string, reason string")
    return tickets.with_policy(table(spark, d, "events").select("event_id", tool.alias("tool")), policy)


def user_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of every user who has asked for a ticket; one without any use has none yet, shown as 0."""
    log = fixtures.audit_log(spark, d).withColumn("user", F.substring_index("ticket", "-", 1))
    asked = log.where("kind = 'DECIDE'").groupBy("user").agg(F.count_if(F.col("secrets") > 0).alias("secrets_caught"))
    used = log.where("kind = 'CONSUME'").groupBy("user").agg(*metrics.counts())
    return metrics.displayed(asked.join(used, "user", "left"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/airlock-{name}-{uuid.uuid4().hex}"


def _request_files(spark: SparkSession, d: str) -> str:
    """The request log as text files in the shared folder. A stream takes files as they were finished,
    so what belongs to one message is in one file."""
    path = _scratch(spark, "requests")
    number = F.get_json_object("value", "$.seq").cast("long")
    fixtures.request_log(spark, d).repartitionByRange(4, F.floor(number / 4)).sortWithinPartitions(number).write.text(path)
    return path


def _ticket_life():
    return F.expr(f"INTERVAL '{c.TICKET_MS // 1000}' SECOND")


def ticket_meta(spark: SparkSession, d: str) -> DataFrame:
    issued = service.issued_tickets(requests.read_requests(spark, _request_files(spark, d)))
    return issued.select("seq", "ticket", "meta.product", "meta.host", "meta.action", F.get_json_object("meta.meta", "$.length").cast("int").alias("length"), "meta.risk", "meta.preflight", "meta.reason")


def meta_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Sender's and service's score, both as the tickets remember them."""
    issued = service.issued_tickets(requests.read_requests(spark, _request_files(spark, d)))
    sender = F.get_json_object("meta.meta", "$.risk").cast("int")
    return metrics.agreement(issued.select(sender.alias("score"), F.col("meta.risk").alias("risk")))


def request_to_audit(spark: SparkSession, d: str) -> DataFrame:
    """Request files to the audit table, and the table read back."""
    path = _scratch(spark, "audit")
    append(service.served(requests.read_requests(spark, _request_files(spark, d)), _ticket_life()), path)
    return _written(spark.read.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _served(spark: SparkSession, d: str) -> str:
    """Where the tables of the service are, after the request files as a stream of several batches."""
    path, lines = _scratch(spark, "service"), requests.stream_requests(spark, _request_files(spark, d), files_per_batch=1)
    answer_stream(service.protocol_rows(lines), path, f"{path}/checkpoint", opened=fixtures.REQUEST_START).awaitTermination()
    return path


def stream_requests(spark: SparkSession, d: str) -> DataFrame:
    """The same request files as a stream of several batches: the answers to all uses."""
    return read_answers(spark, _served(spark, d)).select("seq", "ticket", "choice", "decision", "reason")


def stream_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit log that the stream of request files leaves."""
    return _written(read_events(spark, _served(spark, d)).drop("batch")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _streamed(df: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the input that is there, by way of a table in the shared folder."""
    path = _scratch(df.sparkSession, name)
    append_stream(df, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    said = fixtures.planted(stream(spark, d, "documents"), F.col("doc_id"), ["doc_id"])
    return _streamed(scan_stream(said, ["doc_id"], "msg"), "scan")


def _answered(spark: SparkSession, d: str) -> str:
    """Where the tables of the service are, after the stream of events."""
    named = fixtures._ticketed(stream(spark, d, "events")).withColumn("is_use", ~F.col("event_type").isin("view", "signup"))
    choice = F.when(F.col("is_use"), F.when(F.col("event_type") == "purchase", "ALLOW").otherwise("DENY"))
    said = {"risk": F.lit(c.BASE_SCORE), "preflight": F.lit("ALLOW"), "said": F.lit("No issues detected"), "secrets": (F.col("event_id") % 3).cast("long")}
    rows = named.select("ticket", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "is_use", choice.alias("choice"), *(x.alias(n) for n, x in said.items()))
    opened = table(spark, d, "events").agg(F.min("ts").cast("timestamp")).first()[0]
    ttl_ms, path = fixtures.TTL_HOURS * 3_600_000, _scratch(spark, "tickets")
    answer_stream(rows, path, f"{path}/checkpoint", ttl_ms, retention_ms=8 * ttl_ms, opened=opened).awaitTermination()
    return path


def stream_tickets(spark: SparkSession, d: str) -> DataFrame:
    return read_answers(spark, _answered(spark, d)).select("seq", "ticket", "choice", "decision", "reason")


def stream_stats(spark: SparkSession, d: str) -> DataFrame:
    """The five counters that the stream of events has kept."""
    return read_counters(spark, _answered(spark, d))


def stream_feed(spark: SparkSession, d: str) -> DataFrame:
    """The feed that the stream of events has kept."""
    return _written(read_feed(spark, _answered(spark, d))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _steps(df: DataFrame, path: str, files: int) -> DataFrame:
    """What in_arrival_order has written for df, as a stream of one step a batch."""
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _event_logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Decides and uses of the events as two streams of files, whose rows come hours late and in disorder."""
    path, late_ms = _scratch(spark, "logs"), fixtures.LATE_HOURS * 3_600_000
    end = table(spark, d, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 30 DAY")).alias("ts"))
    decides = fixtures.decides(spark, d).select("ticket", F.col("issued").cast("timestamp").alias("issued"), "seq")
    uses = fixtures.uses(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    beat = end.select(F.lit("heartbeat").alias("ticket"), "ts", F.lit(-1).cast("long").alias("seq"))
    asked = fixtures.in_arrival_order(decides, "issued", F.col("seq"), f"{path}/decides", late_ms, beat.withColumnRenamed("ts", "issued"))
    used = fixtures.in_arrival_order(uses, "ts", F.col("seq"), f"{path}/uses", late_ms, beat.withColumn("choice", F.lit("DENY")))
    return _steps(decides, f"{path}/decides", asked), _steps(uses, f"{path}/uses", used)


def stream_two_logs(spark: SparkSession, d: str) -> DataFrame:
    """Answers where decides and uses come as two streams, uses often before the decide they need."""
    decides, uses = _event_logs(spark, d)
    rows = decides.select("ticket", F.col("issued").alias("ts"), "seq", F.lit(False).alias("is_use"), F.lit(None).cast("string").alias("choice"))
    rows = rows.unionByName(uses.withColumn("is_use", F.lit(True)))
    ttl_ms, path = fixtures.TTL_HOURS * 3_600_000, _scratch(spark, "tickets")
    answer_stream(rows, path, f"{path}/checkpoint", ttl_ms, retention_ms=8 * ttl_ms, wait_ms=fixtures.LATE_HOURS * 3_600_000).awaitTermination()
    return read_answers(spark, path).select("seq", "ticket", "choice", "decision", "reason")


def stream_abandoned(spark: SparkSession, d: str) -> DataFrame:
    """Tickets as they expire unused."""
    decides, uses = _event_logs(spark, d)
    hour = 3_600_000
    lost = abandoned_stream(decides, uses, fixtures.TTL_HOURS * hour, fixtures.LATE_HOURS * hour)
    return _streamed(lost, "abandoned").select("ticket", F.col("issued").cast("timestamp_ntz").alias("issued"), F.col("expires").cast("timestamp_ntz").alias("expires"))


def stream_offline(spark: SparkSession, d: str) -> DataFrame:
    """Actions without a ticket, denied when none can come any more: a message each second, its ticket
    up to half a minute later, both logs up to a minute late."""
    path, at = _scratch(spark, "logs"), F.timestamp_millis(F.col("msg_id") * 1000 + fixtures.REQUEST_START_MS)
    actions = fixtures.actions(spark, d).select("msg_id", at.alias("ts"), "ticket")
    decides = actions.where("ticket is not null").select("msg_id", (F.col("ts") + F.make_dt_interval(secs=F.col("msg_id") % 30)).alias("issued"))
    beat = actions.agg(F.lit(-1).cast("long").alias("msg_id"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    said = actions.drop("ticket")
    acted = fixtures.in_arrival_order(said, "ts", F.col("msg_id"), f"{path}/actions", 60_000, beat)
    asked = fixtures.in_arrival_order(decides, "issued", F.col("msg_id") + 1, f"{path}/decides", 60_000, beat.withColumnRenamed("ts", "issued"))
    lone = denied_offline_stream(_steps(said, f"{path}/actions", acted), _steps(decides, f"{path}/decides", asked), "msg_id", wait_ms=30_000, lateness_ms=60_000)
    return _streamed(lone, "offline").select("msg_id", "decision", "label", "findings")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.lstrip("_"): f
    for f in (
        scan_findings, scan_findings_conversations, scan_wide_spaces, scan_exploded, scan_pattern_counts, marker_scan, risk_message, risk_preview,
        risk_full_text_service, alert_texts, score_label_counts, agreement_matrix, product_of_host, protected_pages, badge_pages,
        send_clicks, compose_choice, base_url_norm, ticket_shape, _decide_requests, secrets_caught, request_intake, request_rejects,
        ticket_decisions, ticket_answers, released_actions, offline_denied, abandoned_tickets, bypass_clicks, audit_log, audit_feed, audit_lines,
        feed_json, user_counters, ticket_meta, meta_agreement, request_to_audit, stream_requests, stats, dashboard_metrics, feed_vs_counters, running_counters, feed_depth, policy_join, stream_scan, stream_tickets,
        stream_stats, stream_audit, stream_feed, stream_two_logs, stream_abandoned, stream_offline,
    )
}
