"""The same queries as SQL for DuckDB, written independently of the DataFrame code."""

from __future__ import annotations

from airlock.functions import catalog as c
from airlock.functions.dialect import translated
from airlock.plans.fixtures import OFFSETS, PLANTS, REQUEST_START_MS, WIDE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(index: str, values: tuple) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {_q(v) if isinstance(v, str) else v}" for i, v in enumerate(values)) + " END"


def _planted(source: str, key: str, keep: str) -> str:
    off, plant = _case(f"CAST(floor({key} / 14) AS BIGINT) % 4", OFFSETS), _case(f"{key} % 14", PLANTS)
    return f"SELECT {keep}, substr(text, 1, off) || ' ' || plant || ' ' || substr(text, off + 1) AS msg FROM (SELECT *, {off} AS off, {plant} AS plant FROM {source})"


_DOCS = f"docs AS ({_planted('documents', 'doc_id', 'doc_id')})"
_MESSAGES = f"messages AS ({_planted('(SELECT *, conv_id * 1000 + turn AS msg_id FROM conversations)', 'msg_id', 'msg_id, conv_id, role')})"
_HITS = [f"CASE WHEN regexp_matches(t, {_q(translated(rx, 're2'))}) THEN {_q(name)} END" for name, rx in c.PATTERNS]
_FINDINGS = f"concat_ws(', ', {', '.join(_HITS)})"
_N_FINDINGS = "(" + " + ".join(f"regexp_matches(t, {_q(translated(rx, 're2'))})::INT" for _, rx in c.PATTERNS) + ")"
_MARKERS = "concat_ws(', ', " + ", ".join(f"CASE WHEN contains(low, {_q(m)}) THEN {_q(m)} END" for m in c.MARKERS) + ")"
_SCORE = "least(100, 10 + CASE WHEN findings <> '' THEN 75 ELSE 0 END + CASE WHEN length > 2500 THEN 15 ELSE 0 END + CASE WHEN length > 5000 THEN 10 ELSE 0 END)"
_LABEL = "CASE WHEN score >= 85 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END"


def _sender(source: str, keys: str) -> str:
    """sent: keys, t, findings, length, score, label."""
    return f"""cut AS (SELECT {keys}, substr(msg, 1, 6000) AS t FROM {source}),
found AS (SELECT *, {_FINDINGS} AS findings, length(t)::INT AS length FROM cut),
rated AS (SELECT *, {_SCORE} AS score FROM found),
sent AS (SELECT *, {_LABEL} AS label FROM rated)"""


def _service(source: str, text: str, keys: str) -> str:
    """served: keys, risk, preflight, reason."""
    return f"""seen AS (SELECT {keys}, lower({text}) AS low, strlen({text}) AS b FROM {source}),
marked AS (SELECT *, {_MARKERS} AS m FROM seen),
risked AS (SELECT *, least(100, 10 + CASE WHEN m <> '' THEN 75 ELSE 0 END + CASE WHEN b > 5000 THEN 25 WHEN b > 2500 THEN 15 ELSE 0 END)::INT AS risk FROM marked),
served AS (SELECT {keys}, risk, CASE WHEN risk >= 85 THEN 'WARN' WHEN risk >= 50 THEN 'REVIEW' ELSE 'ALLOW' END AS preflight,
  coalesce(nullif(concat_ws('; ', CASE WHEN m <> '' THEN 'Sensitive patterns: ' || m END,
    CASE WHEN b > 5000 THEN 'Very large message (' || b || ' chars)' WHEN b > 2500 THEN 'Large message (' || b || ' chars)' END), ''), 'No issues detected') AS reason FROM risked)"""


_PAGES = """pages_at AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'https://chatgpt.com/c/' || page_id WHEN 1 THEN 'https://chat.openai.com/c/' || page_id
  WHEN 2 THEN 'https://claude.ai/chat/' || page_id WHEN 3 THEN 'http://claude.ai/chat/' || page_id WHEN 4 THEN 'https://www.chatgpt.com/'
  WHEN 5 THEN 'https://platform.openai.com/docs' WHEN 6 THEN 'https://claudette.example.org/' ELSE url END AS url,
  CASE WHEN page_id % 5 = 4 THEN 'loading' ELSE 'complete' END AS status FROM pages)"""
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_PRODUCT = "CASE WHEN contains(host, 'chatgpt') OR contains(host, 'openai') THEN 'chatgpt' WHEN contains(host, 'claude') THEN 'claude' ELSE 'web' END"
_PRODUCT_OF_DOC = _case("doc_id % 3", ("chatgpt", "claude", "web"))

_TICKETS = """e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS ticket FROM events),
d AS (SELECT ticket, min(ts) AS issued, arg_min(event_id, (ts, event_id)) AS seq FROM e WHERE event_type IN ('view', 'signup') GROUP BY ticket),
u AS (SELECT ticket, ts, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'ALLOW' ELSE 'DENY' END AS choice FROM e WHERE event_type NOT IN ('view', 'signup')),
j AS (SELECT u.*, CASE WHEN d.ticket IS NULL OR u.ts < d.issued THEN 'unknown ticket' WHEN u.ts > d.issued + INTERVAL 6 HOUR THEN 'expired ticket' ELSE 'live' END AS st
      FROM u LEFT JOIN d USING (ticket)),
r AS (SELECT seq, ts, ticket, choice, CASE WHEN st <> 'live' THEN st WHEN row_number() OVER (PARTITION BY ticket, st ORDER BY ts, seq) > 1 THEN 'replay blocked'
      WHEN choice = 'ALLOW' THEN 'user allowed' ELSE 'user blocked' END AS reason FROM j),
decided AS (SELECT *, CASE WHEN reason = 'user allowed' THEN 'ALLOW' ELSE 'DENY' END AS decision FROM r)"""
_LOG = f"""{_TICKETS},
log AS (
  SELECT min(ts) AS ts, -1::BIGINT AS seq, 'STARTUP' AS kind, NULL::VARCHAR AS ticket, NULL::INT AS risk, NULL::VARCHAR AS preflight, NULL::VARCHAR AS reason,
         NULL::BIGINT AS secrets, NULL::VARCHAR AS decision, NULL::VARCHAR AS choice, 'audit log opened' AS message, {c.PORT}::INT AS port FROM events
  UNION ALL SELECT issued, seq, 'DECIDE', ticket, 10, 'ALLOW', 'No issues detected', seq % 3, NULL, NULL, NULL, NULL FROM d
  UNION ALL SELECT ts, seq, 'CONSUME', ticket, NULL, NULL, reason, NULL, decision, choice, NULL, NULL FROM decided),
feed AS (SELECT * FROM log ORDER BY ts DESC, seq DESC LIMIT 500)"""

_WRITTEN = "* REPLACE (risk::VARCHAR AS risk, secrets::VARCHAR AS secrets, port::VARCHAR AS port)"


def _counts(source: str, prefix: str = "") -> str:
    use = "kind = 'CONSUME'"
    return f"""SELECT count(*) FILTER ({use}) AS {prefix}total, count(*) FILTER ({use} AND decision = 'ALLOW') AS {prefix}allowed,
  count(*) FILTER ({use} AND decision = 'DENY') AS {prefix}denied, count(*) FILTER ({use} AND reason = 'replay blocked') AS {prefix}replay_blocked FROM {source}"""


def _over(frame: str, prefix: str = "") -> str:
    names = {"total": "true", "allowed": "decision = 'ALLOW'", "denied": "decision = 'DENY'", "replay_blocked": "reason = 'replay blocked'"}
    return ", ".join(f"sum(CASE WHEN kind = 'CONSUME' AND {w} THEN 1 ELSE 0 END) OVER ({frame})::BIGINT AS {prefix}{n}" for n, w in names.items())


_ACTIONS = """actions AS (SELECT m AS msg_id, CASE WHEN m % 5 <> 0 THEN md5('t' || m) END AS ticket,
  CASE m % 7 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'allow' WHEN 2 THEN 'DENY' WHEN 4 THEN 'maybe' END AS choice, m % 7 < 5 AS used
  FROM (SELECT conv_id * 1000 + turn AS m FROM conversations WHERE role = 'user')),
out AS (SELECT * FROM actions WHERE ticket IS NOT NULL AND used AND upper(choice) = 'ALLOW')"""
_SPACE = "[\\s\\x0B\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_DECIDE = f"""WITH {_MESSAGES}, said AS (SELECT * FROM messages WHERE role = 'user'), {_sender("said", "msg_id, conv_id")},
hosts AS (SELECT *, {_case("conv_id % 3", ("chatgpt.com", "claude.ai", "example.org"))} AS host, substr(t, 1, 200) AS p FROM sent),
asked AS (SELECT msg_id, {_PRODUCT} AS product, host, length, {_N_FINDINGS} AS secrets, score AS client_risk, p FROM hosts),
{_service("asked", "p", "msg_id, product, host, length, secrets, client_risk")}"""

_TICKET_ID = "substr(m5, 1, 8) || '-' || substr(m5, 9, 4) || '-' || substr(m5, 13, 4) || '-' || substr(m5, 17, 4) || '-' || substr(m5, 21, 12)"


def _ticket_of(number: str) -> str:
    return f"(SELECT {_TICKET_ID} FROM (SELECT md5(({number})::VARCHAR) AS m5))"


#: asked: tickets issued by the request log; answered: what its uses are told.
_REQUESTS = f"""{_MESSAGES}, said AS (SELECT *, msg_id AS k0, substr(msg, 1, 200) AS p FROM messages WHERE role = 'user'),
{_service("said", "p", "k0, msg")},
good AS (SELECT * FROM served WHERE k0 % 11 <> 0),
asked AS (SELECT k0 * 4 AS seq, make_timestamp((1704067200 + k0) * 1000000) AS ts, {_ticket_of("k0 * 4")} AS ticket, risk, preflight, reason, substr(msg, 1, 6000) AS t, k0, length(msg)::INT AS length FROM good),
tried AS (SELECT k0, unnest([1, 2, 3]) AS k FROM said),
uses AS (SELECT k0 * 4 + k AS seq, make_timestamp((1704067200 + k0 + CASE k WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 70 END) * 1000000) AS ts, k, k0,
  {_ticket_of("k0 * 4 + CASE WHEN k0 % 7 = 0 THEN 1 ELSE 0 END")} AS ticket, CASE WHEN k0 % 4 = 2 THEN 'DENY' ELSE 'ALLOW' END AS choice
  FROM tried WHERE k = 1 OR k = 2 AND k0 % 3 = 0 OR k = 3 AND k0 % 5 = 0),
judged AS (SELECT seq, ts, ticket, choice, CASE WHEN k0 % 7 = 0 OR k0 % 11 = 0 THEN 'unknown ticket' WHEN k = 3 THEN 'expired ticket' WHEN k = 2 THEN 'replay blocked'
  WHEN choice = 'ALLOW' THEN 'user allowed' ELSE 'user blocked' END AS reason FROM uses),
answered AS (SELECT *, CASE WHEN reason = 'user allowed' THEN 'ALLOW' ELSE 'DENY' END AS decision FROM judged)"""

_REQUEST_LOG = f"""SELECT ts, seq, 'DECIDE' AS kind, ticket, risk::VARCHAR AS risk, preflight, reason, {_N_FINDINGS}::VARCHAR AS secrets, NULL AS decision, NULL AS choice, NULL AS message, NULL AS port FROM asked
UNION ALL SELECT ts, seq, 'CONSUME', ticket, NULL, NULL, reason, NULL, decision, choice, NULL, NULL FROM answered"""

ORACLE_SQL: dict[str, str] = {
    "scan_wide_spaces": f"""WITH {_DOCS}, cut AS (SELECT doc_id, substr(replace(msg, ' ', {_case(f"doc_id % {len(WIDE)}", WIDE)}), 1, 6000) AS t FROM docs)
SELECT doc_id, {_FINDINGS} AS findings, {_N_FINDINGS} AS n_findings FROM cut""",
    "scan_findings": f"WITH {_DOCS}, cut AS (SELECT doc_id, substr(msg, 1, 6000) AS t FROM docs) SELECT doc_id, {_FINDINGS} AS findings, {_N_FINDINGS} AS n_findings FROM cut",
    "scan_findings_conversations": f"WITH {_MESSAGES}, cut AS (SELECT msg_id, substr(msg, 1, 6000) AS t FROM messages) SELECT msg_id, {_FINDINGS} AS findings, {_N_FINDINGS} AS n_findings FROM cut",
    "scan_exploded": f"""WITH {_DOCS}, cut AS (SELECT doc_id, substr(msg, 1, 6000) AS t FROM docs), l AS (SELECT doc_id, [x FOR x IN [{", ".join(_HITS)}] IF x IS NOT NULL] AS f FROM cut),
p AS (SELECT doc_id, f, unnest(range(len(f))) AS pos FROM l) SELECT doc_id, pos::INT AS pos, f[pos + 1] AS finding FROM p""",
    "scan_pattern_counts": f"""WITH {_DOCS}, {_sender("docs", "doc_id")},
l AS (SELECT {_PRODUCT_OF_DOC} AS product, label, [x FOR x IN [{", ".join(_HITS)}] IF x IS NOT NULL] AS f FROM sent),
x AS (SELECT product, label, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS finding FROM l)
SELECT product, label, finding, count(*) AS n FROM x GROUP BY ALL""",
    "marker_scan": f"WITH {_DOCS}, l AS (SELECT doc_id, lower(msg) AS low FROM docs) SELECT doc_id, {_MARKERS} AS markers, ({' + '.join(f'contains(low, {_q(m)})::INT' for m in c.MARKERS)}) AS n_markers FROM l",
    "risk_message": f"WITH {_DOCS}, {_sender('docs', 'doc_id')} SELECT doc_id, length, score, label FROM sent",
    "risk_preview": f"WITH {_DOCS}, {_service('(SELECT doc_id, substr(msg, 1, 200) AS p FROM docs)', 'p', 'doc_id')} SELECT * FROM served",
    "risk_full_text_service": f"WITH {_DOCS}, {_service('docs', 'msg', 'doc_id')} SELECT * FROM served",
    "alert_texts": f"""WITH {_DOCS}, {_sender("docs", "doc_id")}, a AS (SELECT *, substr(t, 1, 400) AS prompt, findings <> '' OR label <> 'low' AS alert FROM sent)
SELECT doc_id, alert, CASE WHEN alert THEN CASE WHEN findings <> '' THEN 'This looks sensitive' ELSE 'Large message' END END AS title,
CASE WHEN alert THEN CASE WHEN findings <> '' THEN 'Detected: ' || findings || '. Blocked before the model saw it.'
  ELSE 'This message is unusually long (' || length(prompt) || ' chars). Review before sending.' END END AS description,
CASE label WHEN 'high' THEN 'High risk' WHEN 'medium' THEN 'Review' ELSE 'Low risk' END AS badge, CASE label WHEN 'high' THEN 'Send anyway' ELSE 'Allow' END AS button,
'Sending to ' || upper({_PRODUCT_OF_DOC}) || '. This action requires your approval.' AS line,
substr(prompt, 1, 300) || CASE WHEN length(prompt) > 300 THEN '…' ELSE '' END AS shown FROM a""",
    "score_label_counts": f"WITH {_DOCS}, {_sender('docs', 'doc_id')} SELECT label, score, count(*) AS n FROM sent GROUP BY ALL",
    "agreement_matrix": f"""WITH {_DOCS}, {_sender("docs", "doc_id, msg")}, {_service("(SELECT doc_id, score, substr(msg, 1, 200) AS p FROM sent)", "p", "doc_id, score")}
SELECT score, risk, count(*) AS n, (score >= 85) = (risk >= 85) AS agree FROM served GROUP BY score, risk""",
    "product_of_host": f"WITH {_PAGES}, h AS (SELECT page_id, {_HOST} AS host FROM pages_at) SELECT page_id, host, {_PRODUCT} AS product FROM h",
    "protected_pages": f"WITH {_PAGES} SELECT page_id, url FROM pages_at WHERE starts_with(url, 'https://') AND {_HOST} IN ('chatgpt.com', 'chat.openai.com', 'claude.ai')",
    "badge_pages": f"WITH {_PAGES} SELECT page_id, url FROM pages_at WHERE status = 'complete' AND (contains(url, 'chatgpt.com') OR contains(url, 'openai.com') OR contains(url, 'claude.ai'))",
    "send_clicks": "SELECT event_id, event_id % 12 IN (0, 1, 2, 4, 5, 7, 8, 11) AS is_send FROM events",
    "compose_choice": f"""SELECT conv_id * 1000 + turn AS msg_id, substr(CASE turn % 4 WHEN 0 THEN {_trim("text")} WHEN 1 THEN '  ' || text WHEN 2 THEN {_trim("text")} ELSE '' END, 1, 6000) AS text FROM conversations""",
    "base_url_norm": f"WITH {_PAGES} SELECT page_id, regexp_replace(url, '/$', '') AS base_url FROM pages_at",
    "ticket_shape": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 't' || event_id END AS ticket FROM events",
    "decide_requests": f"""{_DECIDE}, h AS (SELECT *, md5(msg_id::VARCHAR) AS m FROM served)
SELECT msg_id, product, host, 'chat.send' AS action, length, secrets, client_risk, risk, preflight, reason, true AS ok, 'PENDING' AS decision,
substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS ticket, msg_id * 1000 + 1704067260000 AS exp_ms FROM h""",
    "secrets_caught": f"{_DECIDE} SELECT count(*) FILTER (secrets > 0) AS secrets_caught FROM served",
    "request_intake": f"""WITH {_MESSAGES}, shaped AS (SELECT msg_id, msg_id % 9 AS k, CASE WHEN msg_id % 9 = 0 THEN substr(msg, 1, 200) ELSE '' END AS p FROM messages WHERE msg_id % 9 <> 8),
{_service("shaped", "p", "msg_id, k")}
SELECT msg_id, (CASE WHEN k = 0 THEN 2 ELSE 0 END)::BIGINT AS secrets, risk, preflight, reason,
CASE WHEN k IN (5, 6) THEN 'T' || msg_id WHEN k = 7 THEN 'B' || msg_id ELSE '' END AS ticket, CASE WHEN k = 5 THEN 'ALLOW' ELSE 'DENY' END AS choice FROM served""",
    "request_rejects": f"WITH {_MESSAGES} SELECT msg_id, '{{bad ' || msg_id AS line FROM messages WHERE msg_id % 9 = 8",
    "ticket_decisions": f"WITH {_TICKETS} SELECT seq, ticket, choice, decision, reason FROM decided",
    "ticket_answers": f"WITH {_TICKETS} SELECT seq, true AS ok, decision, reason FROM decided",
    "released_actions": f"WITH {_ACTIONS} SELECT msg_id, ticket FROM out",
    "offline_denied": f"WITH {_ACTIONS} SELECT msg_id, 'DENY' AS decision, 'high' AS label, 'Guard offline' AS findings FROM actions WHERE ticket IS NULL",
    "abandoned_tickets": f"WITH {_TICKETS} SELECT ticket, (SELECT max(ts) FROM events) > issued + INTERVAL 6 HOUR AS expired FROM d WHERE ticket NOT IN (SELECT ticket FROM u)",
    "bypass_clicks": f"WITH {_ACTIONS} SELECT msg_id, 2::INT AS click FROM out",
    "audit_log": f"WITH {_LOG} SELECT {_WRITTEN} FROM log",
    "audit_feed": f"WITH {_LOG} SELECT {_WRITTEN} FROM feed",
    "audit_lines": f"""WITH {_LOG} SELECT seq, strftime(ts, '%H:%M:%S') || '  ' || kind || coalesce(' ' || decision, '') || coalesce(' (' || reason || ')', '')
|| coalesce(' ' || substr(ticket, 1, 8) || '...', '') || coalesce(' ' || message, '') AS line FROM feed""",
    "stats": f"WITH {_LOG} SELECT *, (SELECT count(*) FROM log WHERE kind = 'DECIDE' AND secrets > 0) AS secrets_caught FROM ({_counts('log')})",
    "dashboard_metrics": f"WITH {_LOG} {_counts('feed')}",
    "feed_vs_counters": f"""WITH {_LOG}, a AS ({_counts("log")}), b AS ({_counts("feed", "feed_")})
SELECT *, total - feed_total AS missing_total, allowed - feed_allowed AS missing_allowed, denied - feed_denied AS missing_denied,
replay_blocked - feed_replay_blocked AS missing_replay_blocked FROM a, b""",
    "running_counters": f"WITH {_LOG} SELECT seq, kind, row_number() OVER (ORDER BY ts, seq) AS position, {_over('ORDER BY ts, seq ROWS UNBOUNDED PRECEDING')} FROM log",
    "feed_depth": f"WITH {_LOG} SELECT seq, kind, least(500, row_number() OVER (ORDER BY ts, seq)) AS depth, {_over('ORDER BY ts, seq ROWS BETWEEN 499 PRECEDING AND CURRENT ROW', 'feed_')} FROM log",
    "policy_join": f"""WITH policy(tool, tier, reason) AS (VALUES {", ".join(f"({_q(t)}, {_q(r)}, {_q(x) if x else 'NULL'})" for t, r, x in c.POLICY)}),
t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pdf.summarize' WHEN 'click' THEN 'email.send_draft' WHEN 'purchase' THEN 'billing.update' WHEN 'signup' THEN 'db.query' ELSE 'shell.exec' END AS tool FROM events)
SELECT tool, event_id, coalesce(tier, 'High') AS tier, reason FROM t LEFT JOIN policy USING (tool)""",
    "stream_scan": f"WITH {_DOCS}, {_sender('docs', 'doc_id')} SELECT doc_id, findings, score, label FROM sent",
    "stream_tickets": f"WITH {_TICKETS} SELECT seq, ticket, choice, decision, reason FROM decided",
    "stream_stats": f"WITH {_LOG} SELECT *, (SELECT count(*) FROM log WHERE kind = 'DECIDE' AND secrets > 0) AS secrets_caught FROM ({_counts('log')})",
    "stream_two_logs": f"WITH {_TICKETS} SELECT seq, ticket, choice, decision, reason FROM decided",
    "stream_abandoned": f"""WITH {_TICKETS} SELECT ticket, issued, issued + INTERVAL 6 HOUR AS expires FROM d
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.ticket = d.ticket AND u.ts BETWEEN d.issued AND d.issued + INTERVAL 6 HOUR)""",
    "stream_offline": f"WITH {_ACTIONS} SELECT msg_id, 'DENY' AS decision, 'high' AS label, 'Guard offline' AS findings FROM actions WHERE ticket IS NULL",
    "stream_feed": f"WITH {_LOG} SELECT {_WRITTEN} FROM feed",
    "feed_json": f"""WITH {_LOG} SELECT (row_number() OVER (ORDER BY ts DESC, seq DESC) - 1)::INT AS pos, epoch_us(ts) // 1000 AS ts_ms, kind, ticket, risk::VARCHAR AS risk, preflight, decision, reason, choice,
secrets::VARCHAR AS secrets, message, port::VARCHAR AS port FROM feed""",
    "user_counters": f"""WITH {_LOG}, l AS (SELECT *, split_part(ticket, '-', 1) AS "user" FROM log),
a AS (SELECT "user", count(*) FILTER (secrets > 0) AS secrets_caught FROM l WHERE kind = 'DECIDE' GROUP BY ALL)
SELECT "user", secrets_caught, count(*) FILTER (kind = 'CONSUME') AS total, count(*) FILTER (decision = 'ALLOW') AS allowed, count(*) FILTER (decision = 'DENY') AS denied,
count(*) FILTER (reason = 'replay blocked') AS replay_blocked FROM a JOIN l USING ("user") GROUP BY ALL""",
    "ticket_meta": f"""WITH {_REQUESTS} SELECT seq, ticket, {_case("k0 % 3", ("chatgpt", "claude", "web"))} AS product, {_case("k0 % 3", ("chatgpt.com", "claude.ai", "example.org"))} AS host,
'chat.send' AS action, length, risk, preflight, reason FROM asked""",
    "meta_agreement": f"""WITH {_REQUESTS} SELECT (k0 % 100)::INT AS score, risk, count(*) AS n, (k0 % 100 >= 85) = (risk >= 85) AS agree FROM asked GROUP BY ALL""",
    "request_to_audit": f"WITH {_REQUESTS} {_REQUEST_LOG}",
    "stream_audit": f"""WITH {_REQUESTS} {_REQUEST_LOG}
UNION ALL SELECT make_timestamp({REQUEST_START_MS} * 1000), -1, 'STARTUP', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'audit log opened', {_q(str(c.PORT))}""",
    "stream_requests": f"WITH {_REQUESTS} SELECT seq, ticket, choice, decision, reason FROM answered",
}
