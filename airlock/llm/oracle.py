"""The corpus operators' queries as SQL for DuckDB, for those that SQL can express."""

from __future__ import annotations

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = f"[x FOR x IN string_split_regex({{}}, '{_SPACES}') IF x <> '']"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), '[^ ]+')"
_TURNS = """t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))"""

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10""",
    # Sets that link share one of their n - ceil(0.9 n) + 1 rarest shingles.
    "op2_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
e AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])) END AS s FROM d),
u AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM e WHERE len(s) > 0 GROUP BY s),
t AS (SELECT node, n, unnest(s) AS x FROM u),
c AS (SELECT *, count(*) OVER (PARTITION BY x) AS many FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY many, x) AS k FROM c),
pre AS (SELECT node, n, x FROM r WHERE many > 1 AND k <= n - ceil(0.9 * n) + 1),
near AS (SELECT DISTINCT a.node AS p, b.node AS q FROM pre AS a JOIN pre AS b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS (SELECT p, q FROM near JOIN u AS a ON a.node = p JOIN u AS b ON b.node = q WHERE 190 * len(list_intersect(a.s, b.s)) >= 90 * (a.n + b.n)),
ends AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach(node, label) AS (SELECT node, node FROM u UNION SELECT q, label FROM reach JOIN ends ON p = node AND label < q),
best AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
degree AS (SELECT p AS node, count(*) AS n FROM ends GROUP BY p)
SELECT doc_id, len(e.s)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(degree.n, 0)::BIGINT AS n_links
FROM e LEFT JOIN u ON e.s = u.s AND len(e.s) > 0 LEFT JOIN best USING (node) LEFT JOIN degree USING (node)""",
    "op4_chat_format": f"""
WITH {_TURNS},
e AS (SELECT *, replace(replace(replace(text, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t') AS body,
             replace(replace(replace(replace(role, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t'), ':', '\\c') AS said,
             lag(role) OVER w AS before, row_number() OVER w AS k
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN before = role THEN 0 WHEN k > 1 THEN 7 + length(said) ELSE 6 + length(said) END + length(body) + 7)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN f USING (h) WHERE doc_id > first),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS v FROM benchmark),
i AS (SELECT item_id, len(v) AS m, least(len(v), 5) AS k, [array_to_string(v[j:j + least(len(v), 5) - 1], ' ') FOR j IN range(1, len(v) - least(len(v), 5) + 2)] AS s FROM b WHERE len(v) > 0),
si AS (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(s) AS x FROM i) GROUP BY ALL),
pos AS (SELECT doc_id, kk AS k, j, array_to_string(w[j:j + kk - 1], ' ') AS x FROM (SELECT doc_id, w, kk, unnest(range(1, len(w) - kk + 2)) AS j FROM d, (SELECT DISTINCT k AS kk FROM i))),
hit AS (SELECT DISTINCT doc_id, item_id, j FROM pos JOIN si USING (x) JOIN i USING (item_id) WHERE pos.k = i.k),
starts AS (SELECT DISTINCT doc_id, item_id, a FROM (SELECT doc_id, item_id, unnest(range(greatest(1, j - (m - k)), j + 1)) AS a FROM hit JOIN i USING (item_id)) JOIN d USING (doc_id) JOIN i USING (item_id) WHERE a + m - 1 <= len(w)),
ok AS (SELECT doc_id, item_id, a FROM starts JOIN hit USING (doc_id, item_id) JOIN i USING (item_id) WHERE hit.j BETWEEN a AND a + m - k GROUP BY doc_id, item_id, a, m, k HAVING count(*) >= 0.8 * (m - k + 1) - 1e-9),
wsh AS (SELECT doc_id, item_id, a, x, count(*) AS n FROM (SELECT doc_id, item_id, a, k, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(a, a + m - k + 1)]) AS x FROM ok JOIN d USING (doc_id) JOIN i USING (item_id)) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, a, m, sum(least(wsh.n, si.n)) AS c, m - k + 1 AS size FROM wsh JOIN si USING (item_id, x) JOIN i USING (item_id) GROUP BY doc_id, item_id, a, m, k),
good AS (SELECT doc_id, item_id, a, m, c / (2 * size - c) AS similarity FROM sim WHERE c / (2 * size - c) >= 0.8 - 1e-12)
SELECT doc_id, item_id, (a - 1)::BIGINT AS start_word, m::BIGINT AS n_words, similarity::DOUBLE AS similarity
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) = 1""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(1, len(x) // 2 + 1)) AS i FROM d),
g AS (SELECT doc_id, i, md5_number(substr(x, 2 * i - 1, 200)) AS h FROM p WHERE 2 * i + 198 <= len(x)),
f AS (SELECT h, min((doc_id, i)) AS first FROM g GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE (doc_id, i) > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS i FROM s),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before < i - 1) AS spans
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * i - 1, 2), '' ORDER BY i) AS t FROM p SEMI JOIN runs USING (doc_id) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS p FROM documents),
q AS (SELECT lang, [x FOR x IN string_split_regex(p, '[\x20\x09]+') IF x <> ''] AS w FROM (SELECT lang, unnest(p) AS p FROM d)),
f1 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(w) AS g FROM q) GROUP BY ALL),
f2 AS (SELECT lang, u, v, u || ' ' || v AS g, count(*) AS f FROM (SELECT lang, w[i] AS u, w[i + 1] AS v FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM q)) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, u, v, x, count(*) AS f FROM (SELECT lang, w[i] AS u, w[i + 1] AS v, w[i + 2] AS x FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM q)) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, unnest([u || ' ' || v, v || ' ' || x]) AS g, f FROM f3) GROUP BY ALL),
two AS (SELECT lang, g AS phrase, f2.f AS a, l.f AS l, r.f AS r
        FROM f2 LEFT JOIN longer USING (lang, g) JOIN f1 AS l ON l.lang = f2.lang AND l.g = f2.u JOIN f1 AS r ON r.lang = f2.lang AND r.g = f2.v
        WHERE coalesce(100 * longer.f < 50 * f2.f, true)),
three AS (SELECT f3.lang, f3.u || ' ' || f3.v || ' ' || x AS phrase, f3.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2
          FROM f3 JOIN f1 AS a1 ON a1.lang = f3.lang AND a1.g = f3.u JOIN f2 AS b1 ON b1.lang = f3.lang AND b1.g = f3.v || ' ' || x
          JOIN f2 AS a2 ON a2.lang = f3.lang AND a2.g = f3.u || ' ' || f3.v JOIN f1 AS b2 ON b2.lang = f3.lang AND b2.g = x),
cut AS (SELECT *, (1000000::HUGEINT * a * a) // (l1::HUGEINT * r1) AS s1, (1000000::HUGEINT * a * a) // (l2::HUGEINT * r2) AS s2 FROM three),
every AS (SELECT lang, phrase, a, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM two
          UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)::BIGINT FROM cut),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000""",
    # A source is at its cap if all would take no more than the budget at the level that fills it. Early
    # sources (odd places) fall from 3/2 to 1/2 of their weight, late ones rise: w * (a * t + b * t * t)
    # is due by the moment t.
    "op12_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS p FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (p - 1) % 3]::DOUBLE AS w FROM s),
o AS (SELECT a.source, any_value(a.n) AS n, any_value(a.p) AS p, any_value(a.w) AS w, sum(least(2 * b.n * a.w, 2 * a.n * b.w)) <= 1.5 * sum(b.n) * any_value(a.w) AS full_up
      FROM w AS a CROSS JOIN w AS b GROUP BY a.source),
r AS (SELECT 1.5::DOUBLE * sum(n) - coalesce(sum(2 * n) FILTER (full_up), 0) AS rest, coalesce(sum(w) FILTER (NOT full_up), 1) AS open FROM o),
t AS (SELECT o.*, CASE WHEN full_up THEN (2 * n)::DOUBLE ELSE w * rest / open END AS target FROM o, r),
c AS (SELECT d.*, n, p, target, floor(target)::BIGINT AS stop,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, greatest(least(stop - x, size), 0) AS one, greatest(least(stop - x - n, size), 0) AS two FROM c)
SELECT doc_id, size, n AS source_size, target, one + two AS taken, ((one > 0)::INT + (two > 0)::INT)::BIGINT AS passes,
       CASE WHEN one > 0 THEN floor(1e6 * 2 * (x / target) / (CASE WHEN p % 2 = 1 THEN 1.5 + sqrt(2.25 - 2 * x / target) ELSE 0.5 + sqrt(0.25 + 2 * x / target) END))::BIGINT ELSE -1 END AS first_due
FROM y""",
}
