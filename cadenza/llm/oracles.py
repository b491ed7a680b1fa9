"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from cadenza.llm.pii import CONTEXT, IBAN_LENGTHS, SCORES


def _op6() -> str:
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ("iban", r"\b(" + "|".join(rf"{c}[0-9]{{2}}(\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + r")\b"),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ]
    proposed = " UNION ALL ".join(
        f"SELECT row_id, {k} AS ord, '{name}' AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d" for k, (name, p) in enumerate(patterns)
    )
    valid = r"""CASE kind
      WHEN 'email' THEN true
      WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0
      WHEN 'card' THEN len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(digits) + 1), lambda i:
        CASE WHEN (len(digits) - i) % 2 = 0 THEN CAST(substr(digits, i, 1) AS INT)
             ELSE (2 * CAST(substr(digits, i, 1) AS INT)) // 10 + (2 * CAST(substr(digits, i, 1) AS INT)) % 10 END)) % 10 = 0
      WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15
      WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c:
        CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (CASE WHEN v < 10 THEN a * 10 ELSE a * 100 END + v) % 97) = 1
      ELSE NOT regexp_matches(m, '^(000|666|9)|^...-00-|-0000$') AND near END"""
    word = "CASE kind " + " ".join(f"WHEN '{kind}' THEN '{words}'" for kind, words in CONTEXT.items()) + " END"
    near = f"regexp_matches(lower(substr(t, greatest(st - 40, 0) + 1, least(st, 40))), {word}) OR regexp_matches(lower(substr(t, e + 1, 40)), {word})"
    base = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {round(10 * score)}" for kind, score in SCORES.items()) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({proposed}),
u AS (SELECT row_id, ord, kind, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM p WHERE len(ms) > 0),
s AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS bare,
  CAST(sum(len(g) + len(m)) OVER (PARTITION BY row_id, ord ORDER BY i) AS BIGINT) AS e FROM u),
x AS (SELECT s.*, e - len(m) AS st, t FROM s JOIN d USING (row_id)),
y AS (SELECT *, {near} AS near FROM x),
v AS (SELECT row_id, ord, kind, st, e, least(10, {base} + CASE WHEN near THEN 3 ELSE 0 END) AS score FROM y WHERE {valid}),
a AS (SELECT row_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  coalesce(string_agg(kind || ':' || st || ':' || e, ',' ORDER BY ord, st) FILTER (ord < 4), '') AS base, string_agg(kind || ':' || st || ':' || e, ',' ORDER BY ord, st) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY ord, st) AS scores FROM v GROUP BY row_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (row_id)"""


OP3 = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS stands FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN stands <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stands <> page_id THEN stands END AS refers_to FROM d LEFT JOIN m USING (payload_digest)"""

OP4 = """
WITH r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM u),
f AS (SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bet|bets|casino|pills|porn|poker|spam|xxx)([.-]|$)') OR md5(host) LIKE '0%' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (n)"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON m.id = n.doc_id"""

#: The hexadecimal text stands for the bytes: two characters each.
OP11 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS p, h FROM d WHERE len(h) >= 200),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS w FROM p),
g AS (SELECT w, min((doc_id, p)) AS first FROM w GROUP BY w HAVING count(*) > 1),
m AS (SELECT w.doc_id, w.p FROM w JOIN g USING (w) WHERE (w.doc_id, w.p) <> g.first),
r AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM m),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM n GROUP BY ALL),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT t.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS b, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN b IS NULL THEN h ELSE kept || substr(h, 2 * b + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
c AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
b AS (SELECT d.part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t))::INT
    + 8 * regexp_matches(d.t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > c.first, false)::INT AS fails,
  coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM d JOIN c USING (t) LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM b GROUP BY part, fails),
l(x, f) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs FROM l a, l b, l c, l d, l e WHERE a.f + b.f + c.f + d.f + e.f = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step, fs FROM o),
q AS (SELECT filter_order, step, fs[step] AS f, coalesce(list_sum(fs[1:step - 1]), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (fails & (before | f) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & f > 0), 0) AS removed,
  coalesce(sum(n) FILTER (fails & before > 0 AND fails & f > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails & before = 0 AND fails & f > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & f > 0), 0) AS toxic_lost FROM g, q GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

OP13 = r"""
WITH RECURSIVE c AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS kind FROM conversations),
r AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM c WHERE kind <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM r),
o AS (SELECT k, turn, role, text, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, again) AS i,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM q),
p AS (SELECT *, lag(ini) OVER (PARTITION BY k ORDER BY i) AS prior FROM o),
f AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY k),
g(a, b, cost, letters, made) AS (VALUES ('0', '0', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('0', 'u', 2, 'I', ['user:']), ('s', 'u', 2, 'I', ['user:']), ('a', 'u', 2, 'I', ['user:']),
  ('u', 'a', 2, 'I', ['assistant:']), ('0', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'a', 4, 'II', ['user:', 'assistant:'])),
v(a, ini, b) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
w(a, b, role) AS (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
e AS (SELECT k, i, v.a, v.b, (fault = 't')::INT AS cost, 'K' AS letter, [o.role || ':' || text] AS made FROM o JOIN v USING (ini) WHERE fault IN ('', 't')
  UNION ALL SELECT k, i, w.a, w.b, 2 + (fault = 't')::INT, 'R', [w.role || ':' || text] FROM o, w WHERE fault IN ('', 't')
  UNION ALL SELECT k, i, a, a, 3, 'D', [] FROM o, (VALUES ('0'), ('s'), ('u'), ('a')) x(a)),
t(k, i, a, cost, audit, made) AS (SELECT k, 0::BIGINT, '0', 0::BIGINT, '', []::VARCHAR[] FROM f
  UNION ALL SELECT k, i, a, best.cost, best.audit, best.made FROM (SELECT t.k, t.i + 1 AS i, e.b AS a,
    min({'cost': t.cost + g.cost + e.cost, 'audit': t.audit || g.letters || e.letter, 'made': t.made || g.made || e.made}) AS best
    FROM t JOIN g ON g.a = t.a JOIN e ON e.k = t.k AND e.i = t.i + 1 AND e.a = g.b GROUP BY ALL)),
l AS (SELECT t.k, min({'cost': t.cost + g.cost, 'audit': t.audit || g.letters, 'made': t.made || g.made}) AS best FROM t JOIN f ON f.k = t.k AND t.i = f.n JOIN g ON g.a = t.a WHERE g.b IN ('0', 'a') GROUP BY t.k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM c) LEFT JOIN f USING (k) LEFT JOIN l USING (k)"""

SQL = {
    "op3_warc": OP3,
    "op4_url_filter": OP4,
    "op6_pii": _op6(),
    "op9_near_dedup": OP9,
    "op11_repeats": OP11,
    "op12_filter_audit": OP12,
    "op13_conversations": OP13,
}
