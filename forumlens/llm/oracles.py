"""SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import GRAM, PHRASES, SHARE, TEMPLATES

#: Dated list of the registered URL query: entry, category, action, date. A quarter of all hosts of the table are listed besides, by hash (see queries.py).
URL_LIST = [
    ("spam-farm.example.org", "spam", "add", "2024-01-10"),
    ("spam-farm.example.org", "spam", "remove", "2024-05-01"),
    ("spam-farm.example.org", "spam", "add", "2024-07-01"),
    ("example.net", "adult", "add", "2024-03-15"),
    ("example.net", "adult", "remove", "2024-10-01"),
    ("tionsh.example.net", "phishing", "add", "2024-02-01"),
    ("blog.tionble.example.com", "spam", "add", "2024-04-01"),
    ("m.tiontion.example.com", "spam", "add", "2023-12-01"),
    ("m.tiontion.example.com", "spam", "remove", "2024-08-15"),
    ("thther.example.org/en", "malware", "add", "2024-06-01"),
    ("thththe.example.com/fr", "advertising", "add", "2023-06-01"),
]

OP1 = f"""
WITH own(entry, category, action, since) AS (VALUES {", ".join(f"('{e}', '{c}', '{a}', DATE '{d}')" for e, c, a, d in URL_LIST)}),
hosts AS (SELECT host, md5(host) AS h FROM (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\\s*[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)([^?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS host FROM pages) WHERE host <> ''),
dated AS (SELECT host, substring(h, 3, 1) AS again, CASE WHEN substring(h, 2, 1) < '8' THEN 'spam' ELSE 'adult' END AS category, DATE '2024-01-01' + CAST(('0x' || substring(h, 4, 2)) AS INTEGER) AS since FROM hosts WHERE substring(h, 1, 1) < '4'),
list AS (SELECT DISTINCT entry, category, action, since FROM (SELECT * FROM own UNION ALL SELECT host, category, 'add', since FROM dated UNION ALL SELECT host, category, 'remove', CAST(since + INTERVAL 60 DAY AS DATE) FROM dated WHERE again < '8'
  UNION ALL SELECT host, category, 'add', CAST(since + INTERVAL 120 DAY AS DATE) FROM dated WHERE again < '4')),
span AS (SELECT entry, category, action, since, lead(since) OVER (PARTITION BY entry, category ORDER BY since) AS until FROM list),
cap AS (SELECT row_number() OVER () AS rid, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\\s*[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)([^?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', ''), '') AS host,
  lower(regexp_replace(regexp_extract(url, '^\\s*[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)([^?#]*)', 2), '/+$', '')) AS path FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM cap),
keyed AS (SELECT DISTINCT rid, fetched, unnest(list_concat(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
  list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/')))) AS entry FROM parts WHERE host IS NOT NULL),
hit AS (SELECT k.rid, s.category FROM keyed k JOIN span s ON k.entry = s.entry AND s.action = 'add' AND s.since <= k.fetched AND (s.until IS NULL OR k.fetched < s.until)),
found AS (SELECT rid, count(*) AS n, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM hit GROUP BY rid)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, f.n IS NOT NULL AS blocked, coalesce(f.n, 0) AS n_entries, coalesce(f.categories, '') AS categories
FROM cap c LEFT JOIN found f USING (rid)
"""

OP3 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT conv_id, k, n, md5(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY conv_id ORDER BY k)) AS upto FROM t),
whole AS (SELECT upto, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY upto, n),
kept AS (SELECT w.* FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.upto = w.upto AND p.k = w.n))
SELECT k.conv_id, k.n AS n_turns, k.n_copies,
  string_agg('<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>', chr(10) ORDER BY t.k) AS rendered
FROM kept k JOIN t USING (conv_id) GROUP BY k.conv_id, k.n, k.n_copies
"""

OP6 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS win, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
covered AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_marks, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c USING (rid)),
b AS (SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 10 * n_symbols > 2 * n_words AS r2, 10 * n_marks > 3 * n_words AS r3,
  n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines AS r4, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS r5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
  CAST(CAST(r0 AS INTEGER) + 2 * CAST(r1 AS INTEGER) + 4 * CAST(r2 AS INTEGER) + 8 * CAST(r3 AS INTEGER) + 16 * CAST(r4 AS INTEGER) + 32 * CAST(r5 AS INTEGER) AS BIGINT) AS failure_bits
FROM b
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ALL_TEMPLATES = ", ".join(f"({k}, {quoted(label)}, {base}, {quoted(text)})" for k, (label, text, base) in enumerate([(*x, True) for x in PHRASES] + [(*x, False) for x in TEMPLATES]))
WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH tpl(k, label, base, body) AS (VALUES {ALL_TEMPLATES}),
tw AS (SELECT k, label, base, {WORDS.format("body")} AS ws FROM tpl),
tg AS (SELECT k, i - 1 AS t, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM tw)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
dg AS (SELECT rid, unnest(range(0, len(ws) - 2)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM d WHERE len(ws) >= {GRAM}),
hit AS (SELECT rid, k, p - t AS diagonal, t FROM dg JOIN tg USING (gram)),
dia AS (SELECT DISTINCT rid, k, diagonal FROM hit),
step AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, k ORDER BY diagonal) <= CASE WHEN base THEN 0 ELSE greatest(2, len(ws) // 10) END THEN 0 ELSE 1 END AS fresh FROM dia JOIN tw USING (k)),
place AS (SELECT rid, k, diagonal, sum(fresh) OVER (PARTITION BY rid, k ORDER BY diagonal) AS place FROM step),
cov AS (SELECT rid, k, place, min(diagonal) AS diagonal, count(DISTINCT t + j) AS n FROM place JOIN hit USING (rid, k, diagonal) CROSS JOIN (SELECT unnest(range(0, {GRAM})) AS j) GROUP BY rid, k, place),
ok AS (SELECT rid, label, base, diagonal, n / len(ws) AS share FROM cov JOIN tw USING (k) WHERE n / len(ws) >= CASE WHEN base THEN 1 ELSE {SHARE} END),
found AS (SELECT rid, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (rid)
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS v, CAST('0x' || h[25:32] AS BIGINT) % 100 AS w FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR v >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
c AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


def _round(k: int) -> str:
    """Codebooks b{k} -> nearest entries a{k} (distance * 64 + entry, so that the least one breaks ties)."""
    return f"""a{k} AS MATERIALIZED (SELECT rid, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 64 + e) AS best FROM part JOIN b{k} USING (p) GROUP BY rid, p)"""


def _next(k: int) -> str:
    return f"""m{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, best % 64 AS e, i, sum(x[i + 1]) AS s, count(*) AS n FROM a{k} JOIN part USING (rid, p) CROSS JOIN (SELECT unnest(range(0, (SELECT w FROM width))) AS i) GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} ON b{k}.p = m{k}.p AND b{k}.e = m{k}.e)"""


OP13 = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
width AS (SELECT max(len(v)) // 16 AS w FROM kept),
part AS MATERIALIZED (SELECT rid, p, v[p * w + 1:p * w + w] AS x FROM kept, width, (SELECT unnest(range(0, 16)) AS p)),
seed AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, x AS c FROM part JOIN seed USING (rid)),
{_round(0)}, {_next(0)}, {_round(1)}, {_next(1)}, {_round(2)},
code AS (SELECT rid, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN code USING (rid), book
"""
