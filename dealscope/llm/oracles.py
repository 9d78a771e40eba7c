"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from dealscope.llm import quality_rules as q

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS gram
 FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM g),
w AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS gram
 FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
h AS (SELECT w.doc_id, w.i, w.k, g.item_id FROM w JOIN g ON w.gram = g.gram AND w.k = g.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

SQL["op4_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM
 (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM w) WHERE times > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
 len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m),
hosts AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR 100 * n_symbols > {q.MAX_SYMBOLS_PERCENT} * word_chars
 OR 100 * n_dup_lines > {q.MAX_DUP_LINES_PERCENT} * n_lines THEN 1 ELSE 0 END) AS f FROM j GROUP BY host),
prior AS (SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(n) AS size FROM hosts),
p AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE size END AS s FROM prior),
rates AS (SELECT host, (f + m * s) / (n + s) AS host_rate FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND host_rate <= {q.HOST_LIMIT} AS kept, round(host_rate, 9) AS host_rate FROM j JOIN rates USING (host)"""

SQL["op8_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, nth, pos AS p0, lead(pos, 1) OVER o AS p1, lead(pos, 2) OVER o AS p2,
 line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY nth)),
r AS (SELECT *, first_value(doc_id) OVER f AS doc0, first_value(nth) OVER f AS nth0 FROM w WHERE win IS NOT NULL
 WINDOW f AS (PARTITION BY win ORDER BY doc_id, nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
later AS (SELECT * FROM r WHERE doc_id <> doc0 OR nth <> nth0),
gone AS (SELECT DISTINCT doc_id, pos FROM (
 SELECT doc_id, p0 AS pos FROM later WHERE doc_id <> doc0 OR nth >= nth0 + 3
 UNION ALL SELECT doc_id, p1 FROM later WHERE doc_id <> doc0 OR nth + 1 >= nth0 + 3
 UNION ALL SELECT doc_id, p2 FROM later)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
 coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN c USING (doc_id)"""

SQL["op9_ngram_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM
 (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y, n_both = nx.n AND n_both = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
 WHERE 5 * n_both >= 4 * (nx.n + ny.n - n_both)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y)
SELECT d.doc_id, least(d.doc_id, coalesce(c.c, d.doc_id)) AS class_id, g.g AS group_id, coalesce(k.k, 0)::BIGINT AS n_links
FROM d LEFT JOIN (SELECT x, min(y) AS c FROM l WHERE same GROUP BY x) c ON c.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) k ON k.x = d.doc_id JOIN (SELECT x, min(y) AS g FROM reach GROUP BY x) g ON g.x = d.doc_id"""

SQL["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (win) WHERE first < doc_id)),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""

SQL["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS bits FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS t
 FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs
 FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bs[step] AS own, coalesce(list_sum(bs[1 : step - 1]), 0)::INT AS before
 FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
 sum(CASE WHEN bits & own > 0 AND bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN bits & own > 0 AND bits & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN bits & own > 0 AND bits & before = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
 sum(CASE WHEN bits & own > 0 AND bits & before = 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost
 FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c"""
