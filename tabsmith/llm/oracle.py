"""DuckDB SQL for the text operators that SQL can express."""

from tabsmith.llm.decontaminate import N
from tabsmith.llm.line_dedup import FAMILY, MIN_PAGES, RATIO

ORACLE: dict[str, str] = {}

_SOLID = "trim(translate({0}, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> ''"
ORACLE["op2_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
solid AS (SELECT *, list_distinct(list_filter(l, lambda x: {_SOLID.format('x')})) AS s FROM d WHERE text IS NOT NULL),
families AS (SELECT *, list_slice(list_sort(list_transform(s, lambda x: md5(x))), 1, {FAMILY}) AS page FROM solid),
totals AS (SELECT source, count(DISTINCT page) AS host_pages FROM families GROUP BY source),
lines AS (SELECT DISTINCT source, page, unnest(s) AS line FROM families),
counts AS (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line),
boiler AS (SELECT c.source, list(c.line) AS gone FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
           WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.host_pages GROUP BY c.source),
j AS (SELECT d.rid, d.doc_id, d.source, d.text, d.l,
             CASE WHEN b.gone IS NULL THEN d.l ELSE list_filter(d.l, lambda x: NOT list_contains(b.gone, x)) END AS kept
      FROM d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source),
m AS (SELECT *, coalesce(len(list_filter(l, lambda x: {_SOLID.format('x')})), 0) AS n_lines,
             coalesce(len(list_filter(kept, lambda x: {_SOLID.format('x')})), 0) AS n_kept
      FROM j)
SELECT doc_id, source, CASE WHEN n_kept = n_lines THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - n_kept AS BIGINT) AS n_dropped
FROM m
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE["op6_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
spots AS (SELECT item, w, least(len(w), {N}) AS n, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM spots),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n),
keyed AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM places),
found AS (SELECT rid, item, keyed.n, i FROM keyed JOIN windows ON keyed.n = windows.n AND keyed.k = windows.k),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLE["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (s.n + l.v) AS p,
             1 + 1000000000 * (k.total + 1) // (l.n + l.v) AS q
      FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
found AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN found f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""

ORACLE["op13_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
