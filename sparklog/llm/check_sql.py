"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS latest FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < latest THEN latest END AS refers_to, true AS verified
FROM p LEFT JOIN g USING (d)
"""

MIX = f"""
WITH q AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(doc_id || ':mix-1') AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, 3 * source_size / weight AS full_at FROM w
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((SELECT level FROM l WHERE level * weight <= 3 * source_size
    ORDER BY full_at, source NULLS LAST LIMIT 1) * weight, 3 * source_size)::DOUBLE AS target FROM l),
a AS (SELECT q.*, t.source_size, t.target, sum(size) OVER (PARTITION BY q.source ORDER BY place, doc_id
    ROWS UNBOUNDED PRECEDING)::BIGINT AS ahead FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
e AS (SELECT size, (epoch * source_size + ahead) / target AS finish FROM a, range(3) AS r(epoch)
  WHERE size > 0 AND target > 0 AND epoch * source_size + ahead - size < target),
f AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM e),
c AS (SELECT max(finish) AS last FROM f WHERE upto <= (SELECT sum(size) FROM q))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 AND target > 0 THEN size * (
    (ahead / target <= last)::INT + ((source_size + ahead) / target <= last)::INT + ((2 * source_size + ahead) / target <= last)::INT)
  ELSE 0 END::BIGINT AS taken FROM a, c
"""

LEDGER = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS ws,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3),
v AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM v, range(3) AS o(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, length(array_to_string(ls, '')) AS line_chars,
    length(array_to_string(ls, '')) - length(array_to_string(list_distinct(ls), '')) AS dup_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Lu}}')) AS capitals
  FROM d LEFT JOIN r USING (rid)),
x AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (word_chars < 2 * n_words OR word_chars > 16 * n_words)::BIGINT + 8 * (10 * n_symbols > n_words)::BIGINT
    + 16 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 32 * (2 * capitals > letters)::BIGINT
    + 64 * (2 * letters < word_chars)::BIGINT + 128 * (100 * dup_chars > 30 * line_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & ~16 = 0 AS kept, failed
FROM x
"""
ABLATION = LEDGER[:LEDGER.index("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines")] + """
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & ~16 = bit) AS n_only,
  count(*) FILTER (failed & ~16 & ~bit = 0) AS n_kept_without
FROM x, (VALUES ('few_words', 1), ('repeated_words', 2), ('word_length', 4), ('symbols', 8), ('duplicate_text', 128), ('capitals', 32),
  ('few_letters', 64)) AS r(rule, bit) GROUP BY rule
"""

AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p
  FROM a JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (m + 5)) // ((sum(m) OVER (PARTITION BY lang))::HUGEINT + 5 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS m FROM a GROUP BY lang, term) JOIN v USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term)
  WHERE x.source <> y.source GROUP BY x.lang, x.source, y.source),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y USING (lang)
    LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source WHERE x.source <> y.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""

SQL = {"op2_warc": WARC, "op4_fair_mix": MIX, "op8_quality_ledger": LEDGER, "quality_ablation": ABLATION, "op13_source_audit": AUDIT}
