"""SQL answers of the queries that SQL can express."""

from __future__ import annotations

# Sums and shares as in the operator; the ranking is by the same md5 of the id and factor of the size.
OP7 = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sums),
limits AS (SELECT *, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / weight AS full_at FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER before, 0)) / sum(weight) OVER rest AS level
  FROM limits
  WINDOW before AS (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
found AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source LIMIT 1),
targets AS (
  SELECT l.source, l.source_size, l.source_rows, least(l.top, l.weight * f.level) AS target FROM limits l, found f),
parts AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    (s.u + 0.5::DOUBLE) / (4503599627370496::DOUBLE - s.u - 0.5::DOUBLE)
      / greatest(0.5::DOUBLE, least(2.0::DOUBLE, CASE WHEN t.source_size > 0
        THEN (s.size * t.source_rows)::DOUBLE / t.source_size::DOUBLE ELSE 1.0::DOUBLE END)) AS odds
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, u, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM parts)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

# Lines by the same pattern; cuts, forms and outputs put together from them.
OP12 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
  SELECT doc_id, body, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM docs),
placed AS (
  SELECT doc_id, body, units, len(units)::BIGINT AS n,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, body, n, form, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS p,
    coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS s
  FROM placed)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""

# Masks of failed filters counted by part, met with all 120 orders.
OP13 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad FROM labels GROUP BY doc_id),
marked AS (
  SELECT d.part, coalesce(s.good, 0) AS good, coalesce(s.bad, 0) AS bad,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body))::INT
    + 8 * regexp_matches(body, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), min(doc_id) OVER (PARTITION BY body) IS NOT NULL)::INT AS mask
  FROM docs d LEFT JOIN said s USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(list_slice(bits, 1, step - 1)), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
effects AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM effects
"""

ORACLES: dict[str, str] = {"op7_pareto_mix": OP7, "op12_rank_index_fim": OP12, "op13_trie_audit": OP13}
