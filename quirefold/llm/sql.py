"""DuckDB SQL that gives the rows of the queries, where SQL can."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)] AS w, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, most / w AS r,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM w WINDOW b AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT arg_min(lev, r) AS all_lev FROM l WHERE lev <= r),
t AS (SELECT source, source_size, CASE WHEN all_lev IS NULL THEN most ELSE least(most, w * all_lev) END AS target FROM l, a),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT d.source, d.doc_id, d.size, g.rate, g.source_size, g.target, seed,
  CAST(floor(rate) AS BIGINT) + CAST((('0x' || substr(md5(seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate)) AS BIGINT) AS copies
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, range(16) r(seed)),
b AS (SELECT source, seed FROM (SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - any_value(target)), seed) AS n FROM k GROUP BY source, seed) WHERE n = 1)
SELECT doc_id, size, source_size, target, size * copies AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.seed = b.seed
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
p AS (SELECT rid, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
q AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p),
c AS (SELECT rid, CAST(sum(least(5, i - coalesce(before, i - 5))) AS BIGINT) AS n_repeat_words FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM q WHERE n > 1) GROUP BY rid),
f AS (SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (rid)),
e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS bad FROM e GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS m, count(*) AS k, sum(n) AS n, sum(bad * bad / n) / sum(n) AS q FROM h),
v AS (SELECT m, least(greatest(m * (1 - m) / greatest(q - m * m - m * (1 - m) * k / n, 1e-6) - 1, 1), 1e6) AS weight FROM m),
r AS (SELECT source, n, bad, (bad + m * weight) / (n + weight) > 0.5 AS rejected FROM h, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept,
  CAST(n AS BIGINT) AS host_rows, CAST(bad AS BIGINT) AS host_failed, rejected AS host_rejected
FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT rid, i, md5(list_aggregate(w[i:i+34], 'string_agg', ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
q AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM p) WHERE n > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM q),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT x.rid, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (c.j IS NULL) AS kept FROM x LEFT JOIN c ON x.rid = c.rid AND x.j = c.j GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) AS w FROM documents),
d AS (SELECT w, k, hex(encode(k)) AS x FROM (SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k FROM r WHERE length(w) >= 7)),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT)), lambda c, b: xor(c >> 8, t.t[1 + (xor(c, b) & 255)]))) AS h FROM d, t),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM h),
n AS (SELECT word, count(*) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
c AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM n, range(30) g(i) WHERE i < length(word)),
e AS (SELECT a.word, b.word AS near, b.n FROM c a JOIN c b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT c.word, n.word, n.n FROM c JOIN n ON c.rest = n.word UNION SELECT n.word, c.word, c.n FROM c JOIN n ON c.rest = n.word),
b AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM e GROUP BY word),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n.n THEN best.near END AS form, CASE WHEN -best.less >= 10 * n.n THEN -best.less END AS form_n FROM n LEFT JOIN b USING (word)),
p AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT p.word, f.word, f.form FROM p JOIN f ON p.next = f.word)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM f JOIN p ON f.word = p.word WHERE p.next IS NULL
"""

ORACLES = {"op1_mix_sources": OP1, "op5_quality_rules": OP5, "op7_repeated_phrases": OP7, "op13_spelling_forms": OP13}
