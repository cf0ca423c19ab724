"""DuckDB SQL for the queries that SQL can express. Written as plain statements over whole tables."""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST) AS k FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
water AS (SELECT arg_min(level, k) AS water FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(water * w, cap)) AS target FROM l, water),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(floor(round(t.target) / nullif(t.source_size, 0)), 0)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)) AS taken
FROM r
"""

DECONTAMINATION = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ilow AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS win, least(10, len(w)) AS n
  FROM ilow, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM low, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
hit AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM dwin d JOIN win i ON d.win = i.win AND d.n = i.n),
hw AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, n)) AS u(j) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
t AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM t WHERE term IN (SELECT term FROM item) GROUP BY term),
s AS (
  SELECT item.item_id, t.r, t.doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM item JOIN df USING (term) JOIN t USING (term), c GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""

SPELLING = r"""
WITH t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)::BIGINT ORDER BY i) AS crc
  FROM range(256) AS r(i)),
run AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)),
d AS (SELECT doc_id, run, count(*)::BIGINT AS n FROM run WHERE length(run) >= 7 GROUP BY ALL),
b AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM d),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(crc[xor(c, x) % 256 + 1], c // 256)), 4294967295) AS h FROM b, t),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS k FROM w)),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, cut.word, cut.n FROM w JOIN cut ON cut.rest = w.word
  UNION SELECT cut.word, w.word, w.n FROM w JOIN cut ON cut.rest = w.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, min({'n': -near_n, 'near': near}) AS best FROM pair GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.n >= 10 * w.n THEN best.near END AS form, CASE WHEN -best.n >= 10 * w.n THEN -best.n END AS form_n
  FROM w LEFT JOIN best USING (word)),
r AS (
  WITH RECURSIVE c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN r ON r.word = f.word
"""
