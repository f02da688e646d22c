"""DuckDB SQL of the operators that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_line_dedup"] = r"""
WITH shown AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS t
  FROM pages
), plain AS (
  SELECT row_number() OVER () AS k, page_id, host,
         regexp_replace(regexp_replace(t, '(?i)</?(p|br|li|ul|ol|h[1-6]|div|nav|article|section|header|footer|table|tr|title|head|body|html)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
  FROM shown
), lines AS (
  SELECT k, page_id, host, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT k, page_id, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM plain)
), total AS (
  SELECT host, count(*) AS n FROM plain GROUP BY host
), often AS (
  SELECT l.host, l.line FROM lines l JOIN total t ON l.host IS NOT DISTINCT FROM t.host
  WHERE l.line <> ''
  GROUP BY l.host, l.line, t.n HAVING count(DISTINCT l.k) >= 3 AND 100 * count(DISTINCT l.k) > 10 * t.n
), marked AS (
  SELECT l.*, EXISTS (SELECT 1 FROM often o WHERE o.host IS NOT DISTINCT FROM l.host AND o.line = l.line) AS goes
  FROM lines l WHERE l.line <> ''
)
SELECT p.page_id, p.host, count(m.k)::BIGINT AS n_lines, count(*) FILTER (WHERE m.goes)::BIGINT AS n_dropped,
       coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.goes), '') AS text
FROM plain p LEFT JOIN marked m ON p.k = m.k
GROUP BY p.k, p.page_id, p.host
"""

ORACLE_SQL["op5_exact_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS t FROM range(256) r(b)
), d AS (
  SELECT row_number() OVER () AS k, doc_id, source, text,
         list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
                     lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1])) % 2 = 1 AS cut,
         list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
                                    lambda f: coalesce(strlen(f)::VARCHAR || ':' || f, '-')), lambda a, b: a || b) AS head
  FROM documents, steps
), leaves AS (
  SELECT k, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN cut THEN sha256(head || coalesce(strlen(replace(text, chr(10), ''))::VARCHAR || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM d
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM leaves
), nodes(g, level, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 3, n
), ends AS (
  SELECT g, level, h FROM nodes WHERE n = 1
), tops(level, i, n, h) AS (
  SELECT 0, g, (SELECT count(*) FROM ends), h FROM ends
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n
), own AS (
  SELECT p.k, s.level AS step, s.i < p.i // power(3, s.level)::BIGINT AS low, s.i, s.h
  FROM placed p JOIN nodes s ON s.g = p.g AND s.n > 1 AND s.i // 3 = p.i // power(3, s.level + 1)::BIGINT AND s.i <> p.i // power(3, s.level)::BIGINT
  UNION ALL
  SELECT p.k, e.level + s.level, s.i < p.g // power(3, s.level)::BIGINT, s.i, s.h
  FROM placed p JOIN ends e ON e.g = p.g JOIN tops s ON s.n > 1 AND s.i // 3 = p.g // power(3, s.level + 1)::BIGINT AND s.i <> p.g // power(3, s.level)::BIGINT
), levels AS (
  SELECT p.k, unnest(range(e.level + (SELECT max(level) FROM tops))) AS step FROM placed p JOIN ends e ON e.g = p.g
), path AS (
  SELECT l.k, l.step, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.low), '') AS a,
         coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE NOT o.low), '') AS b
  FROM levels l LEFT JOIN own o ON o.k = l.k AND o.step = l.step GROUP BY l.k, l.step
), proof AS (
  SELECT k, string_agg(a || b, '' ORDER BY step) AS p FROM path GROUP BY k
), folds(k, step, h) AS (
  SELECT k, 0, coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.k, f.step + 1, sha256(p.a || f.h || p.b) FROM folds f JOIN path p ON p.k = f.k AND p.step = f.step
), folded AS (
  SELECT k, arg_max(h, step) AS h FROM folds GROUP BY k
), root AS (
  SELECT h FROM tops WHERE n = 1
)
SELECT p.doc_id, p.leaf, e.h AS subroot, r.h AS root, sha256(coalesce(f.p, '')) AS proof_sha256, x.h AS folded_root, x.h = r.h AS verified
FROM placed p JOIN ends e ON e.g = p.g CROSS JOIN root r LEFT JOIN proof f ON f.k = p.k JOIN folded x ON x.k = p.k
"""

ORACLE_SQL["op12_spelling_variants"] = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS t FROM range(256) r(b)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(head || run, ''),
                  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
              lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1]))) AS h
  FROM runs, steps WHERE length(run) >= 7
), words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM places
), near AS (
  SELECT c.word, v.word AS near FROM cut c JOIN words v ON v.word = c.a || c.b
  UNION
  SELECT v.word, c.word FROM cut c JOIN words v ON v.word = c.a || c.b
  UNION
  SELECT c.word, d.word FROM cut c JOIN cut d ON c.i = d.i AND c.a = d.a AND c.b = d.b AND c.word <> d.word
), best AS (
  SELECT x.word, count(*) AS n_near, first(x.near ORDER BY v.n DESC, x.near) AS near, max(v.n) AS near_n
  FROM near x JOIN words v ON v.word = x.near GROUP BY x.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), follow(word, root, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT f.word, g.form, step + 1 FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word
)
SELECT f.word, f.form, r.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN roots r ON r.word = f.word
"""
