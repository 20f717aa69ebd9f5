"""DuckDB SQL of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_url_filter"] = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parsed AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN best USING (n)
"""

ORACLE["op10_decontamination"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT l FROM windows
), runs AS (
  SELECT n, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT n, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM words, lengths WHERE len(w) >= l)
), hits AS (SELECT runs.n, i, l, item_id FROM runs JOIN windows USING (l, g)
), hit_words AS (
  SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(range(i, i + l)) AS place FROM hits) GROUP BY n
), hit_items AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM hits) GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (n) LEFT JOIN hit_items USING (n)
"""

ORACLE["op4_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE["op11_filter_audit"] = r"""
WITH marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), first AS (SELECT t, min(doc_id) AS least FROM base GROUP BY t
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
      len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM base JOIN first USING (t) LEFT JOIN marks USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), combos AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f
), per AS (
  SELECT part, filter_order, step, n, good, toxic, f,
    f[ascii(filter_order[step]) - 64] AS fails,
    len(list_filter(range(1, step), lambda i: f[ascii(filter_order[i]) - 64])) > 0 AS earlier
  FROM combos, steps
), counted AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM per GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""

ORACLE["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (SELECT d, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), used AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total,
    coalesce(any_value(u.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs l USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM used GROUP BY lang, source) u USING (lang, source)
  GROUP BY lang, source
), shares AS (
  SELECT lang, g.source, term, coalesce(u.n, 0) AS n,
    1 + 1000000000 * (coalesce(u.n, 0) + 1) // (g.total + g.v) AS p, 1 + 1000000000 * (k.n + 1) // (g.lang_total + g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM every_pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
) WHERE rank <= 200
"""

ORACLE["op6_substring_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT n, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
  FROM (SELECT n, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT n, unnest(range(i, i + 35)) AS place FROM windows JOIN repeated USING (g)
), kept AS (
  SELECT n, string_agg(word, ' ' ORDER BY place) AS text
  FROM (SELECT n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs) ANTI JOIN gone USING (n, place) GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.n = docs.n)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), members AS (
  SELECT DISTINCT n, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT n, count(*) AS size FROM members GROUP BY n
), shared AS (
  SELECT a.n AS x, b.n AS y, count(*) AS common FROM members a JOIN members b USING (g) WHERE a.n <> b.n GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.n = x JOIN sizes q ON q.n = y WHERE 100 * common >= 75 * (p.size + q.size - common)
), reach(n, m) AS (
  SELECT n, n FROM docs UNION SELECT r.n, l.y FROM reach r JOIN links l ON r.m = l.x
)
SELECT d.doc_id, coalesce(any_value(size), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (n) JOIN reach r ON r.n = d.n JOIN docs o ON o.n = r.m GROUP BY d.n, d.doc_id
"""
