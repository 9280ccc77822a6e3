"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

SQL = {}

SQL["op6_mix"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS weight FROM d GROUP BY s
), filled AS (
  SELECT *, row_number() OVER o AS nth, 3 * source_size / weight AS most,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM src WINDOW o AS (ORDER BY 3 * source_size / weight, s)
), planned AS (
  SELECT s, source_size, least(3.0 * source_size, weight * (SELECT arg_min(level, nth) FROM filled WHERE level <= most)) AS target
  FROM filled
), b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget FROM planned
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b
), r AS (
  SELECT d.doc_id, d.size, e.*,
         coalesce(sum(d.size) OVER (PARTITION BY d.s ORDER BY d.k, d.doc_id, d.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS before
  FROM d JOIN e ON d.s = e.s
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM r
"""

SQL["op7_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

SQL["op8_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, md5(array_to_string(x, ' ')) AS h
  FROM (SELECT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
                                 ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS x FROM w)
), n AS (
  SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM common JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT r AS x, r AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
  SELECT x, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(w.doc_id = component_id, false) AS kept
FROM w LEFT JOIN n ON n.r = w.r JOIN least ON least.x = w.r
"""

SQL["op10_shards"] = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                        lambda h: CAST('0x' || h AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         md5('10:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents, crc
), f AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY s ORDER BY k, doc_id, size, text_crc32) - 1) + 1)
            / (2 * count(*) OVER (PARTITION BY s)) AS share
  FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY share, k, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM f
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(place * 24 // n AS INT) AS shard, CAST(place - (place * 24 // n * n + 23) // 24 AS BIGINT) AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM p
"""

SQL["op3_chat"] = r"""
WITH c AS (
  SELECT conv_id AS pair, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, role AS raw, text AS said FROM conversations
), last AS (
  SELECT pair, max(turn) AS last, arg_max(said, (turn, said)) AS reply FROM c WHERE raw = 'assistant' GROUP BY pair
), bad AS (
  SELECT c.pair, turn, role, text FROM c LEFT JOIN last ON c.pair = last.pair WHERE last IS NULL OR turn < last
  UNION ALL
  SELECT m.pair, m.last, 'assistant', coalesce(o.reply, '') FROM last m JOIN last o ON m.pair = xor(o.pair, 1)
), a AS (
  SELECT pair, turn, role, text, row_number() OVER (PARTITION BY pair, turn ORDER BY role, text) AS nth FROM c
), b AS (
  SELECT *, row_number() OVER (PARTITION BY pair, turn ORDER BY role, text) AS nth FROM bad
), j AS (
  SELECT pair, turn, nth, a.role AS ar, a.text AS atext, b.role AS br, b.text AS bt FROM a FULL JOIN b USING (pair, turn, nth)
), e AS (
  SELECT pair AS p, min((turn, nth)) AS stop FROM j WHERE ar IS DISTINCT FROM br OR atext IS DISTINCT FROM bt GROUP BY pair
), k AS (
  SELECT *, stop IS NULL OR (turn, nth) < stop AS common FROM j LEFT JOIN e ON pair = p
), rows AS (
  SELECT pair, 'prompt' AS part, turn, nth, ar AS role, atext AS text FROM k WHERE common
  UNION ALL SELECT pair, 'chosen', turn, nth, ar, atext FROM k WHERE NOT common AND ar IS NOT NULL
  UNION ALL SELECT pair, 'rejected', turn, nth, br, bt FROM k WHERE NOT common AND br IS NOT NULL
)
SELECT pair, part, turn, CAST(nth AS INT) AS nth, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered,
       CAST(part <> 'prompt' AND role = 'assistant' AS INT) AS mask
FROM rows
"""

_SPANS = """list_transform(range(1, len(h) + 1), lambda i: {{'start': list_sum([0] || list_transform(g[1:i], lambda x: length(x)))
           + list_sum([0] || list_transform(h[1:i - 1], lambda x: length(x))), 'hit': h[i], 'grp': p[i]}})"""


def _matches(pattern: str, group: int) -> str:
    """A list of (start, hit, grp) for every leftmost match of ``pattern`` in ``t``."""
    quoted = pattern.replace("'", "''")
    h, g, p = f"regexp_extract_all(t, '{quoted}')", f"string_split_regex(t, '{quoted}')", f"regexp_extract_all(t, '{quoted}', {group})"
    return f"(SELECT {_SPANS.replace('{{', '{').replace('}}', '}')} FROM (SELECT {h} AS h, {g} AS g, {p} AS p))"


SQL["op1_secrets"] = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT r, 0 AS kind, unnest("""
    + _matches(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2)
    + r""") AS m FROM d UNION ALL
  SELECT r, 1, unnest("""
    + _matches("AKIA[A-Z0-9]+", 0)
    + r""") FROM d UNION ALL
  SELECT r, 2, unnest("""
    + _matches("[0-9a-f]{24,}", 0)
    + r""") FROM d UNION ALL
  SELECT r, 9, unnest("""
    + _matches("[A-Za-z0-9+/_=-]{20,}", 0)
    + r""") FROM d
), base AS (
  SELECT r, kind, CAST(m.start AS BIGINT) AS s, CAST(m.start + length(m.hit) AS BIGINT) AS e FROM found
  WHERE length(m.grp) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 1000000000 END
), candidates AS (
  SELECT r, CAST(m.start AS BIGINT) AS s, m.hit AS hit,
         CASE WHEN regexp_full_match(m.hit, '[0-9A-Fa-f]+') THEN 3 WHEN regexp_full_match(m.hit, '[A-Z0-9]+') THEN 4 ELSE 5 END AS kind
  FROM found
  WHERE kind = 9 AND regexp_matches(m.hit, '[0-9]') AND regexp_matches(m.hit, '[A-Za-z]')
    AND lower(m.hit) NOT IN ('0123456789abcdef0123456789abcdef', 'd41d8cd98f00b204e9800998ecf8427e', 'abcdefghijklmnopqrstuvwxyz0123456789')
    AND NOT regexp_matches(m.hit, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')
), chars AS (
  SELECT r, s, hit, kind, i, unnest(string_split(substr(hit, i + 1, 20), '')) AS c
  FROM (SELECT *, unnest(range(0, length(hit) - 19)) AS i FROM candidates)
), counts AS (
  SELECT r, s, hit, kind, i, c, count(*) AS n FROM chars GROUP BY ALL
), hot AS (
  SELECT r, s, kind, i, any_value(hit) AS hit FROM counts GROUP BY r, s, kind, i
  HAVING round(log2(20) - sum(n * log2(n)) / 20, 9) >= CASE kind WHEN 3 THEN 3.0 WHEN 4 THEN 3.5 ELSE 3.8 END
), spans AS (
  SELECT * FROM base UNION ALL SELECT r, kind, s + min(i), s + max(i) + 20 FROM hot GROUP BY r, kind, s, hit
  HAVING NOT regexp_matches(substr(hit, min(i) + 1, max(i) - min(i) + 20), '(?i)example|sample|placeholder|dummy')
), named AS (
  SELECT *, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_upper', 'entropy_mixed'][kind + 1] || ':' || s || ':' || e AS x FROM spans
), joined AS (
  SELECT r, string_agg(x, ',' ORDER BY s, kind) AS spans, coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '') AS base,
         count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h
  FROM named GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined ON d.r = joined.r
"""
)

SQL["op12_spelling"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS marked, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(marked)), '..'),
                                                                lambda x: CAST('0x' || x AS BIGINT)),
                                 lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
        FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS (
  SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS replaced, substr(word, 1, i - 1) || substr(word, i + 1) AS deleted
  FROM places
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.deleted = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.deleted = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), found AS (
  SELECT words.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word
), steps AS (
  SELECT word, word AS root FROM found
  UNION SELECT steps.word, found.form FROM steps JOIN found ON found.word = steps.root WHERE found.form IS NOT NULL
)
SELECT found.*, root FROM found JOIN steps ON steps.word = found.word JOIN found last ON last.word = steps.root AND last.form IS NULL
"""

SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), sizes AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_sum FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term
), sums AS (
  SELECT lang, source, sum(n) AS sum_n FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(sum_n, 0) + 5 * v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (lang_n + 5) // (lang_sum + 5 * v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
       LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source
), distances AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN distances x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
