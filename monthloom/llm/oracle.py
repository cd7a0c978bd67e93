"""DuckDB SQL that gives the rows of the text queries by plain means."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, l.pos, l.line, trim(l.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) l
), keyed AS (
  SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
                           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

#: Quotients are listed and ranked here, and blocks are rows; a shard's order is by the same digests.
MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM src
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS r FROM weighed
), steps AS (
  SELECT r, 3 * source_size / w AS ratio,
         ((SELECT sum(source_size) FROM src) - coalesce(sum(3 * source_size) OVER p, 0)) / sum(w) OVER rest AS level
  FROM ranked WINDOW p AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     rest AS (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size, n, least(w * (SELECT arg_min(level, r) FROM steps WHERE level < ratio), 3.0 * source_size) AS target
  FROM ranked
), consts AS (
  SELECT greatest(1, floor(min(target) FILTER (target > 0) / 256))::BIGINT AS block, sum(source_size)::BIGINT AS total
  FROM targets
), placed AS (
  SELECT s.*, t.source_size, t.target,
         ('0x' || substr(md5('mix:shard:' || s.doc_id), 1, 15))::BIGINT % ceil(n / 4096)::BIGINT AS shard
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cells AS (
  SELECT source, shard, sum(size)::BIGINT AS cell, sum(size)::BIGINT * any_value(target) / any_value(source_size) AS votes
  FROM placed GROUP BY source, shard HAVING sum(size) > 0
), quotients AS (
  SELECT source, shard, votes / (2 * k + 1) AS q FROM cells, consts, LATERAL (SELECT unnest(range(0, 4 * cell // block + 8)) AS k)
), won AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY q DESC, source ASC NULLS LAST, shard) AS place FROM quotients), consts
  WHERE place <= floor(total / block + 0.5) GROUP BY source, shard
), quotas AS (
  SELECT c.source, c.shard, cell, block, least(coalesce(quota, 0) * block, 3 * cell) AS words,
         (cell + block - 1) // block AS blocks
  FROM consts, cells c LEFT JOIN won w ON c.source IS NOT DISTINCT FROM w.source AND c.shard = w.shard
), picks AS (
  SELECT *, words // cell AS passes, least(floor((words - (words // cell) * cell) / block + 0.5)::BIGINT, blocks) AS picked,
         ('0x' || substr(md5('mix:start:' || coalesce(source, '') || ':' || shard), 1, 15))::BIGINT % blocks AS start
  FROM quotas
), chosen AS (
  SELECT source, shard, b * block AS lo, least((b + 1) * block, cell) AS hi
  FROM picks, LATERAL (SELECT unnest(range(0, blocks)) AS b)
  WHERE ((b + 1) * picked + start) // blocks > (b * picked + start) // blocks
), laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard
    ORDER BY ('0x' || substr(md5('mix:order:' || doc_id), 1, 15))::BIGINT, doc_id, h ROWS UNBOUNDED PRECEDING) AS upto FROM placed
), inside AS (
  SELECT l.doc_id, sum(least(l.upto, c.hi) - greatest(l.upto - l.size, c.lo)) AS extra
  FROM laid l JOIN chosen c ON l.source IS NOT DISTINCT FROM c.source AND l.shard = c.shard
   AND c.lo < l.upto AND c.hi > l.upto - l.size GROUP BY l.doc_id
)
SELECT l.doc_id, l.size, l.source_size, l.target,
       (coalesce(passes * l.size, 0) + coalesce(extra, 0))::BIGINT AS taken
FROM laid l LEFT JOIN picks p ON l.source IS NOT DISTINCT FROM p.source AND l.shard = p.shard
LEFT JOIN inside USING (doc_id)
"""

#: Brute force; on a table this small every slab lies within every window.
NEAREST = """
WITH v AS (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (c.norm * q.norm) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
