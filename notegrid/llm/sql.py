"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) AS one
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE AS budget FROM sources),
filled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM levels),
targets AS (
  SELECT source, source_size, budget, least(cap, (SELECT max(level) FROM filled) * weight) AS target FROM filled),
queued AS (
  SELECT s.*, t.source_size, t.target, t.budget, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size, digest, one) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE size > 0),
copies AS (
  SELECT q.*, r.k, (r.k * source_size + upto)::DOUBLE / target AS finish FROM queued q, range(2) r(k)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id NULLS FIRST, size, digest, one, k) <= budget AS taken FROM copies),
taken AS (
  SELECT doc_id, source, digest, one, count_if(taken) AS n FROM cut GROUP BY ALL)
SELECT s.doc_id, s.size, t.source_size, coalesce(t.target, 0.0) AS target, (s.size * coalesce(k.n, 0))::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON s.doc_id IS NOT DISTINCT FROM k.doc_id AND s.source IS NOT DISTINCT FROM k.source AND s.digest = k.digest AND s.one = k.one
"""

ORACLES["op9_extendible_shards"] = r"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, row_number() OVER () AS one
  FROM documents),
buckets AS (
  SELECT d.k AS depth, h >> (60 - d.k)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM sized, range(0, 61) d(k) WHERE n_bytes <= 1048576 GROUP BY ALL HAVING sum(n_bytes) <= 1048576),
placed AS (
  SELECT s.doc_id, s.n_bytes, s.h, min(b.depth) AS depth
  FROM sized s JOIN buckets b ON s.h >> (60 - b.depth)::INT = b.prefix WHERE s.n_bytes <= 1048576 GROUP BY s.doc_id, s.n_bytes, s.h, s.one),
loose AS (
  SELECT *, n_bytes > 524288 AS big, CASE WHEN n_bytes > 524288 THEN 1 ELSE n_bytes END AS width FROM sized
  WHERE n_bytes > 1048576 OR h NOT IN (SELECT h FROM placed)),
started AS (SELECT *, sum(width) OVER (PARTITION BY h, big ORDER BY n_bytes, one) - width AS start FROM loose),
paged AS (SELECT *, CASE WHEN big THEN start ELSE start // 524288 END::BIGINT AS page FROM started)
SELECT p.doc_id, p.n_bytes, p.depth::INT AS depth,
       CASE WHEN p.depth = 0 THEN '' ELSE substr(lpad(bin(p.h), 60, '0'), 1, p.depth::INT) END AS shard_id, b.shard_bytes, b.shard_docs
FROM placed p JOIN buckets b ON b.depth = p.depth AND p.h >> (60 - p.depth)::INT = b.prefix
UNION ALL
SELECT doc_id, n_bytes, 60, lpad(bin(h), 60, '0') || CASE WHEN big THEN '+b' ELSE '+' END || page,
       (sum(n_bytes) OVER (PARTITION BY h, big, page))::BIGINT, (count(*) OVER (PARTITION BY h, big, page))::BIGINT
FROM paged
"""

ORACLES["license_base"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (
  SELECT doc_id, w, list_concat(list_concat(
    [{'at': k - 1, 'label': 'mit'} FOR k IN range(1, len(w) + 1) IF w[k:k + 3] = ['under', 'the', 'mit', 'license']],
    [{'at': k - 1, 'label': 'apache-2'} FOR k IN range(1, len(w) + 1) IF w[k:k + 3] = ['apache', 'license', 'version', '2']]),
    [{'at': k - 1, 'label': 'cc-by-nc'} FOR k IN range(1, len(w) + 1) IF w[k:k + 2] = ['cc', 'by', 'nc']]) AS p FROM words)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min([x.at FOR x IN p]) AS first_word, list_max([x.at FOR x IN p]) AS last_word,
       array_to_string(list_sort(list_distinct([x.label FOR x IN p])), ',') AS base_labels FROM placed
"""

ORACLES["quality_base"] = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
words AS (SELECT row, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT row, k, count(*) OVER (PARTITION BY row, w[k], w[k + 1], w[k + 2]) AS n FROM words, unnest(range(1, len(w) - 1)) r(k)),
covered AS (SELECT row, count(DISTINCT k + d) AS n FROM windows, range(3) r(d) WHERE windows.n > 1 GROUP BY row),
measured AS (
  SELECT row, doc_id, len(w) AS n_words, coalesce(list_sum([len(x) FOR x IN w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed
FROM measured m LEFT JOIN covered c USING (row)
"""

ORACLES["personal_counts"] = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+')] AS card,
         [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]')] AS phone FROM documents)
SELECT doc_id, len(email) AS n_email, len([x FOR x IN ip IF list_max([p::HUGEINT FOR p IN string_split(x, '.')]) <= 255]) AS n_ip,
       len([x FOR x IN card IF len(x) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (len(x) - k) % 2 = 0 THEN x[k]::INT ELSE 2 * x[k]::INT - CASE WHEN x[k]::INT > 4 THEN 9 ELSE 0 END END FOR k IN range(1, len(x) + 1)]) % 10 = 0]) AS n_card,
       len([x FOR x IN phone IF len(x) BETWEEN 9 AND 15]) AS n_phone FROM found
"""
