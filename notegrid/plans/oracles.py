"""DuckDB SQL of the catalogue's queries."""

SQL: dict[str, str] = {}

_SIDES = """
truth AS (SELECT user_id, event_type, event_id AS i, epoch_us(ts) AS x, CAST(floor(value) AS BIGINT) % 25 AS fret FROM events WHERE event_id % 2 = 0),
pred AS (SELECT user_id, event_type, event_id AS j, epoch_us(ts) AS x, CAST(floor(value) AS BIGINT) % 25 AS fret, value > 150 AS flagged FROM events WHERE event_id % 2 = 1),
cand AS (SELECT t.user_id, t.event_type, i, j, abs(t.x - p.x) AS dx, row_number() OVER (PARTITION BY t.user_id, t.event_type ORDER BY abs(t.x - p.x), i, j) AS rn
  FROM truth t JOIN pred p ON t.user_id = p.user_id AND t.event_type = p.event_type AND abs(t.x - p.x) <= 21600000000),
walk AS (
  SELECT user_id, event_type, 0::BIGINT AS rn, []::BIGINT[] AS ti, []::BIGINT[] AS pj FROM (SELECT DISTINCT user_id, event_type FROM cand)
  UNION ALL
  SELECT w.user_id, w.event_type, c.rn, CASE WHEN list_contains(ti, i) OR list_contains(pj, j) THEN ti ELSE list_append(ti, i) END,
         CASE WHEN list_contains(ti, i) OR list_contains(pj, j) THEN pj ELSE list_append(pj, j) END
  FROM walk w JOIN cand c ON c.user_id = w.user_id AND c.event_type = w.event_type AND c.rn = w.rn + 1),
ends AS (SELECT user_id, event_type, max_by(ti, rn) AS ti, max_by(pj, rn) AS pj FROM walk GROUP BY ALL),
matched AS (SELECT user_id, event_type, unnest(ti) AS i, unnest(pj) AS j FROM ends),
pairs AS (SELECT m.*, c.dx FROM matched m JOIN cand c USING (user_id, event_type, i, j))
"""
SQL["match_pairs"] = f"WITH RECURSIVE {_SIDES} SELECT user_id, event_type, i, j, dx FROM pairs"
_METRICS = """
joined AS (SELECT p.dx, t.fret IS DISTINCT FROM q.fret AS wrong, q.flagged FROM pairs p JOIN truth t USING (user_id, event_type, i) JOIN pred q USING (user_id, event_type, j)),
one AS (SELECT count(*) AS matched, (SELECT count(*) FROM truth) - count(*) AS missing, (SELECT count(*) FROM pred) - count(*) AS extra,
  count_if(wrong)::BIGINT AS wrong_fret, count_if(wrong AND flagged)::BIGINT AS wrong_flagged, median(dx / 2160000000000.0) AS x_error_median, max(dx / 2160000000000.0) AS x_error_max,
  (SELECT count_if(flagged) FROM pred)::BIGINT AS flagged, ((SELECT count_if(flagged) FROM pred) - count_if(flagged))::BIGINT AS extra_flagged FROM joined),
measured AS (SELECT matched, missing, extra, wrong_fret, (missing + extra + wrong_fret - extra_flagged - wrong_flagged)::BIGINT AS unflagged_errors, flagged,
  (extra_flagged + wrong_flagged)::BIGINT AS flagged_errors, round(matched / (matched + missing), 6) AS recall, round(matched / (matched + extra), 6) AS "precision",
  round((matched - wrong_fret) / matched, 6) AS fret_accuracy, round((missing + extra + wrong_fret - extra_flagged - wrong_flagged) / (matched + missing), 6) AS unflagged_frac,
  round(x_error_median, 6) AS x_error_median, round(x_error_max, 6) AS x_error_max, round(flagged / (matched + extra), 6) AS flag_rate, round((extra_flagged + wrong_flagged) / flagged, 6) AS flag_precision FROM one)
"""
SQL["match_metrics"] = f"WITH RECURSIVE {_SIDES}, {_METRICS} SELECT * FROM measured"
SQL["targets_failed"] = f"""WITH RECURSIVE {_SIDES}, {_METRICS},
long AS (UNPIVOT (SELECT recall, "precision", fret_accuracy, unflagged_frac, x_error_median, x_error_max, flag_rate FROM measured) ON COLUMNS(*) INTO NAME metric VALUE value),
bounds(metric, kind, bound) AS (VALUES ('recall', 'min', 0.99::DOUBLE), ('precision', 'min', 0.995), ('fret_accuracy', 'min', 0.99), ('unflagged_frac', 'max', 0.002), ('x_error_median', 'max', 0.0025), ('x_error_max', 'max', 0.005), ('flag_rate', 'max', 0.05))
SELECT metric, kind, bound, value FROM long JOIN bounds USING (metric) WHERE (kind = 'min' AND value < bound) OR (kind = 'max' AND value > bound)"""

SQL["change_series"] = "SELECT event_id, user_id, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0), 6) AS change FROM events"
SQL["true_runs"] = """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM p WHERE value >= 50)
SELECT user_id, min(pos)::INT AS a, max(pos)::INT AS b FROM g GROUP BY user_id, g HAVING max(pos) - min(pos) + 1 >= 2"""
SQL["anchored_runs"] = """WITH RECURSIVE o AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, ts, event_id, value, value AS anchor, 1 AS run FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.ts, o.event_id, o.value, CASE WHEN abs(o.value - w.value) < 60 AND abs(o.value - w.anchor) < 90 THEN w.anchor ELSE o.value END,
    CASE WHEN abs(o.value - w.value) < 60 AND abs(o.value - w.anchor) < 90 THEN w.run ELSE w.run + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, min_by(event_id, k) AS i0, max_by(event_id, k) AS i1, min(ts) AS t0, max(ts) AS t1, count(*)::INT AS n FROM w GROUP BY user_id, run"""
SQL["merge_runs"] = """WITH s AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 20 AS b FROM orders),
m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) > 30 THEN 1 ELSE 0 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT o_custkey, min(a)::BIGINT AS a, max(b)::BIGINT AS b, count(*) AS n, (min(a) + max(b)) / 2.0::DOUBLE AS centre FROM g GROUP BY o_custkey, g"""
_BOX = "SELECT user_id, event_type, event_id, epoch_us(ts) // 3600000000 AS x0, CAST(floor(value) AS BIGINT) % 20 AS y0, epoch_us(ts) // 3600000000 + 5 + event_id % 7 AS x1, CAST(floor(value) AS BIGINT) % 20 + 10 AS y1 FROM events"
SQL["join_marks"] = f"""WITH b AS ({_BOX}), w AS (SELECT median(x1 - x0 + 1) AS width FROM b),
l AS (SELECT *, lag(y0) OVER p AS p0, lag(y1) OVER p AS p1, lag(x1) OVER p AS px FROM b WINDOW p AS (PARTITION BY user_id, event_type ORDER BY x0, event_id)),
m AS (SELECT *, CASE WHEN coalesce(least(y1, p1) - greatest(y0, p0) + 1 >= 0.5 * (least(y1 - y0, p1 - p0) + 1) AND x0 - px - 1 < 3.0 * (SELECT width FROM w), false) THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY x0, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, event_type, min(x0)::BIGINT AS x0, min(y0)::BIGINT AS y0, max(x1)::BIGINT AS x1, max(y1)::BIGINT AS y1, count(*) AS digits FROM g GROUP BY user_id, event_type, g"""
SQL["dense_ids"] = "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) - 1)::INT AS note_id FROM events"
SQL["split_grids"] = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
q AS (SELECT *, CAST(ceil(n / 4.0) AS BIGINT) AS g, n // CAST(ceil(n / 4.0) AS BIGINT) AS q, n % CAST(ceil(n / 4.0) AS BIGINT) AS r FROM o),
d AS (SELECT o_custkey, o_orderkey, CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS grid FROM q),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, grid ORDER BY o_orderkey) - 1 AS cell FROM d)
SELECT o_custkey, o_orderkey, grid::INT AS grid, (cell % 2)::INT AS gx, (cell // 2)::BIGINT AS gy FROM c"""
SQL["even_sample"] = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT DISTINCT o_custkey, n, least(n, 5) AS k FROM o),
w AS (SELECT DISTINCT o_custkey, CASE WHEN k = 1 THEN 0 ELSE CAST(round_even((n - 1) * j / (k - 1)::DOUBLE, 0) AS BIGINT) END AS i FROM k, range(5) r(j) WHERE j < k)
SELECT o_custkey, o_orderkey, i::INT AS position FROM o JOIN w USING (o_custkey, i)"""
SQL["time_grid"] = """SELECT p_partkey, k::INT AS k, k / 12.0::DOUBLE AS t, least(CAST(floor(k / 12.0::DOUBLE * (10 + p_size) + 0.5) AS BIGINT), p_partkey % 300) AS frame
FROM part, range(0, 400) r(k) WHERE k / 12.0::DOUBLE < (p_partkey % 300 + 1) / (10 + p_size)::DOUBLE"""
SQL["canvas_offsets"] = "SELECT l_orderkey, l_linenumber, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM lineitem"
SQL["bar_edges"] = """WITH p AS (SELECT user_id, value / 400 AS c, row_number() OVER w - 1 AS pos, coalesce(lag(value / 400) OVER w, 0) AS l, coalesce(lead(value / 400) OVER w, 0) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM p WHERE c >= 0.1)
SELECT user_id, min(pos)::INT AS a, max(pos)::INT AS b, round(min_by(l, pos), 6) AS "left", round(max_by(r, pos), 6) AS "right" FROM g GROUP BY user_id, g HAVING greatest(min_by(l, pos), max_by(r, pos)) < 0.05"""
SQL["coverage"] = """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings)
SELECT label, pos::INT AS pos, round(avg(CASE WHEN v > -0.2::FLOAT THEN 1.0 ELSE 0.0 END), 6) AS cover, bool_or(v > -0.2::FLOAT) AS any_ink, bool_and(v > -0.2::FLOAT) AS all_ink FROM e GROUP BY label, pos"""
SQL["otsu_levels"] = """WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) % 256 AS level, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER p AS w, sum(n * level) OVER p AS s, sum(n) OVER (PARTITION BY event_type) AS tw, sum(n * level) OVER (PARTITION BY event_type) AS ts FROM h WINDOW p AS (PARTITION BY event_type ORDER BY level ROWS UNBOUNDED PRECEDING)),
b AS (SELECT event_type, level, round(coalesce(w::DOUBLE * (tw - w) * (s / w - (ts - s) / nullif(tw - w, 0)) * (s / w - (ts - s) / nullif(tw - w, 0)), 0), 3) AS v FROM c)
SELECT event_type, min(level) AS threshold FROM b WHERE v = (SELECT max(v) FROM b x WHERE x.event_type = b.event_type) GROUP BY event_type"""
_NCC = "CASE WHEN var_pop({a}) * var_pop({b}) > 0 THEN covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) ELSE 0 END"
SQL["ncc_pairs"] = f"""WITH p AS (SELECT vec_id, lead(vec_id) OVER w AS next_id, embedding AS a, lead(embedding) OVER w AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
e AS (SELECT vec_id, next_id, unnest(a)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM p WHERE next_id IS NOT NULL)
SELECT vec_id, next_id, round({_NCC.format(a='x', b='y')}, 6) AS ncc FROM e GROUP BY ALL"""
SQL["shift_best"] = f"""WITH p AS (SELECT vec_id, lead(vec_id) OVER w AS next_id, embedding AS a, lead(embedding) OVER w AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT vec_id, next_id, dx, unnest(a[dx + 1:])::DOUBLE AS x, unnest(b[1:len(a) - dx])::DOUBLE AS y FROM p, range(0, 59) r(dx) WHERE next_id IS NOT NULL),
n AS (SELECT vec_id, next_id, dx, round({_NCC.format(a='x', b='y')}, 6) AS ncc FROM s GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ncc DESC, dx) AS rn FROM n),
b AS (SELECT vec_id, next_id, dx, ncc FROM f WHERE rn = 1),
t AS (SELECT n.vec_id, n.dx, n.ncc, row_number() OVER (PARTITION BY n.vec_id ORDER BY n.ncc DESC, n.dx) AS rn FROM n JOIN b ON b.vec_id = n.vec_id WHERE abs(n.dx - b.dx) > 5)
SELECT b.vec_id, b.next_id, b.dx::INT AS shift, b.ncc, t.dx::INT AS second_shift, t.ncc AS second_ncc,
  CASE WHEN b.ncc < 0.8 THEN 'ncc' WHEN t.ncc IS NOT NULL AND round(b.ncc - t.ncc, 6) < 0.05 THEN 'ambiguous' END AS refused FROM b LEFT JOIN t ON t.vec_id = b.vec_id AND t.rn = 1"""
SQL["template_median"] = """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, pos::INT AS pos, round(median(v), 6) AS median FROM e GROUP BY label, pos"""
SQL["template_loo"] = f"""WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
l AS (SELECT a.label, a.vec_id, a.pos, a.v, median(b.v) AS loo FROM e a JOIN e b ON a.label = b.label AND a.pos = b.pos AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT label, vec_id, round({_NCC.format(a='v', b='loo')}, 5) AS class_ncc FROM l GROUP BY ALL"""
SQL["template_read"] = f"""WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
t AS (SELECT label AS digit, pos, median(v) AS m FROM e GROUP BY ALL),
s AS (SELECT vec_id, digit, round({_NCC.format(a='v', b='m')}, 6) AS ncc FROM e JOIN t USING (pos) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ncc DESC, digit DESC) AS rn FROM s)
SELECT vec_id, max(digit) FILTER (WHERE rn = 1) AS digit, max(ncc) FILTER (WHERE rn = 1) AS best, round(max(ncc) FILTER (WHERE rn = 1) - max(ncc) FILTER (WHERE rn = 2), 6) AS margin,
  max(ncc) FILTER (WHERE rn = 1) >= 0.3 AND round(max(ncc) FILTER (WHERE rn = 1) - max(ncc) FILTER (WHERE rn = 2), 6) >= 0.05 AS accepted FROM r GROUP BY vec_id"""
SQL["page_median"] = """WITH e AS (SELECT vec_id // 31 AS page, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT page, pos::INT AS pos, round(median(v), 6) AS median FROM e GROUP BY page, pos"""
SQL["bar_residual"] = """WITH u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS p FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS p FROM events WHERE event_type = 'purchase'),
d AS (SELECT a.user_id, min(abs(a.p - b.p)) AS d FROM a JOIN b USING (user_id) GROUP BY a.user_id, a.p UNION ALL SELECT a.user_id, min(abs(a.p - b.p)) FROM a JOIN b USING (user_id) GROUP BY a.user_id, b.p)
SELECT u.user_id, CASE WHEN NOT EXISTS (FROM a WHERE a.user_id = u.user_id) AND NOT EXISTS (FROM b WHERE b.user_id = u.user_id) THEN 'none'
  WHEN NOT EXISTS (FROM a WHERE a.user_id = u.user_id) OR NOT EXISTS (FROM b WHERE b.user_id = u.user_id) THEN 'one side' ELSE 'both' END AS state, max(d.d) AS residual FROM u LEFT JOIN d USING (user_id) GROUP BY u.user_id"""
SQL["classify_marks"] = """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS y0, l_quantity + 1 + l_partkey % 16 AS y1 FROM lineitem),
d AS (SELECT *, list_transform([0, 10, 20, 30, 40, 50], lambda y: abs((y0 + y1) / 2 - y)) AS d FROM m WHERE y1 >= -10 AND y0 <= 60)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN y1 - y0 + 1 < 4 THEN 'short' WHEN y1 - y0 + 1 > 12 THEN 'tall' WHEN list_min(d) > 4 THEN 'off line' END AS dropped,
  list_position(d, list_min(d))::INT AS string FROM d"""
SQL["composite"] = """WITH e AS (SELECT label, (vec_id % 7) * 16 AS o, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, (o + pos)::BIGINT AS x, round(min(v), 6) AS v FROM e GROUP BY ALL"""
_CUT = """keys AS (SELECT user_id, max(epoch_us(ts) // 60000000 - 28000000)::DOUBLE AS e FROM events GROUP BY user_id),
bars AS (SELECT user_id, list_sort(list(DISTINCT (epoch_us(ts) // 60000000 - 28000000)::DOUBLE)) AS bars FROM events WHERE event_type = 'signup' GROUP BY user_id),
notes AS (SELECT user_id, list_sort(list(DISTINCT (epoch_us(ts) // 60000000 - 28000000)::DOUBLE)) AS notes FROM events WHERE event_type <> 'signup' GROUP BY user_id),
base AS (SELECT user_id, e, coalesce(bars, []) AS bars, coalesce(notes, []) AS notes, least(0, coalesce(notes[1], 0)) AS start FROM keys LEFT JOIN bars USING (user_id) LEFT JOIN notes USING (user_id)),
step AS (SELECT user_id, 0 AS r, start AS x0, NULL::DOUBLE AS x1, NULL::BOOLEAN AS split, start AS x, e - start <= W AS done, e, bars, notes FROM base
  UNION ALL
  SELECT user_id, r + 1, x, nx, bar IS NULL, nx, e - nx <= W, e, bars, notes FROM (
    SELECT *, coalesce(bar, list_max(list_transform(list_filter(range(1, len(notes)), lambda k: notes[k] > x AND (notes[k] + notes[k + 1]) / 2 <= x + W), lambda k: (notes[k] + notes[k + 1]) / 2)), x + W) AS nx
    FROM (SELECT *, list_max(list_filter(bars, lambda b: b > x AND b <= x + W)) AS bar FROM step WHERE NOT done))),
cuts AS (SELECT user_id, (r - 1)::INT AS r, x0, x1, split FROM step WHERE r > 0 UNION ALL SELECT user_id, r::INT, x, e, false FROM step WHERE done)
""".replace(" W", " 15000.0::DOUBLE").replace(" 15000.0::DOUBLEHERE", " WHERE").replace(" 15000.0::DOUBLEHEN", " WHEN")
SQL["row_cuts"] = f"WITH RECURSIVE {_CUT} SELECT user_id, r, x0, x1, split FROM cuts"
SQL["notes_in_rows"] = f"""WITH RECURSIVE {_CUT}, l AS (SELECT user_id, max(r) AS last FROM cuts GROUP BY user_id),
n AS (SELECT user_id, event_id, (epoch_us(ts) // 60000000 - 28000000)::DOUBLE AS x FROM events WHERE event_type <> 'signup')
SELECT n.user_id, n.event_id, c.r, round((n.x - c.x0) * 0.25, 6) AS px, (c.r // 12)::BIGINT AS page FROM n JOIN cuts c USING (user_id) JOIN l USING (user_id) WHERE n.x >= c.x0 AND (n.x < c.x1 OR (c.r = l.last AND n.x = c.x1))"""
SQL["digit_labels"] = """SELECT p_partkey, (k - 1)::INT AS pos, substr(p_size::VARCHAR, k::INT, 1) AS digit FROM part, range(1, 4) r(k) WHERE len(p_size::VARCHAR) = 1 + p_partkey % 2 AND k <= len(p_size::VARCHAR)"""
SQL["fret_texts"] = """SELECT p_partkey, CASE WHEN regexp_full_match(t, '0|[1-9][0-9]*') AND try_cast(t AS INT) <= 24 THEN try_cast(t AS INT) END AS fret FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '0' || p_size WHEN 1 THEN p_size || '?' ELSE p_size::VARCHAR END AS t FROM part)"""
SQL["json_validate"] = """WITH b AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"notes": [{"id": ' || event_id || ', "fret": 3}]}' WHEN 1 THEN '{"notes": [{"id": 1, "fret": null}]}' WHEN 2 THEN '{"notes": [{"id": 1, "fret": 25}]}'
  WHEN 3 THEN '{"notes": [{"id": 1, "fret": "3"}]}' WHEN 4 THEN '{"notes": [{"id": 1}]}' WHEN 5 THEN '{"notes": [{"id": 1, "fret": 2, "x": 1}]}' WHEN 6 THEN '{"notes": [{"id": 1, "fret"' WHEN 7 THEN '{"notes": [{"id": 1, "fret": true}]}' ELSE props END AS t FROM events)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 6 THEN 'not JSON' ELSE 'schema' END AS reason FROM b"""
SQL["id_sets"] = """WITH g AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 13 = 0 THEN l_linenumber + 1 ELSE l_linenumber END) AS got, list_transform(range(1, count(*) + 1), lambda x: x::INT) AS want FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, list_sort(list_filter(want, lambda x: NOT list_contains(got, x))) AS missing, list_sort(list_distinct(list_filter(got, lambda x: NOT list_contains(want, x)))) AS extra,
  list_sort(list_distinct(list_filter(got, lambda x: len(list_filter(got, lambda y: y = x)) > 1))) AS repeated FROM g)
SELECT l_orderkey, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, array_to_string(repeated, ',') AS repeated,
  CASE WHEN len(repeated) > 0 THEN 'repeated' WHEN len(missing) > 0 THEN 'missing' WHEN len(extra) > 0 THEN 'extra' END AS reason FROM s"""
SQL["token_cost"] = """SELECT l_returnflag AS role, count(*) AS calls, sum(l_partkey)::BIGINT AS input_tokens, sum(CAST(l_quantity AS BIGINT))::BIGINT AS output_tokens,
  round(sum((l_partkey * p_retailprice + CAST(l_quantity AS BIGINT) * p_size) / 1e6), 4) AS total_usd, round(sum((l_partkey * p_retailprice + CAST(l_quantity AS BIGINT) * p_size) / 1e6) FILTER (WHERE l_linestatus = 'O'), 4) AS new_usd
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag"""
SQL["status_counts"] = "SELECT k.event_type, coalesce(c.n, 0) AS n, coalesce(c.flagged, 0) AS flagged FROM (SELECT DISTINCT event_type FROM events UNION SELECT 'none of these') k LEFT JOIN (SELECT event_type, count(*) AS n, count_if(value > 150)::BIGINT AS flagged FROM events GROUP BY 1) c USING (event_type)"
SQL["url_ids"] = r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS f FROM pages), n AS (SELECT *, regexp_extract(f, '([^/]*)/*$', 1) AS name FROM u)
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN nullif(regexp_extract(url, '(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})', 1), '') ELSE 'unused' END AS video,
  CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem, regexp_matches(url, '^https?://') AS is_url FROM n"""

SQL["even_rows"] = f"""WITH RECURSIVE p AS (SELECT user_id, epoch_us(ts) AS x, row_number() OVER w - 1 AS pos, lag(epoch_us(ts)) OVER w AS b, {', '.join(f'lead(epoch_us(ts), {k}) OVER w AS x{k}' for k in range(1, 7))}
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, (x5 - x) / CAST(5 AS DOUBLE) AS s FROM p),
h AS (SELECT *, coalesce(abs(x1 - x - s) <= 0.8::DOUBLE * s AND {' AND '.join(f'abs(x{k + 1} - x{k} - s) <= 0.8::DOUBLE * s' for k in range(1, 5))}, false)
  AND NOT coalesce(abs(x - b - s) <= 0.8::DOUBLE * s, false) AND NOT coalesce(abs(x6 - x5 - s) <= 0.8::DOUBLE * s, false) AS hit FROM q),
w AS (SELECT user_id, pos, hit AS chosen, CASE WHEN hit THEN 6 ELSE 0 END AS skip FROM h WHERE pos = 0
  UNION ALL SELECT h.user_id, h.pos, h.hit AND w.skip <= 1, CASE WHEN w.skip > 1 THEN w.skip - 1 WHEN h.hit THEN 6 ELSE 0 END FROM w JOIN h ON h.user_id = w.user_id AND h.pos = w.pos + 1)
SELECT h.user_id, h.pos::INT AS pos, h.x AS first, h.x5 AS last, h.s FROM h JOIN w ON h.user_id = w.user_id AND h.pos = w.pos WHERE w.chosen"""
SQL["components"] = """WITH RECURSIVE px AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings),
ink AS (SELECT vec_id, pos, pos % 8 AS x, pos // 8 AS y FROM px WHERE v > 0),
near AS (SELECT a.vec_id, a.pos AS p, b.pos AS q FROM ink a JOIN ink b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(vec_id, seed, pos) AS (SELECT vec_id, pos, pos FROM ink UNION SELECT r.vec_id, r.seed, n.q FROM reach r JOIN near n ON n.vec_id = r.vec_id AND n.p = r.pos),
least AS (SELECT vec_id, pos, min(seed) AS root FROM reach GROUP BY ALL)
SELECT i.vec_id, min(x)::INT AS x0, min(y)::INT AS y0, max(x)::INT AS x1, max(y)::INT AS y1 FROM ink i JOIN least l ON i.vec_id = l.vec_id AND i.pos = l.pos GROUP BY i.vec_id, l.root"""
SQL["anchored_runs_stream"] = "WITH r AS (" + SQL["anchored_runs"] + "), z AS (SELECT *, max(t1) OVER (PARTITION BY user_id) AS z, max(i1) OVER (PARTITION BY user_id, t1) AS zi FROM r) SELECT user_id, i0, i1, n FROM z WHERE NOT (t1 = z AND i1 = zi)"

_LOO = "SELECT a.label, a.vec_id, a.pos, a.v, median(b.v) AS loo FROM {e} a JOIN {e} b ON a.label = b.label AND a.pos = b.pos AND a.vec_id <> b.vec_id GROUP BY ALL"
SQL["template_digits"] = f"""WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
l AS ({_LOO.format(e='e')}), o AS (SELECT vec_id FROM l GROUP BY vec_id HAVING round({_NCC.format(a='v', b='loo')}, 6) < 0.0),
k AS (SELECT * FROM e WHERE vec_id NOT IN (SELECT vec_id FROM o)), c AS (SELECT label FROM k GROUP BY label HAVING count(DISTINCT vec_id) >= 3),
m AS (SELECT k.* FROM k JOIN c USING (label)), own AS ({_LOO.format(e='m')}), t AS (SELECT label AS digit, pos, median(v) AS m FROM m GROUP BY ALL),
s AS (SELECT vec_id, label AS digit, round({_NCC.format(a='v', b='loo')}, 6) AS ncc FROM own GROUP BY ALL
  UNION ALL SELECT vec_id, digit, round({_NCC.format(a='v', b='m')}, 6) FROM e JOIN t USING (pos) WHERE (vec_id, digit) NOT IN (SELECT DISTINCT vec_id, label FROM m) GROUP BY vec_id, digit),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ncc DESC, digit DESC) AS rn FROM s)
SELECT vec_id, max(digit) FILTER (WHERE rn = 1) AS digit, max(ncc) FILTER (WHERE rn = 1) AS best, round(max(ncc) FILTER (WHERE rn = 1) - max(ncc) FILTER (WHERE rn = 2), 6) AS margin,
  max(ncc) FILTER (WHERE rn = 1) >= 0.3 AND round(max(ncc) FILTER (WHERE rn = 1) - max(ncc) FILTER (WHERE rn = 2), 6) >= 0.05 AS accepted FROM r GROUP BY vec_id"""

SQL["grid_readings"] = """WITH c AS (SELECT o_orderkey, unnest([1, 2]) AS id, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, id, CASE WHEN k = 0 AND id = 2 THEN 7 END AS fret, k = 0 AS valid,
  CASE k WHEN 1 THEN 'blocked' WHEN 2 THEN 'candidates' WHEN 3 THEN 'finish' WHEN 4 THEN 'no text' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'schema' WHEN 7 THEN 'ids' END AS reason FROM c"""
SQL["note_frets"] = """WITH t AS (SELECT p_partkey, replace(CAST(p_partkey % 120 AS VARCHAR), '7', '?') AS text FROM part)
SELECT p_partkey, text, CASE WHEN try_cast(text AS INT) <= 24 THEN try_cast(text AS INT) END AS fret FROM t"""

SQL["job_checks"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 11, 'x') WHEN 1 THEN NULL ELSE 'take.' || p_partkey END AS video_id,
  CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 4 THEN 1000 END AS x, CASE p_partkey % 7 WHEN 0 THEN 1920 WHEN 1 THEN 30 WHEN 4 THEN 1000 END AS w,
  CASE WHEN p_partkey % 4 = 1 THEN 'no video id' WHEN p_partkey % 7 = 6 THEN 'no crop' WHEN p_partkey % 7 IN (2, 3, 5) THEN 'bad crop' WHEN p_partkey % 5 = 2 THEN 'no layout'
    WHEN p_partkey % 5 = 1 THEN 'unknown layout' WHEN p_partkey % 11 = 0 THEN 'no frames' WHEN p_partkey % 7 = 4 THEN 'outside' END AS refused FROM part"""


from notegrid.plans import oracles_flow  # noqa: E402

SQL.update(oracles_flow.SQL)
SQL.update(oracles_flow.sheets(_CUT))
