"""DuckDB SQL of the queries over the read stage, the runner, sources, sinks,
layouts and images."""

from __future__ import annotations

SQL: dict[str, str] = {}

_NOTES = """notes AS (SELECT user_id AS video_id, event_id AS id, (1 + event_id % 6)::INT AS string, (event_id % 997)::DOUBLE AS x, (1 + event_id % 2)::INT AS digits, CAST(floor(value) AS INT) % 25 AS own FROM events)"""
_READ = f"""{_NOTES},
paired AS (SELECT *, CASE WHEN id % 13 <> 0 AND id % 7 <> 0 THEN own END AS model, id % 13 <> 0 AND id % 11 <> 0 AS valid,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN own ELSE id % 25 END::INT AS template FROM notes),
firsts AS (SELECT *, CASE WHEN valid AND model IS NOT NULL AND model = template AND len(model::VARCHAR) = digits THEN 'verified' WHEN valid AND model IS NULL AND template IS NULL THEN 'ignored' ELSE 'reread' END AS first FROM paired),
again AS (SELECT *, CASE WHEN first <> 'reread' OR id % 17 = 0 OR id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN own ELSE id % 25 END::INT AS reread, first = 'reread' AND id % 17 <> 0 AND id % 6 <> 0 AS ok FROM firsts),
done AS (SELECT *, CASE WHEN first <> 'reread' THEN first WHEN ok AND reread = template THEN 'verified_reread' ELSE 'flagged' END AS status,
  CASE first WHEN 'reread' THEN coalesce(reread, template, model) WHEN 'ignored' THEN NULL ELSE model END AS fret,
  CASE WHEN first = 'ignored' THEN 'not a number to either reader' WHEN first = 'verified' OR coalesce(ok AND reread = template, false) THEN NULL
    WHEN template IS NULL THEN 'no template reading' WHEN NOT ok THEN 're-read invalid' ELSE 're-read disagrees with the template' END AS reason FROM again)"""
SQL["read_stage"] = f"WITH {_READ} SELECT video_id, id, first, status, fret, reason FROM done"
_COUNTS = "count(*) AS notes, count_if(status = 'verified')::BIGINT AS verified, count_if(status = 'verified_reread')::BIGINT AS verified_reread, count_if(status = 'flagged')::BIGINT AS flagged, count_if(status = 'ignored')::BIGINT AS ignored"
SQL["read_counts"] = f"WITH {_READ} SELECT video_id, {_COUNTS} FROM done GROUP BY video_id"
_FINAL = "final AS (SELECT *, CASE WHEN status = 'flagged' THEN 'flagged' ELSE 'verified' END AS shown FROM done WHERE status <> 'ignored')"
SQL["final_notes"] = f"WITH {_READ}, {_FINAL} SELECT video_id, id, fret, coalesce(fret::VARCHAR, '?') AS text, shown AS status, model, template, reread FROM final"
SQL["tab_documents"] = f"""WITH {_READ}, {_FINAL}, n AS (SELECT video_id, count(*)::INT AS n, min(id) AS first_id FROM final WHERE video_id % 50 <> 0 GROUP BY video_id)
SELECT v.video_id, n, first_id, '0,100' AS bars, CASE WHEN n IS NULL THEN 'no numbers' END AS refused FROM (SELECT DISTINCT user_id AS video_id FROM events) v LEFT JOIN n USING (video_id)"""
SQL["sheet_headers"] = f"""WITH {_READ}, {_FINAL}, h AS (SELECT video_id, count(*) AS notes, count_if(shown = 'verified')::BIGINT AS verified FROM final GROUP BY video_id)
SELECT *, verified || ' of ' || notes || ' numbers verified. Red numbers are flagged: check them against the video.' AS header FROM h"""
SQL["status_texts"] = f"""WITH {_READ} SELECT video_id, count_if(status = 'verified') || ' verified, ' || count_if(status = 'flagged') || ' flagged, ' || count_if(status = 'ignored') || ' ignored' AS line FROM done GROUP BY video_id"""
SQL["call_costs"] = """WITH c AS (SELECT l_returnflag AS role, l_linestatus = 'O' AS new, l_partkey AS i, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END AS o, (l_partkey * p_retailprice + coalesce(CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END, 0) * p_size) / 1e6 AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT role, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(cost), 4) AS total_usd, round(sum(cost) FILTER (WHERE new), 4) AS new_usd FROM c GROUP BY role"""


def _grids(source: str, name: str, most: int = 4) -> str:
    return f"""{name}_o AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM {source}),
{name}_q AS (SELECT *, n // CAST(ceil(n / {most}.0) AS BIGINT) AS q, n % CAST(ceil(n / {most}.0) AS BIGINT) AS r FROM {name}_o),
{name} AS (SELECT video_id, id, (CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END)::INT AS grid FROM {name}_q)"""


SQL["note_grids"] = f"""WITH {_READ}, wanted AS (SELECT video_id, id FROM done WHERE first = 'reread'), {_grids('notes', 'one')}, {_grids('wanted', 'two')}
SELECT 'read' AS role, video_id, grid, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM one GROUP BY ALL
UNION ALL SELECT 'reread', video_id, grid, string_agg(id::VARCHAR, ',' ORDER BY id) FROM two GROUP BY ALL"""
SQL["grid_chain"] = f"""WITH {_NOTES}, {_grids('notes', 'one')}, g AS (SELECT video_id, grid, min(id) AS f FROM one GROUP BY ALL),
t AS (SELECT *, f % 3 <> 0 AS good0, f % 5 <> 4 AND f % 5 <> 3 AND f % 6 <> 0 AS good1, CASE WHEN f % 5 = 4 THEN 'not asked' ELSE 'candidates' END AS why FROM g)
SELECT o.video_id, o.id, CASE WHEN good0 OR good1 THEN (o.id % 25)::INT END AS fret, good0 OR good1 AS valid, CASE WHEN NOT (good0 OR good1) THEN why END AS reason FROM one o JOIN t USING (video_id, grid)"""
SQL["asked_calls"] = "SELECT p_partkey, 'answer to ' || p_partkey AS response FROM part WHERE p_partkey % 3 <> 0"
SQL["cached_lookup"] = """SELECT o_orderkey, substr(sha256(o_orderkey || '{"o_orderpriority":"' || o_orderpriority || '","role":"read"}'), 1, 32) AS key, o_orderkey % 4 = 0 AS new,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS attempt, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END AS valid, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'r0' ELSE 'r1' END AS response FROM orders"""
SQL["reading_maps"] = f"WITH {_NOTES} SELECT video_id, count(*)::INT AS n, coalesce(max(own) FILTER (WHERE id = video_id), -1) AS own_id FROM notes GROUP BY video_id"
SQL["stage_key_rows"] = """WITH f AS (SELECT coalesce(source, 'none') AS video_id, string_agg(doc_id || '=' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id::VARCHAR) AS files FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT video_id, 'rows' AS stage, sha256(files || chr(10) || '3' || chr(10) || '{"a": 1}') AS key FROM f"""
SQL["stage_runs"] = """WITH t AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS video_id, turn FROM nation, range(3) r(turn)),
one AS (SELECT *, CASE WHEN k % 5 = 1 THEN 'refused' WHEN turn = 0 OR k % 4 = 0 THEN 'ran' ELSE 'up to date' END AS state FROM t WHERE turn < 2),
two AS (SELECT t.*, CASE WHEN t.k % 7 = 1 THEN 'refused' WHEN turn IN (0, 2) OR t.k % 4 = 0 THEN 'ran' ELSE 'up to date' END AS state FROM t WHERE turn = 2 OR k % 5 <> 1)
SELECT turn::INT AS turn, video_id, 'ingest' AS stage, state, CASE WHEN state = 'refused' THEN 'bad input' END AS refused FROM one
UNION ALL SELECT turn::INT, video_id, 'rows', state, CASE WHEN state = 'refused' THEN 'bad input' END FROM two"""
SQL["evaluated"] = """WITH p AS (SELECT p_size AS v, p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 24 ELSE p_partkey % 25 END AS said, p_partkey % 25 AS fret, p_partkey % 8 = 0 AS flag FROM part),
vs AS (SELECT DISTINCT v, 'v' || v AS video_id, CASE WHEN v % 11 = 0 AND v % 13 = 0 THEN NULL WHEN v % 11 = 0 THEN 'no truth' WHEN v % 13 = 0 THEN 'no prediction' WHEN v % 17 = 0 THEN 'truth: note' WHEN v % 10 = 0 THEN 'widths' END AS refused FROM p WHERE NOT (v % 11 = 0 AND v % 13 = 0)),
m AS (SELECT v, count_if(k % 7 <> 0)::BIGINT AS matched, count_if(k % 7 = 0)::BIGINT AS missing, count_if(k % 5 = 0)::BIGINT AS extra, count_if(k % 7 <> 0 AND said <> fret)::BIGINT AS wrong_fret,
  (count_if(k % 7 = 0) + count_if(k % 7 <> 0 AND said <> fret AND NOT flag) + count_if(k % 5 = 0 AND NOT flag))::BIGINT AS unflagged_errors, (count_if(k % 7 <> 0 AND said <> fret AND flag) + count_if(k % 5 = 0 AND flag))::BIGINT AS flagged_errors,
  (count_if(k % 7 <> 0 AND flag) + count_if(k % 5 = 0 AND flag))::BIGINT AS flagged, median(CASE WHEN k % 7 <> 0 THEN k % 3 / 1000 END) AS med, max(CASE WHEN k % 7 <> 0 THEN k % 3 / 1000 END) AS worst FROM p GROUP BY v),
r AS (SELECT m.*, matched / nullif(matched + missing, 0) AS recall, matched / nullif(matched + extra, 0) AS prec, (matched - wrong_fret) / nullif(matched, 0) AS fa, unflagged_errors / nullif(matched + missing, 0) AS uf, flagged / nullif(matched + extra, 0) AS fr FROM m JOIN vs USING (v) WHERE vs.refused IS NULL),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN coalesce(recall < 0.99, true) THEN 'recall' END, CASE WHEN coalesce(prec < 0.995, true) THEN 'precision' END, CASE WHEN coalesce(fa < 0.99, true) THEN 'fret_accuracy' END, CASE WHEN coalesce(uf > 0.002, true) THEN 'unflagged_frac' END,
  CASE WHEN coalesce(med > 0.0025, true) THEN 'x_error_median' END, CASE WHEN coalesce(worst > 0.005, true) THEN 'x_error_max' END, CASE WHEN coalesce(fr > 0.05, true) THEN 'flag_rate' END], lambda x: x IS NOT NULL), ',') AS failed FROM r)
SELECT vs.video_id, vs.refused, matched, missing, extra, wrong_fret, unflagged_errors, flagged_errors, round(recall, 6) AS recall, round(med, 6) AS x_error_median, round(fr, 6) AS flag_rate, failed, coalesce(failed = '', false) AS passed FROM vs LEFT JOIN f USING (v)"""
SQL["metric_report"] = """WITH m AS (SELECT event_type, round(avg(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END), 4) AS recall, count(*) AS extra FROM events GROUP BY event_type)
SELECT event_type, 'recall' AS metric, rtrim(printf('%-22s%12s  >= 99.00%%', 'recall', printf('%.4f%%', recall * 100))) AS line, recall < 0.99 AS missed FROM m
UNION ALL SELECT event_type, 'precision', printf('%-22s%12s  >= 99.50%%', 'precision', 'n/a'), true FROM m
UNION ALL SELECT event_type, 'extra', printf('%-22s%12s', 'extra', extra::VARCHAR), false FROM m"""
SQL["escaped_cells"] = """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS cell FROM pages"""
SQL["tab_files"] = """WITH k AS (SELECT n_nationkey % 14 AS k FROM nation),
r AS (SELECT CASE k WHEN 1 THEN 'required' WHEN 2 THEN 'note' WHEN 3 THEN 'note' WHEN 4 THEN 'fret' WHEN 5 THEN 'null fret is not flagged' WHEN 6 THEN 'row' WHEN 7 THEN 'unknown member' WHEN 8 THEN 'status' WHEN 9 THEN 'readers' WHEN 10 THEN 'not JSON' WHEN 11 THEN 'note' WHEN 12 THEN 'status' END AS refused, CASE WHEN k = 10 THEN NULL ELSE 1 END AS n FROM k)
SELECT refused, count(*) AS files, sum(n)::BIGINT AS notes FROM r GROUP BY refused"""
SQL["replaced_tabs"] = "SELECT n_name AS video_id, n_nationkey + 10.0::DOUBLE + CASE WHEN n_nationkey >= 20 THEN 20 ELSE 0 END AS tab_width_px, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS fret FROM nation"
SQL["draft_rounds"] = """SELECT n_name AS video_id, n_nationkey + 10.0::DOUBLE + CASE WHEN n_nationkey < 5 THEN 0 ELSE 100 END AS tab_width_px, (1 + n_nationkey % 6)::INT AS string, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS fret
FROM nation WHERE n_nationkey + 10 <= 30"""
SQL["recorded_calls"] = """SELECT 'key' || n_nationkey AS key, 'read' AS role, 0 AS attempt, n_nationkey AS first, '{"said":"' || n_name || '"}' AS response FROM nation WHERE n_nationkey % 2 = 0"""
SQL["dated_results"] = "SELECT r_regionkey, r_name, true AS today, true AS timed FROM region"
SQL["prompt_digests"] = """SELECT r_regionkey, sha256('Read the numbers.' || r_name || '{"a":[2,{"c":"x","d":null}],"b":1}') AS digest FROM region"""
SQL["argument_files"] = "SELECT n_name AS video_id, '--crop|0,0,' || n_nationkey || ',9|--layout|paged strip|' || n_name AS args FROM nation"
SQL["report_pages"] = """SELECT '<!doctype html><html><head><meta charset=''utf-8''><title>A &amp; B</title></head><body><h1>A &amp; B</h1><h2>Regions</h2><table><tr><th>r_regionkey</th><th>name</th><th>none</th><th>half</th></tr>'
  || string_agg('<tr><td>' || r_regionkey || '</td><td>&lt;' || r_name || '&gt;</td><td>none</td><td>' || printf('%.3f', r_regionkey / 2) || '</td></tr>', '' ORDER BY r_regionkey) || '</table></body></html>' AS page FROM region"""
_VIDEO = """v AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS video_id, 3 + s_suppkey % 9 AS made, s_suppkey % 10 = 7 AS odd, s_suppkey % 10 = 6 AS bare FROM supplier)"""
SQL["video_probe"] = f"""WITH {_VIDEO} SELECT video_id, CASE WHEN NOT odd THEN 4 END AS width, CASE WHEN NOT odd THEN 2 END AS height, CASE WHEN NOT odd THEN (2 + k % 3)::DOUBLE END AS fps,
  CASE WHEN odd OR bare THEN 0 ELSE made END AS frames, CASE WHEN odd THEN 'unreadable' WHEN bare THEN 'no frames' END AS refused FROM v"""
SQL["frame_scan"] = f"""WITH {_VIDEO}, w AS (SELECT v.*, f, CASE WHEN odd OR bare THEN 0 ELSE made END AS n FROM v, (VALUES (1), (4), (6)) t(f)),
early AS (SELECT video_id, odd, min(f) AS f FROM w WHERE f >= n GROUP BY ALL)
SELECT video_id, f::BIGINT AS frame, 2 AS h, 4 AS w, repeat(printf('%02X', f), 8) AS px, NULL AS refused FROM w WHERE f < n
UNION ALL SELECT video_id, f, NULL, NULL, NULL, CASE WHEN odd THEN 'unreadable' ELSE 'ended early' END FROM early"""
SQL["frame_samples"] = f"""WITH {_VIDEO}, s AS (SELECT video_id, j, least(CAST(floor(j / 3.0::DOUBLE * (2 + k % 3) + 0.5) AS BIGINT), made - 1) AS f FROM v, range(0, 40) r(j) WHERE NOT odd AND NOT bare AND j / 3.0::DOUBLE < made / (2 + k % 3)::DOUBLE)
SELECT video_id, j::INT AS k, f AS frame, 2 AS h, 2 AS w, repeat(printf('%02X', f), 4) AS px FROM s"""
SQL["job_sources"] = """WITH j AS (SELECT p_partkey AS k, 'video' || lpad(p_partkey::VARCHAR, 6, '0') AS name FROM part), u AS (SELECT *, k % 3 <> 0 AS url, k % 2 = 0 AS here FROM j)
SELECT k AS p_partkey, CASE WHEN here THEN '/held/' || name END AS path, url AND NOT here AS fetch, CASE WHEN NOT url AND NOT here THEN 'no file' END AS refused,
  CASE WHEN url AND NOT here AND k % 10 <> 5 THEN len('https://youtu.be/' || name) END::INT AS bytes, CASE WHEN url AND NOT here AND k % 10 = 5 THEN 'download: gone' END AS failed FROM u"""
SQL["output_paths"] = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'sheets/' || p_partkey || '.pdf' ELSE 'out/take' || p_partkey || '.pdf' END AS path FROM part"
SQL["row_geometry"] = """WITH r AS (SELECT p_partkey AS k, p_size AS z, 20 + p_partkey % 30 AS b1, 200 + p_partkey % 50 AS b2, p_partkey % 5 = 0 AS bare, 60 + p_partkey % 90 AS h FROM part),
o AS (SELECT *, CASE WHEN NOT bare AND b1 - 20 <= 12 THEN b1 ELSE 20 END AS origin FROM r)
SELECT k AS p_partkey, origin::DOUBLE AS origin, CASE WHEN NOT bare AND (210 + z - origin) - (b2 - origin) <= 12 THEN b2 - origin ELSE 210 + z - origin END::DOUBLE AS "end",
  greatest(CAST(floor(z * 1.5) AS INT) - 24, 0) AS top, least(CAST(floor(z * 1.5 + 50) AS INT) + 24, h)::INT AS bottom FROM o"""
SQL["shared_bars"] = """WITH p AS (SELECT p_partkey AS k, p_size AS z, p_size % 60 AS dx, greatest(0, p_size % 7 + p_size % 60) AS low, least(100 + p_size, 90 + p_size % 60) AS high FROM part),
b AS (SELECT *, list_filter([z, 2 * z, 3 * z, 100], lambda x: x >= low AND x <= high) AS a, list_filter([k % 50 + dx, k % 80 + dx, 90 + dx], lambda x: x >= low AND x <= high) AS b FROM p)
SELECT k AS p_partkey, array_to_string(a, ',') AS bars_a, array_to_string(b, ',') AS bars_b FROM b"""
SQL["page_frames"] = """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 / 4 AS a, p_partkey % 4 / 4 + p_size / 10 AS b FROM part),
f AS (SELECT *, CAST(ceil((a + 0.25) * 12) AS BIGINT) AS low, least(CAST(floor((b - 0.25) * 12) AS BIGINT), 54) AS high FROM p),
n AS (SELECT *, CASE WHEN high < low THEN 0 ELSE least(31, high - low + 1) END AS n FROM f)
SELECT k AS video_id, CASE WHEN k % 9 <> 0 THEN n END::INT AS n, CASE WHEN k % 9 <> 0 AND n > 0 THEN low END AS first, CASE WHEN k % 9 <> 0 AND n > 0 THEN CASE WHEN n = 1 THEN low ELSE high END END AS last, CASE WHEN k % 9 = 0 THEN 'no page' WHEN n < 5 THEN 'few frames' END AS refused FROM n"""
SQL["grid_cells"] = f"""WITH src AS (SELECT o_custkey AS video_id, o_orderkey AS id FROM orders), {_grids('src', 'g', 10)}, c AS (SELECT *, row_number() OVER (PARTITION BY video_id, grid ORDER BY id) - 1 AS cell FROM g)
SELECT video_id AS o_custkey, id AS o_orderkey, grid, (8 + 66 * (cell % 4))::INT AS x, (28 + 100 * (cell // 4))::INT AS y FROM c"""


def sheets(cut: str) -> dict[str, str]:
    """The queries over sheets, from the common tables that cut the rows."""
    x = "(epoch_us(ts) // 60000000 - 28000000)::DOUBLE"
    base = f"""WITH RECURSIVE {cut}, l AS (SELECT user_id, max(r) AS last FROM cuts GROUP BY user_id),
n AS (SELECT user_id, event_id, {x} AS x FROM events WHERE event_type <> 'signup'),
p AS (SELECT n.user_id AS video_id, n.event_id AS id, c.r, (c.r // 12)::BIGINT AS page, CASE WHEN n.event_id % 9 > 0 THEN (n.event_id % 25)::VARCHAR ELSE '?' END AS text, round(36 + (n.x - c.x0) * (540 / 15000.0::DOUBLE), 4) AS x,
  round(724.6 - ((c.r % 12) * 57 + (n.event_id % 6) * 7), 4) AS y, n.event_id % 4 = 0 AS flagged
  FROM n JOIN cuts c USING (user_id) JOIN l USING (user_id) WHERE n.x >= c.x0 AND (n.x < c.x1 OR (c.r = l.last AND n.x = c.x1))),
b AS (SELECT DISTINCT user_id, {x} AS bar FROM events WHERE event_type = 'signup')"""
    return {
        "sheet_numbers": f"{base} SELECT * FROM p",
        "sheet_bars": f"{base} SELECT c.user_id AS video_id, c.r, round(36 + (bar - c.x0) * (540 / 15000.0::DOUBLE), 4) AS x FROM b JOIN cuts c ON b.user_id = c.user_id AND bar >= c.x0 AND bar <= c.x1",
        "flagged_rows": f"{base}, f AS (SELECT video_id, r, count(*) AS notes, count_if(flagged)::BIGINT AS flagged FROM p GROUP BY ALL) SELECT c.user_id AS video_id, c.r, split, coalesce(notes, 0) AS notes, coalesce(flagged, 0) AS flagged FROM cuts c LEFT JOIN f ON f.video_id = c.user_id AND f.r = c.r WHERE coalesce(flagged, 0) > 0 OR split",
        "sheet_files": f"{base}, c AS (SELECT user_id AS video_id, (max(r) // 12 + 1)::INT AS pages FROM cuts GROUP BY user_id), m AS (SELECT video_id, count(*) AS numbers, count_if(flagged)::BIGINT AS red FROM p GROUP BY video_id) SELECT video_id, pages, true AS pdf, coalesce(numbers, 0) AS numbers, coalesce(red, 0) AS red, pages::BIGINT AS objects FROM c LEFT JOIN m USING (video_id)",
    }


SQL["plot_places"] = "SELECT event_id, CAST(round_even(119 * log10(least(greatest(value / 1000, 1e-4), 1.0)) / log10(1e-4), 0) AS INT) AS y FROM events"
SQL["html_pictures"] = "SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(coalesce(text, ''))) AS src FROM documents"

_LINES = """g AS (SELECT s_suppkey AS v, 8 + s_suppkey % 5 AS gap, 15 + s_suppkey % 4 AS l, 250 + s_suppkey % 9 AS r, 230 + s_suppkey % 7 AS e FROM supplier),
b AS (SELECT *, list_concat(list_concat(CASE WHEN v % 2 = 0 THEN [[l + 3, l + 3]] ELSE [] END, CASE WHEN v % 3 = 0 THEN [[180, 183]] ELSE [] END), [[e, e]]) AS bars FROM g)"""
SQL["staff_rows"] = f"""WITH {_LINES}
SELECT v AS video_id, 0 AS row, array_to_string(list_transform(range(6), lambda k: printf('%.1f', (20.5 + gap * k)::DOUBLE)), ',') AS line_y, gap::DOUBLE AS s, l || '.0,' || r || '.0' AS extent,
  array_to_string(list_transform(flatten(bars), lambda x: x || '.0'), ',') AS bar_spans, array_to_string(list_transform(bars, lambda x: printf('%.1f', ((x[1] + x[2]) / 2)::DOUBLE)), ',') AS bar_x, CASE WHEN v % 2 = 0 THEN l + 3 ELSE l END::DOUBLE AS origin_x FROM b"""
SQL["staff_notes"] = f"""WITH {_LINES}, o AS (SELECT *, CASE WHEN v % 2 = 0 THEN l + 3 ELSE l END AS o, 7 * gap // 10 AS h FROM b),
n AS (SELECT v, o, 2 AS string, 60 + v % 11 AS x0, 68 + v % 11 AS x1, 2 AS digits, 21 + gap - h // 2 AS y0, h FROM o UNION ALL SELECT v, o, 6, 100, 104, 1, 21 + 5 * gap - h // 2, h FROM o UNION ALL SELECT v, o, 1, 130 + v % 3, 133 + v % 3, 1, 21 - h // 2, h FROM o)
SELECT v AS video_id, (row_number() OVER (PARTITION BY v ORDER BY x0 + x1, string) - 1)::INT AS id, string, ((x0 + x1) / 2 - o)::DOUBLE AS x, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, (y0 + h - 1)::INT AS y1, digits FROM n"""
_SAMPLES = """s AS (SELECT s_suppkey AS v, 3 + s_suppkey % 6 AS d, k, k // (3 + s_suppkey % 6) AS page, k % (3 + s_suppkey % 6) AS inside FROM supplier, range(24) r(k))"""
SQL["page_changes"] = f"""WITH {_SAMPLES} SELECT v AS video_id, k::INT AS k, CASE WHEN k = 0 THEN 0.0 WHEN inside = 0 THEN 1.0 WHEN v % 7 = 0 THEN 0.01 ELSE 0.0 END::DOUBLE AS change FROM s"""
SQL["still_runs"] = f"""WITH {_SAMPLES}, c AS (SELECT *, CASE WHEN v % 7 = 0 THEN inside // 3 ELSE 0 END AS part FROM s),
r AS (SELECT v, page, part, min(k) AS k0, max(k) AS k1, count(*) AS n FROM c GROUP BY ALL)
SELECT v AS video_id, k0::INT AS k0, k1::INT AS k1, k1 / 4.0::DOUBLE AS t_end, n::INT AS n FROM r WHERE (k1 - k0) / 4.0 >= 1.0"""
SQL["stitched"] = """SELECT s_suppkey AS video_id, f AS fits, CASE WHEN f THEN 120 + s_suppkey % 40 END::INT AS shift, CASE WHEN f THEN 180 - s_suppkey % 40 END::INT AS overlap, CASE WHEN f THEN 1.0::DOUBLE END AS ncc, CASE WHEN f THEN 'both' END AS state, CASE WHEN f THEN 0.0::DOUBLE END AS residual
FROM (SELECT *, s_suppkey % 5 <> 0 AS f FROM supplier)"""
SQL["canvases"] = """WITH s AS (SELECT s_suppkey AS v, 5 + s_suppkey % 20 AS d, 100 + s_suppkey % 50 AS a, 80 + s_suppkey % 60 AS b FROM supplier)
SELECT v AS video_id, 4 AS h, (30 + d)::INT AS w, 4 * (d * a + (30 - d) * least(a, b) + d * b) AS total FROM s"""
SQL["page_faults"] = "SELECT s_suppkey AS video_id, CASE s_suppkey % 5 WHEN 1 THEN 'dark' WHEN 2 THEN 'rows' WHEN 3 THEN 'moved' END AS refused FROM supplier"
SQL["note_pictures"] = """WITH n AS (SELECT s_suppkey AS v, i, CASE WHEN i = 0 THEN 0 ELSE 40 + s_suppkey % 5 END AS x0, 3 + s_suppkey % 9 AS wide, 26 + s_suppkey % 4 AS y1 FROM supplier, range(2) r(i)),
c AS (SELECT *, x0 + wide + 3 - greatest(x0 - 3, 0) + 1 AS cw, y1 + 3 - 17 + 1 AS ch FROM n)
SELECT v AS video_id, i::INT AS id, 64 AS h, CAST(round_even(cw * 64 / ch::DOUBLE, 0) AS INT) AS w, (30 + v % 200)::DOUBLE AS level FROM c"""
SQL["motion_copies"] = "SELECT s_suppkey AS video_id, 3 AS h, 4 AS w, 6 * (s_suppkey % 200) + 6 * (50 + s_suppkey % 200) AS total FROM supplier"
SQL["digit_pictures"] = """WITH d AS (SELECT s_suppkey AS v, 1 + s_suppkey % 13 AS w, 5 + s_suppkey % 17 AS h FROM supplier)
SELECT v AS video_id, 32 AS h, 32 AS w, CAST(greatest(1, round_even(w * 32 / greatest(w, h)::DOUBLE, 0)) * greatest(1, round_even(h * 32 / greatest(w, h)::DOUBLE, 0)) AS BIGINT) AS covered FROM d"""
SQL["grid_pictures"] = f"""WITH src AS (SELECT s_suppkey AS video_id, i AS id, 20 + (s_suppkey + i) % 30 AS w FROM supplier, range(11) r(i) WHERE i < 1 + s_suppkey % 11), {_grids('src', 'g', 6)},
m AS (SELECT g.video_id, grid, count(*) AS n, max(w) AS w FROM g JOIN src USING (video_id, id) GROUP BY ALL)
SELECT video_id, grid, (CAST(ceil(n / 4.0) AS INT) * 100)::INT AS h, (least(n, 4) * (w + 16))::INT AS w FROM m"""
SQL["png_pictures"] = "SELECT s_suppkey AS video_id, 6 AS h, (5 + s_suppkey % 4)::INT AS w, 6 * (5 + s_suppkey % 4) * (s_suppkey % 251) AS total, NULL AS refused, true AS overlaid FROM supplier"
SQL["merge_pages"] = """WITH RECURSIVE o AS (SELECT label, vec_id // 256 AS video, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label, vec_id // 256 ORDER BY vec_id) AS k FROM embeddings),
w AS (SELECT label, video, k, vec_id, 1 AS run, [e] AS held, e AS mid FROM o WHERE k = 1
  UNION ALL SELECT label, video, k, vec_id, CASE WHEN near THEN run ELSE run + 1 END, held, CASE WHEN len(held) = 1 THEN held[1] ELSE list_transform(range(1, 65), lambda p: list_median(list_transform(held, lambda m: m[p]))) END
  FROM (SELECT label, video, k, vec_id, run, near, CASE WHEN near THEN list_append(held, e) ELSE [e] END AS held
    FROM (SELECT o.label, o.video, o.k, o.vec_id, w.run, w.held, o.e,
      coalesce(list_sum(list_transform(range(1, 65), lambda p: (w.mid[p] - list_avg(w.mid)) * (o.e[p] - list_avg(o.e)))) / nullif(sqrt(list_sum(list_transform(w.mid, lambda x: (x - list_avg(w.mid)) * (x - list_avg(w.mid)))) * list_sum(list_transform(o.e, lambda x: (x - list_avg(o.e)) * (x - list_avg(o.e))))), 0), 0) >= 0.1 AS near
      FROM w JOIN o ON o.label = w.label AND o.video = w.video AND o.k = w.k + 1)))
SELECT label, video, min(vec_id) AS a, max(vec_id) AS b, count(*)::INT AS n FROM w GROUP BY label, video, run"""
