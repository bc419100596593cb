"""Filters, joins, set operations, aggregations, windows and top-k over sets and plays.

Each query is declared once as SQL; Catalyst picks the physical plan. Orders within a set are total, group
keys are never null where the semantics drop nulls, and nulls' places are always stated.
"""

from __future__ import annotations

from setloom.plans.registry import shared

PAIRS = """pairs AS (
  SELECT set_id, position, track_id AS a, lead(track_id) OVER (PARTITION BY set_id ORDER BY position) AS b FROM plays
)"""

# the flagship: consecutive tracks, a label for each hand-over, shares by genre with the total
shared(
    "flagship_transition_shares",
    f"""WITH {PAIRS}, moves AS (
      SELECT s.genre, CASE WHEN tb.bpm / ta.bpm > 1.2 AND tb.energy > ta.energy THEN 'rise' WHEN tb.bpm / ta.bpm < 0.8 THEN 'fade'
        WHEN abs(tb.energy - ta.energy) <= 5 THEN 'blend' ELSE 'wave' END AS label
      FROM pairs p JOIN sets s ON p.set_id = s.set_id JOIN tracks ta ON p.a = ta.track_id JOIN tracks tb ON p.b = tb.track_id WHERE p.a <> p.b
    ), counted AS (SELECT genre, label, count(*) AS n FROM moves GROUP BY GROUPING SETS ((genre, label), (label)))
    SELECT coalesce(genre, 'All') AS genre, label, n, round(n * 100.0E0 / sum(n) OVER (PARTITION BY genre), 6) AS share FROM counted""",
)

# 2.1 scans that SQL can state
shared("s02_typed_projection", "SELECT CAST(l_orderkey AS BIGINT) AS set_id, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_quantity > 45")
shared("s03_pruned_scan", "SELECT p_partkey, p_retailprice FROM part WHERE p_size = 10")
shared("s04_latest_version", "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
shared("s13_keyed_delete", "SELECT set_id, position, track_id FROM plays WHERE set_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
shared("s14_upsert_by_group", "SELECT o_orderkey, o_totalprice, 'old' AS version FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, 'new' AS version FROM orders WHERE o_orderstatus = 'P'")
shared("s17_last_write_wins", "SELECT series_id, max_by(kind, event_id) AS kind, max(event_id) AS event_id FROM votes GROUP BY series_id")
shared("s18_provenance_counts", "SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lineitem' AS source, count(*) AS n FROM lineitem UNION ALL SELECT 'part' AS source, count(*) AS n FROM part")
shared("s19_manifest", "SELECT DISTINCT t.track_id, CASE WHEN t.artist LIKE '%1' THEN 'preview' WHEN t.artist LIKE '%2' THEN 'full' ELSE 'other' END AS source FROM tracks t JOIN plays p ON p.track_id = t.track_id")

# 2.2 filters
shared("p01_group_size_filter", "WITH sized AS (SELECT *, count(track_id) OVER (PARTITION BY set_id) AS n FROM plays) SELECT set_id, position, track_id, n FROM sized WHERE n BETWEEN 4 AND 30")
shared("p02_anti_predicate_keeps_nulls", "SELECT event_id, kind FROM votes WHERE NOT coalesce(kind = 'view', FALSE)")
shared("p03_drop_nulls", "SELECT event_id, votes FROM votes WHERE votes IS NOT NULL AND kind IS NOT NULL")
shared("p05_inclusive_range", "SELECT track_id, bpm FROM tracks WHERE bpm BETWEEN 910 AND 1400")
shared("p06_percentile_floor", "WITH pool AS (SELECT track_id, energy FROM tracks WHERE bpm < 1500), f AS (SELECT percentile(energy, 0.6E0) AS lo FROM pool) SELECT track_id, energy FROM pool CROSS JOIN f WHERE energy >= lo",
       "WITH pool AS (SELECT track_id, energy FROM tracks WHERE bpm < 1500), f AS (SELECT quantile_cont(energy, 0.6) AS lo FROM pool) SELECT track_id, energy FROM pool CROSS JOIN f WHERE energy >= lo")
shared("p07_minimum_pool", "WITH pool AS (SELECT style, count(*) AS n FROM tracks GROUP BY style) SELECT style, n, n < 5 AS too_small FROM pool")
shared("p08_membership", "SELECT track_id FROM tracks WHERE track_id IN (SELECT track_id FROM plays WHERE qty > 48) AND track_id NOT IN (SELECT track_id FROM plays WHERE qty < 3)")
shared("p09_quality_predicate", "SELECT set_id, position FROM plays WHERE qty > 10 AND discount > 0.02E0 AND shipped IS NOT NULL AND position IN (0, 1, 2)")
shared("p11_tier_assignment", "SELECT set_id, CASE WHEN genre LIKE '1%' AND total > 100000 THEN 'tier1' WHEN genre LIKE '1%' OR genre LIKE '2%' THEN 'tier2' WHEN total > 200000 THEN 'tier3' ELSE 'none' END AS tier FROM sets")
shared("p12_usable_times", "WITH x AS (SELECT series_id, votes, lag(votes) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS before FROM votes) SELECT series_id, count(votes) >= 5 AND max(votes) > 0 AND bool_and(coalesce(before <= votes, TRUE)) AS usable, count(votes) AS n FROM x GROUP BY series_id")
shared("p13_exclusion_list", "SELECT s.set_id FROM sets s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.dj_id AND c.c_mktsegment = 'BUILDING')")
shared("p14_select_by_class", f"WITH {PAIRS}, c AS (SELECT set_id, position, CASE WHEN b IS NULL THEN 'end' WHEN a = b THEN 'loop' WHEN b > a THEN 'up' ELSE 'down' END AS class FROM pairs) SELECT * FROM c WHERE class IN ('end', 'loop')")
shared("p16_schema_repair", "SELECT track_id, title AS name, CAST(NULL AS DOUBLE) AS loudness, energy FROM tracks")

# 2.3 joins
shared("j01_inner_merge", "SELECT t.track_id, t.bpm, p.set_id FROM tracks t JOIN plays p ON t.track_id = p.track_id WHERE p.position = 0")
shared("j02_left_lookup", "SELECT s.set_id, c.c_name AS dj FROM sets s LEFT JOIN (SELECT c_custkey, min(c_name) AS c_name FROM customer GROUP BY c_custkey) c ON s.dj_id = c.c_custkey")
shared("j03_left_merge_provenance", "SELECT t.track_id, coalesce(x.best, t.bpm) AS bpm, CASE WHEN x.best IS NOT NULL THEN 'measured' ELSE 'listed' END AS bpm_source FROM tracks t LEFT JOIN (SELECT track_id, label_id, max(price) AS best FROM plays WHERE qty > 40 GROUP BY track_id, label_id) x ON t.track_id = x.track_id AND x.label_id = t.energy")
shared("j04_inner_filter", "SELECT p.set_id, p.position FROM plays p JOIN sets s ON p.set_id = s.set_id WHERE s.genre = '1-URGENT'")
shared("j05_outer_accumulate", "WITH a AS (SELECT dj_id AS id, count(*) AS n, 'a' AS measured FROM sets GROUP BY dj_id), b AS (SELECT s_suppkey AS id, s_acctbal AS bal, 'b' AS measured FROM supplier) SELECT coalesce(a.id, b.id) AS id, a.n, b.bal, CASE WHEN b.id IS NOT NULL THEN b.measured ELSE a.measured END AS measured FROM a FULL OUTER JOIN b ON a.id = b.id")
shared("j06_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
shared("j07_anti_resume", "SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 49)")
shared("j08_not_exists_either", f"WITH {PAIRS}, used AS (SELECT a AS t FROM pairs WHERE position = 4 AND b IS NOT NULL UNION SELECT b AS t FROM pairs WHERE position = 4 AND b IS NOT NULL) SELECT track_id FROM tracks WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.t = tracks.track_id)")
shared("j09_three_way", f"WITH {PAIRS} SELECT p.set_id, p.position, ta.artist AS artist_a, tb.artist AS artist_b FROM pairs p JOIN tracks ta ON p.a = ta.track_id JOIN tracks tb ON p.b = tb.track_id WHERE ta.energy > 25 AND tb.energy > 25")
shared("j14_interval_overlap", "WITH w AS (SELECT set_id, position, qty AS t0, qty + 10 AS t1 FROM plays) SELECT a.set_id, a.position AS p, b.position AS other FROM w a JOIN w b ON a.set_id = b.set_id AND a.position < b.position AND b.t0 < a.t1 AND b.t1 > a.t0")
shared("j17_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
shared("j18_unordered_pairs", "WITH d AS (SELECT DISTINCT s.dj_id, p.track_id FROM plays p JOIN sets s ON p.set_id = s.set_id) SELECT x.dj_id AS dj_a, y.dj_id AS dj_b, count(*) AS shared_tracks FROM d x JOIN d y ON x.track_id = y.track_id AND x.dj_id < y.dj_id GROUP BY x.dj_id, y.dj_id HAVING count(*) >= 4")
shared("j19_parent_resolve", "SELECT c.set_id, c.position, p.track_id AS parent FROM plays c LEFT JOIN plays p ON c.set_id = p.set_id AND p.position = c.position - 1")
# names are counted before they are joined, so that no pairs are made of a common one
shared("j20_normalised_names", "WITH x AS (SELECT track_id, regexp_replace(lower(title), '[^a-z0-9]', '') AS name FROM tracks), c AS (SELECT name, count(*) AS n FROM x GROUP BY name) SELECT x.track_id, sum(c.n) AS n FROM x JOIN c ON x.name = c.name GROUP BY x.track_id",
       "SELECT a.track_id, count(*) AS n FROM tracks a JOIN tracks b ON regexp_replace(lower(a.title), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.title), '[^a-z0-9]', '', 'g') GROUP BY a.track_id")
shared("j23_precedence_union", "WITH u AS (SELECT track_id, price AS v, 1 AS rank FROM plays WHERE qty > 45 UNION ALL SELECT track_id, bpm AS v, 2 AS rank FROM tracks), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rank, v) AS k FROM u) SELECT track_id, v, rank FROM r WHERE k = 1")
shared("j24_reindex", "SELECT p.set_id, p.track_id, w.weight FROM plays p LEFT JOIN (SELECT set_id, track_id, max(qty) AS weight FROM plays WHERE qty > 20 GROUP BY set_id, track_id) w ON p.set_id = w.set_id AND p.track_id = w.track_id")

# 2.4 aggregations
shared("a01_counts", "SELECT kind, count(*) AS n FROM votes GROUP BY kind")
shared("a02_count_distinct", "SELECT s.dj_id, count(DISTINCT p.track_id) AS n FROM plays p JOIN sets s ON p.set_id = s.set_id GROUP BY s.dj_id")
shared("a03_multi_aggregate", "SELECT s.dj_id, count(DISTINCT s.set_id) AS sets, count(p.track_id) AS tracks, min_by(s.genre, s.set_id) AS first_genre FROM sets s JOIN plays p ON s.set_id = p.set_id GROUP BY s.dj_id")
shared("a04_shares", "WITH c AS (SELECT genre, setting, count(*) AS n FROM sets GROUP BY genre, setting), g AS (SELECT DISTINCT genre FROM sets), k AS (SELECT DISTINCT setting FROM sets) SELECT g.genre, k.setting, coalesce(c.n, 0) / CAST(sum(c.n) OVER (PARTITION BY g.genre) AS DOUBLE) AS share FROM g CROSS JOIN k LEFT JOIN c ON c.genre = g.genre AND c.setting = k.setting")
shared("a05_crosstab", "SELECT genre, count(*) AS n, avg(CASE WHEN setting = 'F' THEN 1.0E0 ELSE 0 END) AS f, avg(CASE WHEN setting = 'O' THEN 1.0E0 ELSE 0 END) AS o, avg(CASE WHEN setting = 'P' THEN 1.0E0 ELSE 0 END) AS p FROM sets GROUP BY genre")
shared("a06_mean_median_std", "SELECT kind, round(avg(votes), 6) AS mean, median(votes) AS median, round(stddev_samp(votes), 6) AS std_sample, round(stddev_pop(votes), 6) AS std_population FROM votes GROUP BY kind")
shared("a07_quantiles", "SELECT kind, percentile(votes, 0.1E0) AS q10, percentile(votes, 0.5E0) AS q50, percentile(votes, 0.9E0) AS q90 FROM votes GROUP BY kind", "SELECT kind, quantile_cont(votes, 0.1) AS q10, quantile_cont(votes, 0.5) AS q50, quantile_cont(votes, 0.9) AS q90 FROM votes GROUP BY kind")
shared("a08_mode_smallest", "WITH c AS (SELECT set_id, label_id, count(*) AS n FROM plays GROUP BY set_id, label_id), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, label_id) AS k FROM c) SELECT set_id, label_id, n FROM r WHERE k = 1")
shared("a09_mode_first_seen", "WITH c AS (SELECT series_id, kind, count(*) AS n, min(event_id) AS seen FROM votes GROUP BY series_id, kind), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, seen) AS k FROM c) SELECT series_id, kind, n FROM r WHERE k = 1")
shared("a11_weighted_median", "WITH c AS (SELECT set_id, label_id AS spot, sum(qty) AS w FROM plays GROUP BY set_id, label_id), r AS (SELECT set_id, spot, sum(w) OVER (PARTITION BY set_id ORDER BY spot ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY set_id) AS total FROM c) SELECT set_id, min(spot) AS median_at FROM r WHERE upto * 2 >= total GROUP BY set_id")
shared("a12_within_tolerance", "SELECT p.set_id, count(CASE WHEN abs(p.qty - f.qty) <= 5 THEN 1 END) AS near_first FROM plays p JOIN plays f ON p.set_id = f.set_id AND f.position = 0 GROUP BY p.set_id")
shared("a13_control_floor", "SELECT series_id, greatest(4, CAST(ceil(2 * max(CASE WHEN kind = 'error' THEN votes END)) AS BIGINT)) AS floor, count(CASE WHEN kind = 'error' THEN 1 END) >= 3 AS trusted FROM votes GROUP BY series_id")
shared("a14_separation", "SELECT series_id, round(max(votes) / greatest(4, ceil(2 * max(CASE WHEN kind = 'error' THEN votes END))), 2) AS separation FROM votes GROUP BY series_id")
shared("a15_upper_median", "WITH r AS (SELECT set_id, qty, row_number() OVER (PARTITION BY set_id ORDER BY qty) AS k, count(*) OVER (PARTITION BY set_id) AS n FROM plays) SELECT set_id, max(qty) AS upper_median FROM r WHERE k = floor(n / 2) + 1 GROUP BY set_id")
shared("a16_conditional_counts", "SELECT s.genre, count(CASE WHEN p.qty > 25 THEN 1 END) AS found, count(CASE WHEN p.qty > 40 AND p.discount < 0.05E0 THEN 1 END) AS confident FROM plays p JOIN sets s ON p.set_id = s.set_id GROUP BY s.genre")
shared("a17_set_collect", "SELECT set_id, array_join(array_sort(collect_set(track_id)), ' ') AS tracks FROM plays GROUP BY set_id", "SELECT set_id, array_to_string(list_sort(list(DISTINCT track_id)), ' ') AS tracks FROM plays GROUP BY set_id")
shared("a18_group_share", "SELECT s.genre, round(avg(CASE WHEN p.qty >= 32 THEN 100.0E0 ELSE 0 END), 6) AS pct FROM plays p JOIN sets s ON p.set_id = s.set_id GROUP BY s.genre")
shared("a19_first_second_gap", "WITH r AS (SELECT dj_id, played_on, row_number() OVER (PARTITION BY dj_id ORDER BY played_on, set_id) AS k FROM sets) SELECT dj_id, datediff(max(CASE WHEN k = 2 THEN played_on END), max(CASE WHEN k = 1 THEN played_on END)) / 30.4E0 AS months FROM r GROUP BY dj_id HAVING count(*) >= 2",
       "WITH r AS (SELECT dj_id, played_on, row_number() OVER (PARTITION BY dj_id ORDER BY played_on, set_id) AS k FROM sets) SELECT dj_id, date_diff('day', max(CASE WHEN k = 1 THEN played_on END), max(CASE WHEN k = 2 THEN played_on END)) / 30.4E0 AS months FROM r GROUP BY dj_id HAVING count(*) >= 2")
shared("a20_eta_squared", "WITH t AS (SELECT avg(votes) AS m, var_pop(votes) * count(votes) AS ss FROM votes), g AS (SELECT kind, count(votes) AS n, avg(votes) AS gm FROM votes WHERE votes IS NOT NULL GROUP BY kind) SELECT round(sum(n * (gm - m) * (gm - m)) / max(ss), 6) + 0.0E0 AS eta2 FROM g CROSS JOIN t")
shared("a21_cramers_v", "WITH o AS (SELECT genre, setting, count(*) AS n FROM sets GROUP BY genre, setting), r AS (SELECT genre, sum(n) AS rn FROM o GROUP BY genre), c AS (SELECT setting, sum(n) AS cn FROM o GROUP BY setting), t AS (SELECT sum(n) AS tn FROM o), e AS (SELECT coalesce(o.n, 0) AS n, r.rn * c.cn / CAST(t.tn AS DOUBLE) AS want, t.tn FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.genre = r.genre AND o.setting = c.setting) SELECT round(sum((n - want) * (n - want) / want), 6) AS chi2, round(sqrt(sum((n - want) * (n - want) / want) / max(tn) / least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM c) - 1)), 6) AS cramers_v FROM e")
shared("a22_spearman", "WITH r AS (SELECT set_id, rank() OVER (PARTITION BY set_id ORDER BY qty) + (count(*) OVER (PARTITION BY set_id, qty) - 1) / 2.0E0 AS rq, CAST(position AS DOUBLE) AS rp, count(*) OVER (PARTITION BY set_id) AS n FROM plays) SELECT set_id, round(covar_pop(rp, rq) / nullif(stddev_pop(rp) * stddev_pop(rq), 0), 6) + 0.0E0 AS rho FROM r WHERE n >= 3 GROUP BY set_id HAVING stddev_pop(rq) > 0")
shared("a23_train_only_scale", "WITH m AS (SELECT avg(bpm) AS mean, stddev_pop(bpm) AS sd FROM tracks WHERE track_id % 5 <> 0) SELECT track_id, round(coalesce((bpm - mean) / sd, 0), 6) AS z FROM tracks CROSS JOIN m")
shared("a24_null_keys_dropped", "SELECT nullif(kind, 'error') AS kind, count(*) AS n FROM votes WHERE nullif(kind, 'error') IS NOT NULL GROUP BY nullif(kind, 'error')")
shared("a25_error_buckets", "SELECT substring(regexp_replace(url, '[0-9]+', '#'), 1, 90) AS shape, count(*) AS n FROM pages GROUP BY substring(regexp_replace(url, '[0-9]+', '#'), 1, 90) ORDER BY n DESC, shape LIMIT 8", "SELECT substring(regexp_replace(url, '[0-9]+', '#', 'g'), 1, 90) AS shape, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, shape LIMIT 8")
shared("a26_banded_shares", "WITH b AS (SELECT genre, CASE WHEN total <= 50000 THEN 'low' WHEN total <= 150000 THEN 'mid' WHEN total <= 300000 THEN 'high' ELSE 'top' END AS band FROM sets) SELECT genre, band, count(*) / CAST(sum(count(*)) OVER (PARTITION BY genre) AS DOUBLE) AS share FROM b GROUP BY genre, band")
shared("a27_longest_run", "WITH f AS (SELECT series_id, kind, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY series_id, kind ORDER BY ts, event_id) AS island FROM votes), r AS (SELECT series_id, kind, island, count(*) AS steps FROM f GROUP BY series_id, kind, island) SELECT series_id, kind, max(steps) AS longest FROM r GROUP BY series_id, kind")
shared("a28_rollup_total", "SELECT coalesce(genre, 'All') AS genre, coalesce(setting, 'All') AS setting, count(*) AS n FROM sets GROUP BY ROLLUP (genre, setting)")

# 2.5 windows
shared("w01_consecutive_pairs", f"WITH {PAIRS} SELECT set_id, position AS order_a, a, b FROM pairs WHERE b IS NOT NULL AND a <> b")
shared("w01b_relinked_pairs", "WITH k AS (SELECT p.set_id, p.position, p.track_id FROM plays p JOIN tracks t ON p.track_id = t.track_id WHERE t.energy > 10), l AS (SELECT set_id, position, track_id AS a, lead(track_id) OVER (PARTITION BY set_id ORDER BY position) AS b FROM k) SELECT set_id, position, a, b FROM l WHERE b IS NOT NULL AND a <> b")
shared("w02_position_assignment", "WITH x AS (SELECT *, count(nullif(qty, 1)) OVER (PARTITION BY set_id) = count(*) OVER (PARTITION BY set_id) AS timed FROM plays) SELECT set_id, track_id, position AS seq, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN timed THEN qty END, position) - 1 AS placed FROM x")
shared("w03_row_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations")
shared("w05_first_occurrence", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY set_id, track_id ORDER BY position) AS k FROM plays) SELECT set_id, track_id, position FROM r WHERE k = 1")
shared("w06_group_transform", "SELECT set_id, position, count(*) OVER (PARTITION BY set_id) AS size, max(qty) OVER (PARTITION BY set_id) AS top, row_number() OVER (PARTITION BY set_id, track_id ORDER BY position) > 1 AS duplicated FROM plays")
shared("w07_relative_to_opening", "WITH x AS (SELECT set_id, position, qty, position / CAST(count(*) OVER (PARTITION BY set_id) AS DOUBLE) AS part FROM plays) SELECT set_id, position, round(qty - avg(CASE WHEN part < 0.2E0 THEN qty END) OVER (PARTITION BY set_id), 6) AS above FROM x")
shared("w08_two_in_a_row", "WITH x AS (SELECT set_id, position, qty > 20 AS on_, lag(qty > 20) OVER (PARTITION BY set_id ORDER BY position) AS l, lead(qty > 20) OVER (PARTITION BY set_id ORDER BY position) AS r FROM plays) SELECT set_id, position FROM x WHERE on_ AND (coalesce(l, FALSE) OR coalesce(r, FALSE))")
shared("w09_swap_point", "WITH x AS (SELECT series_id, ts, kind = 'purchase' AS b, lead(kind = 'purchase') OVER (PARTITION BY series_id ORDER BY ts) AS b2, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a_seen FROM votes) SELECT series_id, min(ts) AS swap_at FROM x WHERE b AND b2 AND a_seen = 1 GROUP BY series_id")
shared("w10_stuck", "WITH x AS (SELECT set_id, position, qty, min(qty) OVER w AS lo, max(qty) OVER w AS hi, lag(qty, 2) OVER (PARTITION BY set_id ORDER BY position) AS back FROM plays WINDOW w AS (PARTITION BY set_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT set_id, position FROM x WHERE back IS NOT NULL AND hi - lo <= 10")
shared("w11_reversals", "WITH d AS (SELECT set_id, position, sign(qty - lag(qty) OVER (PARTITION BY set_id ORDER BY position)) AS s FROM plays), n AS (SELECT set_id, s, lag(s) OVER (PARTITION BY set_id ORDER BY position) AS before FROM d WHERE s <> 0) SELECT set_id, count(CASE WHEN s <> before THEN 1 END) AS reversals FROM n GROUP BY set_id")
shared("w12_crossing", "WITH x AS (SELECT set_id, position, qty, lag(qty) OVER (PARTITION BY set_id ORDER BY position) AS before FROM plays) SELECT set_id, min(CASE WHEN before < 25 AND qty >= 25 THEN position END) AS up_at, min(CASE WHEN before >= 25 AND qty < 25 THEN position END) AS down_at FROM x GROUP BY set_id")
shared("w13_rolling_median", "WITH x AS (SELECT set_id, position, qty, coalesce(lag(qty) OVER (PARTITION BY set_id ORDER BY position), qty) AS l, coalesce(lead(qty) OVER (PARTITION BY set_id ORDER BY position), qty) AS r FROM plays) SELECT set_id, position, l + qty + r - greatest(l, qty, r) - least(l, qty, r) AS smooth FROM x")
shared("w14_recovering_dips", "WITH x AS (SELECT set_id, position, qty, lag(qty) OVER w AS l, lead(qty) OVER w AS r, lead(qty, 2) OVER w AS r2 FROM plays WINDOW w AS (PARTITION BY set_id ORDER BY position)) SELECT set_id, position FROM x WHERE qty < l - 6 AND (r > qty + 6 OR r2 > qty + 6)")
shared("w15_previous_set_distance", "WITH s AS (SELECT s.dj_id, s.set_id, s.played_on, collect_set(p.track_id) AS ts FROM sets s JOIN plays p ON s.set_id = p.set_id GROUP BY s.dj_id, s.set_id, s.played_on), l AS (SELECT *, lag(ts) OVER (PARTITION BY dj_id ORDER BY played_on, set_id) AS before FROM s) SELECT dj_id, set_id, 1 - size(array_intersect(ts, before)) / CAST(size(array_union(ts, before)) AS DOUBLE) AS distance FROM l WHERE before IS NOT NULL",
       "WITH s AS (SELECT s.dj_id, s.set_id, s.played_on, list(DISTINCT p.track_id) AS ts FROM sets s JOIN plays p ON s.set_id = p.set_id GROUP BY s.dj_id, s.set_id, s.played_on), l AS (SELECT *, lag(ts) OVER (PARTITION BY dj_id ORDER BY played_on, set_id) AS before FROM s) SELECT dj_id, set_id, 1 - len(list_intersect(ts, before)) / CAST(len(ts) + len(before) - len(list_intersect(ts, before)) AS DOUBLE) AS distance FROM l WHERE before IS NOT NULL")
shared("w16_rollover_gap", "WITH x AS (SELECT series_id, event_id, minute(ts) AS a, minute(lead(ts) OVER (PARTITION BY series_id ORDER BY ts, event_id)) AS b FROM votes), g AS (SELECT series_id, event_id, CASE WHEN b IS NULL THEN 7.5E0 WHEN b >= a THEN CAST(b - a AS DOUBLE) ELSE CAST(60 - a + b AS DOUBLE) END AS gap FROM x) SELECT * FROM g WHERE gap <= 15")
shared("w18_rank_of_true", "WITH s AS (SELECT vec_id, label, element_at(embedding, 1) AS score FROM embeddings) SELECT a.vec_id, 1 + count(CASE WHEN b.score > a.score THEN 1 END) AS place FROM s a JOIN s b ON a.label = b.label GROUP BY a.vec_id", "WITH s AS (SELECT vec_id, label, embedding[1] AS score FROM embeddings) SELECT a.vec_id, 1 + count(CASE WHEN b.score > a.score THEN 1 END) AS place FROM s a JOIN s b ON a.label = b.label GROUP BY a.vec_id")
shared("w19_dense_second", "WITH c AS (SELECT series_id, CAST(ts AS DATE) AS day, count(*) AS n FROM votes GROUP BY series_id, CAST(ts AS DATE)) SELECT series_id, min(day) AS first_day, max(day) AS last_day FROM c WHERE n >= 3 GROUP BY series_id")
shared("w20_local_peaks", "WITH x AS (SELECT set_id, position, qty, max(qty) OVER (PARTITION BY set_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, count(*) OVER (PARTITION BY set_id) AS n FROM plays) SELECT set_id, position FROM x WHERE qty = top AND qty > 0 AND position >= 2 AND position < n - 2")
shared("w21_merge_equal_labels", "WITH f AS (SELECT series_id, ts, event_id, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY series_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM votes), i AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT series_id, CAST(island AS BIGINT) AS island, min(kind) AS kind, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS n FROM i GROUP BY series_id, island")
shared("w22_audible_to", "WITH x AS (SELECT set_id, position, qty AS start, qty + 20 AS stop, lead(qty) OVER (PARTITION BY set_id ORDER BY position) AS nxt, max(qty) OVER (PARTITION BY set_id) + 5 AS len FROM plays) SELECT set_id, position, least(stop, coalesce(greatest(nxt, start) + 6, stop), len) AS audible_to FROM x")

# 2.6 sort, limit, top-k
#: Places over a whole table: bands of the order are counted, so that each is numbered by itself and shifted.
shared("t01_sort_nulls_last", "WITH v AS (SELECT event_id, nullif(kind, 'error') AS kind, votes, floor(votes / 10) AS band FROM votes), c AS (SELECT kind, band, count(*) AS n FROM v GROUP BY kind, band), o AS (SELECT kind, band, sum(n) OVER (ORDER BY kind ASC NULLS LAST, band DESC NULLS LAST) - n AS before FROM c) SELECT v.event_id, v.kind, o.before + row_number() OVER (PARTITION BY v.kind, v.band ORDER BY v.votes DESC NULLS LAST, v.event_id) AS place FROM v JOIN o ON v.kind <=> o.kind AND v.band <=> o.band",
       "SELECT event_id, nullif(kind, 'error') AS kind, row_number() OVER (ORDER BY nullif(kind, 'error') ASC NULLS LAST, votes DESC NULLS LAST, event_id) AS place FROM votes")
shared("t02_top_global", "SELECT set_id, total FROM sets ORDER BY total DESC, set_id LIMIT 20")
shared("t03_top_per_group", "WITH r AS (SELECT genre, set_id, total, row_number() OVER (PARTITION BY genre ORDER BY total DESC, set_id) AS k FROM sets) SELECT genre, set_id, total, k FROM r WHERE k <= 5")
shared("t05_next_claim", "SELECT set_id FROM sets WHERE setting = 'P' ORDER BY played_on, set_id LIMIT 1")
shared("t06_row_of_extreme", "SELECT genre, max_by(set_id, total) AS top_set, min_by(set_id, total) AS low_set FROM sets GROUP BY genre")
shared("t07_stable_order", "SELECT set_id, track_id, row_number() OVER (PARTITION BY set_id ORDER BY label_id, position) AS place FROM plays")

# 2.7 set operations
shared("u01_union_by_name", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part")
shared("u02_union_keep_first", "WITH u AS (SELECT c_nationkey AS k, c_acctbal AS v, 0 AS src, c_custkey AS seq FROM customer UNION ALL SELECT s_nationkey AS k, s_acctbal AS v, 1 AS src, s_suppkey AS seq FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, seq) AS n FROM u) SELECT k, v, src FROM r WHERE n = 1")
shared("u03_difference", "SELECT track_id FROM plays WHERE qty > 48 EXCEPT SELECT track_id FROM plays WHERE qty < 10")
shared("u04_intersection_size", "SELECT count(*) AS n FROM (SELECT track_id FROM plays WHERE qty > 48 INTERSECT SELECT track_id FROM plays WHERE qty < 3) x")
shared("u06_anti_duplicate_union", "SELECT DISTINCT p.track_id FROM plays p WHERE EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = p.track_id AND t.energy > 40) AND NOT EXISTS (SELECT 1 FROM plays q WHERE q.track_id = p.track_id AND q.qty = 1)")
