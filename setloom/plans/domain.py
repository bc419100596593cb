"""Presence and vote series, labels, candidate pools, vectors and the named report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.functions import correlation
from setloom.plans.registry import query, shared, view

PAIRED = """paired AS (SELECT set_id, position, track_id AS a, qty AS qa, discount AS da, lead(track_id) OVER w AS b, lead(qty) OVER w AS qb, lead(discount) OVER w AS db
  FROM plays WINDOW w AS (PARTITION BY set_id ORDER BY position))"""
GRID = "grid AS (SELECT series_id, kind, CAST(ts AS DATE) AS day, max(votes) AS top, count(*) AS n FROM votes GROUP BY series_id, kind, CAST(ts AS DATE))"

# --- presence, votes, layers -------------------------------------------------------------------------------
shared("j10_consecutive_by_lead", f"WITH {PAIRED} SELECT set_id, position, a, b FROM paired WHERE b IS NOT NULL")
shared("w04_listed_order", "WITH u AS (SELECT 0 AS file_no, c_custkey AS row_no, c_nationkey AS k FROM customer UNION ALL SELECT 1 AS file_no, s_suppkey AS row_no, s_nationkey AS k FROM supplier) SELECT k, file_no, row_no, row_number() OVER (PARTITION BY k ORDER BY file_no, row_no) AS listed FROM u")
shared("e03_first_last_above", f"WITH {GRID} SELECT series_id, min(CASE WHEN n >= 2 THEN day END) AS first_day, max(CASE WHEN n >= 2 THEN day END) AS last_day FROM grid GROUP BY series_id")
shared("e04_presence_state", f"WITH {GRID}, c AS (SELECT series_id, max(CASE WHEN kind = 'error' THEN top END) AS loud FROM grid GROUP BY series_id) SELECT g.series_id, g.kind, g.day, CASE WHEN g.top >= 2 * c.loud THEN 'present' WHEN g.top > c.loud THEN 'weak' ELSE 'absent' END AS state FROM grid g JOIN c ON g.series_id = c.series_id WHERE g.kind <> 'error'")
shared("e05_grid_stack", f"WITH {GRID}, s AS (SELECT day, series_id % 20 AS id, CASE WHEN top > 150 THEN 2 WHEN top > 50 THEN 1 ELSE 0 END AS rank FROM grid) SELECT day, id, max(rank) AS state FROM s GROUP BY day, id")
_LAYERS = "s AS (SELECT series_id, day, kind, CASE WHEN top > 150 THEN 'present' WHEN top > 50 THEN 'weak' END AS state FROM grid)"
_OF = "array_join(array_sort(collect_list(CASE WHEN state = '{0}' THEN kind END)), ' ') AS {0}, count(CASE WHEN state = '{0}' THEN 1 END) AS n_{0}"
_OF_DUCK = "coalesce(string_agg(kind, ' ' ORDER BY kind) FILTER (state = '{0}'), '') AS {0}, count(CASE WHEN state = '{0}' THEN 1 END) AS n_{0}"
shared("e06_layer_timeline", *(f"WITH {GRID}, {_LAYERS} SELECT series_id, day, {of.format('present')}, {of.format('weak')} FROM s WHERE state IS NOT NULL GROUP BY series_id, day" for of in (_OF, _OF_DUCK)))
shared("e08_adjacency", f"WITH {PAIRED} SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM paired WHERE b IS NOT NULL AND a <> b")
shared("e10_words", "WITH x AS (SELECT set_id, position, qty > 10 AS mix, qty > 20 AS a, discount > 0.05E0 AS b FROM plays) SELECT set_id, position, CASE WHEN NOT mix THEN 'silent' WHEN a AND b THEN 'both' WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'neither' END AS word FROM x")
shared("e16_audio_order", f"WITH x AS (SELECT set_id, position, row_number() OVER (PARTITION BY set_id ORDER BY qty, position) - 1 AS heard FROM plays) SELECT set_id, position, heard, heard = position AS order_ok FROM x")
shared("e12_status_snapshots", "SELECT setting, count(*) AS n, count(CASE WHEN total < 50000 THEN 1 END) AS pending, min(set_id) AS next_claim FROM sets GROUP BY setting")
#: A claim queue over one snapshot of its state: what may be claimed, what a stale claim gives back, what a failed part sends back, what is done.
_QUEUE = """SELECT s.set_id, CASE WHEN p.failed > 0 THEN 'retry' WHEN s.setting = 'O' AND {days} > 365 THEN 'released' WHEN s.setting <> 'F' THEN 'pending' WHEN p.open = 0 THEN 'archivable' ELSE 'working' END AS state, p.failed AS failed_plays
  FROM sets s JOIN (SELECT set_id, count(CASE WHEN discount > 0.09E0 THEN 1 END) AS failed, count(CASE WHEN qty < 5 THEN 1 END) AS open FROM plays GROUP BY set_id) p ON p.set_id = s.set_id CROSS JOIN (SELECT max(played_on) AS now FROM sets) n"""
shared("e12b_queue_transitions", _QUEUE.replace("{days}", "datediff(n.now, s.played_on)"), _QUEUE.replace("{days}", "date_diff('day', s.played_on, n.now)"))

# --- labels ------------------------------------------------------------------------------------------------
shared("l01_seam_pairing", f"WITH {PAIRED} SELECT set_id, position, a, b, qb - qa AS gap, CASE WHEN b IS NULL THEN 'last' WHEN a = b THEN 'same record' WHEN abs(qb - qa) > 30 THEN 'gap too long' ELSE 'usable' END AS reason, greatest(0, qb - 25) AS lo, least(qb + 25, 60) AS hi FROM paired")
shared("l02_confidence", "SELECT set_id, position, CASE WHEN qty >= 40 AND discount >= 0.03E0 THEN 'confident' WHEN qty >= 40 THEN 'by votes' WHEN discount >= 0.05E0 THEN 'by sections' ELSE 'not found' END AS confidence FROM plays")
shared("l05_seam_labels", f"WITH {PAIRED} SELECT set_id, position, round((qb - qa) / (240.0E0 / 125), 4) AS overlap_bars, CASE WHEN qb - qa > 0 THEN round(qa / (qb - qa), 2) END AS swap_pos FROM paired WHERE b IS NOT NULL")
shared("l06_signature", f"WITH {PAIRED} SELECT set_id, position, CASE WHEN qb IS NULL THEN 'unmeasured' WHEN abs(qb - qa) > 40 THEN 'unusable' WHEN qb < qa - 20 THEN 'gap' WHEN a = b THEN 'loop' WHEN db > 0.08E0 THEN 'tension' WHEN abs(qb - qa) <= 2 THEN 'cut' WHEN da < 0.02E0 THEN 'centre' WHEN db < da THEN 'late' ELSE 'end' END AS signature FROM paired")
shared("l07_label_confidence", f"WITH {PAIRED} SELECT set_id, position, CASE WHEN abs(qb - qa) < 2 THEN 'slam' WHEN qb > qa + 15 THEN 'rise' WHEN qb < qa - 15 THEN 'fade' WHEN abs(db - da) <= 0.01E0 THEN 'melt' WHEN db > da THEN 'wave' ELSE 'blend' END AS label, round(least(0.95E0, 0.5E0 + CASE WHEN abs(qb - qa) > 15 THEN 0.2E0 ELSE 0.05E0 END + db), 3) AS confidence FROM paired WHERE b IS NOT NULL")
shared("l08_intent_gating", f"WITH {PAIRED} SELECT set_id, position, CASE WHEN abs(ln(qb / qa)) <= 0.1E0 THEN 'blend' WHEN qb > qa AND position < 3 THEN 'rise' WHEN qb < qa THEN 'fade' ELSE 'wave' END AS label FROM paired WHERE b IS NOT NULL")


@query("l09_energy_shape", "WITH x AS (SELECT set_id, covar_pop(position, qty) / nullif(stddev_pop(position) * stddev_pop(qty), 0) AS rho, count(*) AS n, arg_max(position, (qty, -position)) AS peak, max(qty) - min(qty) AS spread FROM plays GROUP BY set_id) SELECT set_id, CASE WHEN n < 3 THEN 'short' WHEN spread <= 5 THEN 'plateau' WHEN rho > 0.6 THEN 'escalating' WHEN rho < -0.6 THEN 'chill-down' WHEN peak < n - 1 AND peak > 0 THEN 'peak-drop' ELSE 'wave' END AS shape FROM x")
def energy_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of a set's quantities by their correlation with the position, rounded as the SQL's where it lies on a threshold."""
    rho = F.covar_pop("position", "qty") / F.nullif(F.stddev_pop("position") * F.stddev_pop("qty"), F.lit(0.0))
    peak = F.max_by("position", F.struct("qty", -F.col("position")))
    pairs = F.array_sort(F.collect_list(F.when(F.col("qty").isNotNull(), F.struct(F.col("position").alias("x"), F.col("qty").alias("y")))))
    x = view(spark, sf_dir, "plays").groupBy("set_id").agg(rho.alias("near"), F.count("*").alias("n"), peak.alias("peak"), (F.max("qty") - F.min("qty")).alias("spread"), pairs.alias("pairs"))
    x = x.withColumn("rho", F.when((F.abs(F.abs(F.col("near")) - 0.6) < 1e-9) & (F.size("pairs") == F.col("n")), correlation(F.col("pairs"))).otherwise(F.col("near")))
    shape = "CASE WHEN n < 3 THEN 'short' WHEN spread <= 5 THEN 'plateau' WHEN rho > 0.6E0 THEN 'escalating' WHEN rho < -0.6E0 THEN 'chill-down' WHEN peak < n - 1 AND peak > 0 THEN 'peak-drop' ELSE 'wave' END"
    return x.select("set_id", F.expr(shape).alias("shape"))


shared("l33_audit", "SELECT set_id, max(CASE WHEN position = 0 THEN qty END) >= 4 AND count(CASE WHEN position > 0 AND qty < 4 THEN 1 END) = 0 AS clean FROM plays GROUP BY set_id")

# --- splits, pools, vectors --------------------------------------------------------------------------------
shared("l14_leakage", "WITH x AS (SELECT p.track_id, count(DISTINCT s.dj_id % 2) AS sides FROM plays p JOIN sets s ON p.set_id = s.set_id GROUP BY p.track_id) SELECT sides, count(*) AS tracks FROM x GROUP BY sides")
shared("l15_pool", "SELECT track_id, bpm, energy FROM tracks WHERE bpm BETWEEN 900 AND 1800 AND style LIKE '%E%' AND track_id NOT IN (SELECT track_id FROM plays WHERE qty = 50) AND energy >= 5")
shared("l18_energy_targets", "SELECT percentile(energy, 0.15E0) AS lo, percentile(energy, 0.85E0) AS hi FROM tracks", "SELECT quantile_cont(energy, 0.15) AS lo, quantile_cont(energy, 0.85) AS hi FROM tracks")
DOT = "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0.0E0, (s, x) -> s + x) / sqrt(aggregate(a.embedding, 0.0E0, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate(b.embedding, 0.0E0, (s, x) -> s + CAST(x AS DOUBLE) * x))"
DOT_DUCK = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
#: A transition's baseline scores; a track's vector is the one whose id is the track's modulo the vectors.
SCORERS = """e AS (SELECT count(*) AS n FROM embeddings), pop AS (SELECT p.track_id, count(*) AS n FROM plays p JOIN sets s ON p.set_id = s.set_id WHERE s.dj_id % 5 <> 0 GROUP BY p.track_id),
  v AS (SELECT p.set_id, p.position, m.embedding FROM plays p CROSS JOIN e JOIN embeddings m ON m.vec_id = p.track_id % e.n),
  d AS (SELECT a.set_id, a.position AS p1, b.position AS p2, {dot} AS dot FROM v a JOIN v b ON a.set_id = b.set_id AND a.position <= b.position),
  m AS (SELECT x.set_id, x.position, sum(CASE WHEN d.p2 = x.position + 1 THEN d.dot END) AS toward, sum(CASE WHEN d.p2 <= x.position THEN CASE WHEN d.p1 = d.p2 THEN d.dot ELSE 2 * d.dot END END) AS square, max(CASE WHEN d.p1 = x.position AND d.p2 = x.position + 1 THEN d.dot END) AS cosine
    FROM paired x JOIN d ON d.set_id = x.set_id AND d.p1 <= x.position AND d.p2 <= x.position + 1 WHERE x.b IS NOT NULL GROUP BY x.set_id, x.position)
  SELECT x.set_id, x.position, ((x.a * 7919 + x.b * 104729) % 1000) / 1000.0E0 AS random, round(-abs(ln(tb.bpm / ta.bpm)), 6) + 0.0E0 AS bpm, -least(abs(ta.energy % 12 - tb.energy % 12), 12 - abs(ta.energy % 12 - tb.energy % 12)) AS key, coalesce(pop.n, 0) AS popularity,
    round(1 - least(1, abs(ta.energy - tb.energy) / 50.0E0) * 0.5E0 - least(1, abs(ln(tb.bpm / ta.bpm)) / 0.1E0) * 0.5E0, 6) AS compat, round(m.cosine, 5) + 0.0E0 AS cosine, round(m.toward / nullif(sqrt(greatest(m.square, 0)), 0), 5) + 0.0E0 AS set_mean
  FROM paired x JOIN m ON m.set_id = x.set_id AND m.position = x.position JOIN tracks ta ON x.a = ta.track_id JOIN tracks tb ON x.b = tb.track_id LEFT JOIN pop ON pop.track_id = x.b"""
for name, sql in (
    ("l21_nearest_by_cosine", "SELECT b.vec_id, round({dot}, 5) AS cosine FROM embeddings b CROSS JOIN (SELECT * FROM embeddings WHERE vec_id = 0) a WHERE b.vec_id <> 0 AND b.label = 1 ORDER BY round({dot}, 6) DESC, b.vec_id LIMIT 10"),
    ("l25_baseline_scores", f"WITH {PAIRED}, {SCORERS}"),
):
    shared(name, sql.format(dot=DOT), sql.format(dot=DOT_DUCK))
shared("l23_vector_checks", "SELECT pos, round(var_pop(x), 4) AS variance, var_pop(x) > 1e-4 AS alive FROM (SELECT posexplode(embedding) AS (pos, x) FROM embeddings) t GROUP BY pos", "SELECT pos, round(var_pop(x), 4) AS variance, var_pop(x) > 1e-4 AS alive FROM (SELECT unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) t GROUP BY pos")
shared("l24_gap_features", f"WITH {PAIRED} SELECT p.set_id, p.position, round(ln(tb.bpm / ta.bpm), 6) AS bpm_gap, tb.energy - ta.energy AS energy_gap, ta.artist = tb.artist AS same_artist, least(abs(ta.energy % 12 - tb.energy % 12), 12 - abs(ta.energy % 12 - tb.energy % 12)) AS key_gap FROM paired p JOIN tracks ta ON p.a = ta.track_id JOIN tracks tb ON p.b = tb.track_id")
shared("l28_train_popularity", "WITH pop AS (SELECT p.track_id, count(*) AS n FROM plays p JOIN sets s ON p.set_id = s.set_id WHERE s.dj_id % 5 <> 0 GROUP BY p.track_id) SELECT t.track_id, coalesce(pop.n, 0) AS popularity FROM tracks t LEFT JOIN pop ON t.track_id = pop.track_id")
shared("l29_weights", "SELECT set_id, position, least(2.0E0, greatest(0.5E0, qty / median(qty) OVER (PARTITION BY label_id))) AS weight FROM plays")
shared("l30_phrase_vote", "WITH v AS (SELECT set_id, position % 4 AS residue, sum(qty) AS w FROM plays GROUP BY set_id, position % 4), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY w DESC, residue) AS k FROM v) SELECT set_id, residue, w FROM r WHERE k = 1")
#: Checkerboard kernel of two plays before and two from a place over the cosines of (quantity, 100 * discount).
_NOVELTY = """f AS (SELECT set_id, position, qty / sqrt(qty * qty + 1e4 * discount * discount) AS x, 100 * discount / sqrt(qty * qty + 1e4 * discount * discount) AS y FROM plays),
  c AS (SELECT o.set_id, o.position, a.x * b.x + a.y * b.y AS same, CASE WHEN (a.position < o.position) = (b.position < o.position) THEN 1.0E0 ELSE -1.0E0 END AS sign FROM f o JOIN f a ON a.set_id = o.set_id AND a.position BETWEEN o.position - 2 AND o.position + 1 JOIN f b ON b.set_id = o.set_id AND b.position BETWEEN o.position - 2 AND o.position + 1 WHERE o.position >= 2),
  n AS (SELECT set_id, position, sum(sign * same) AS novelty, count(*) AS cells FROM c GROUP BY set_id, position)
  SELECT set_id, position, round(novelty, 6) + 0.0E0 AS novelty FROM n WHERE cells = 16"""
shared("l30b_novelty", f"WITH {_NOVELTY}")
shared("l31_situation", "SELECT c.set_id, c.position, round(avg(n.qty), 6) AS level, round(max(n.qty) - min(n.qty), 6) AS slope FROM plays c JOIN plays n ON n.set_id = c.set_id AND n.position BETWEEN c.position - 2 AND c.position + 1 GROUP BY c.set_id, c.position")

# --- report queries ----------------------------------------------------------------------------------------
SP = "plays p JOIN sets s ON p.set_id = s.set_id"
shared("q01_totals", f"SELECT count(DISTINCT s.dj_id) AS djs, count(DISTINCT s.set_id) AS sets, count(*) AS plays, count(DISTINCT p.track_id) AS tracks, round(sum(p.qty) / 60, 4) AS hours FROM {SP}")
shared("q02_genre_by_setting", "SELECT genre, count(CASE WHEN setting = 'F' THEN 1 END) AS f, count(CASE WHEN setting = 'O' THEN 1 END) AS o, count(CASE WHEN setting = 'P' THEN 1 END) AS p FROM sets GROUP BY genre")
shared("q03_top_djs", "WITH n AS (SELECT dj_id, count(*) AS sets FROM sets GROUP BY dj_id) SELECT dj_id, sets, (SELECT median(sets) FROM n) AS median_sets FROM n ORDER BY sets DESC, dj_id LIMIT 20")
shared("q04_move_shares", f"WITH {PAIRED}, m AS (SELECT s.genre, CASE WHEN qb > qa THEN 'up' WHEN qb < qa THEN 'down' ELSE 'hold' END AS move FROM paired p JOIN sets s ON p.set_id = s.set_id WHERE b IS NOT NULL), g AS (SELECT genre, move, count(*) AS n FROM m GROUP BY genre, move), k AS (SELECT move, count(*) * 100.0E0 / sum(count(*)) OVER () AS every FROM m GROUP BY move) SELECT g.genre, g.move, round(g.n * 100.0E0 / sum(g.n) OVER (PARTITION BY g.genre), 6) AS share, round(g.n * 100.0E0 / sum(g.n) OVER (PARTITION BY g.genre) - k.every, 6) + 0.0E0 AS lift FROM g JOIN k ON g.move = k.move")
shared("q05_overlap", f"WITH {PAIRED}, o AS (SELECT set_id, position, abs(qb - qa) AS bars FROM paired WHERE b IS NOT NULL) SELECT round(avg(CASE WHEN bars >= 16 THEN 100.0E0 ELSE 0 END), 6) AS over16, round(avg(CASE WHEN bars >= 32 THEN 100.0E0 ELSE 0 END), 6) AS over32, max(bars) AS longest FROM o")
shared("q06_plays_first", f"WITH f AS (SELECT p.track_id, s.dj_id, min(s.played_on) AS first_on, row_number() OVER (PARTITION BY p.track_id ORDER BY min(s.played_on), s.dj_id) AS k, count(*) OVER (PARTITION BY p.track_id) AS djs FROM {SP} GROUP BY p.track_id, s.dj_id) SELECT dj_id, count(CASE WHEN k = 1 THEN 1 END) AS first, count(*) AS shared_tracks FROM f WHERE djs >= 3 GROUP BY dj_id HAVING count(*) >= 5")
shared("q07_track_lifetime", f"SELECT p.track_id, datediff(max(s.played_on), min(s.played_on)) / 30.4E0 AS months, count(DISTINCT p.set_id) AS sets FROM {SP} GROUP BY p.track_id HAVING count(DISTINCT p.set_id) >= 2", f"SELECT p.track_id, date_diff('day', min(s.played_on), max(s.played_on)) / 30.4E0 AS months, count(DISTINCT p.set_id) AS sets FROM {SP} GROUP BY p.track_id HAVING count(DISTINCT p.set_id) >= 2")
shared("q08_favourites", f"WITH c AS (SELECT s.genre, p.track_id, count(DISTINCT s.set_id) AS n FROM {SP} GROUP BY s.genre, p.track_id), r AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, track_id) AS k FROM c) SELECT genre, track_id, n FROM r WHERE k <= 30")
_OWN = "WITH x AS (SELECT s.dj_id, s.set_id, regexp_replace(lower(concat('DJ Brand', s.dj_id % 25)), '[^a-z0-9]| |dj'{g}) AS dj_key, regexp_replace(lower(t.artist), '[^a-z0-9]'{g}) AS artist_key FROM plays p JOIN sets s ON p.set_id = s.set_id JOIN tracks t ON t.track_id = p.track_id) SELECT dj_id, round(avg(CASE WHEN length(substring(dj_key, 1, 8)) >= 4 AND instr(artist_key, substring(dj_key, 1, 8)) > 0 THEN 100.0E0 ELSE 0 END), 6) AS own_pct, count(*) AS n FROM x GROUP BY dj_id HAVING count(DISTINCT set_id) >= 10"
shared("q09_own_music", _OWN.replace("{g}", ", ''"), _OWN.replace("{g}", ", '', 'g'"))
_VARY = f"""WITH {PAIRED}, o AS (SELECT dj_id, set_id, lead(set_id) OVER (PARTITION BY dj_id ORDER BY played_on, set_id) AS after, count(*) OVER (PARTITION BY dj_id) AS sets FROM sets),
  r AS (SELECT DISTINCT set_id, track_id FROM plays), size AS (SELECT set_id, count(*) AS n FROM r GROUP BY set_id),
  common AS (SELECT o.set_id, count(*) AS n FROM o JOIN r a ON a.set_id = o.set_id JOIN r b ON b.set_id = o.after AND b.track_id = a.track_id GROUP BY o.set_id),
  td AS (SELECT o.dj_id, o.set_id, 1 - coalesce(common.n, 0) / CAST(x.n + y.n - coalesce(common.n, 0) AS DOUBLE) AS away FROM o JOIN size x ON x.set_id = o.set_id JOIN size y ON y.set_id = o.after LEFT JOIN common ON common.set_id = o.set_id),
  m AS (SELECT set_id, CASE WHEN qb > qa THEN 'up' WHEN qb < qa THEN 'down' ELSE 'hold' END AS move FROM paired WHERE b IS NOT NULL),
  s AS (SELECT set_id, avg(CASE WHEN move = 'up' THEN 1.0E0 ELSE 0 END) AS up, avg(CASE WHEN move = 'down' THEN 1.0E0 ELSE 0 END) AS down, avg(CASE WHEN move = 'hold' THEN 1.0E0 ELSE 0 END) AS hold FROM m GROUP BY set_id HAVING count(*) >= 5),
  ts AS (SELECT o.dj_id, o.set_id, (abs(a.up - b.up) + abs(a.down - b.down) + abs(a.hold - b.hold)) / 2 AS away FROM o JOIN s a ON a.set_id = o.set_id JOIN s b ON b.set_id = o.after),
  t AS (SELECT dj_id, avg(away) AS tracks FROM td GROUP BY dj_id), u AS (SELECT dj_id, avg(away) AS transitions FROM ts GROUP BY dj_id HAVING count(*) >= 3), d AS (SELECT DISTINCT dj_id, sets FROM o WHERE sets >= 10)
  SELECT d.dj_id, d.sets, round(t.tracks, 6) AS tracks, round(u.transitions, 6) AS transitions, round(CASE WHEN u.transitions IS NULL THEN t.tracks WHEN t.tracks IS NULL THEN u.transitions ELSE (t.tracks + u.transitions) / 2 END, 6) AS variation
  FROM d LEFT JOIN t ON t.dj_id = d.dj_id LEFT JOIN u ON u.dj_id = d.dj_id"""
shared("q10_variation", _VARY)
shared("q11_music_age", f"SELECT s.genre, round(avg(year(s.played_on) - (1980 + t.energy % 20)), 6) AS mean_age, median(year(s.played_on) - (1980 + t.energy % 20)) AS median_age FROM {SP} JOIN tracks t ON p.track_id = t.track_id GROUP BY s.genre")
shared("q12_tempo_by_year", f"SELECT year(s.played_on) AS year, median(t.bpm) AS tempo, count(*) AS n FROM {SP} JOIN tracks t ON p.track_id = t.track_id GROUP BY year(s.played_on) HAVING count(*) >= 30")
shared("q13_tempo_by_fifth", "WITH x AS (SELECT p.set_id, t.bpm, least(CAST(floor(p.position * 5 / CAST(count(*) OVER (PARTITION BY p.set_id) AS DOUBLE)) AS INT), 4) AS fifth FROM plays p JOIN tracks t ON p.track_id = t.track_id), o AS (SELECT set_id, avg(CASE WHEN fifth = 0 THEN bpm END) AS opening FROM x GROUP BY set_id) SELECT x.fifth, round(avg(x.bpm - o.opening), 4) + 0.0E0 AS above FROM x JOIN o ON x.set_id = o.set_id GROUP BY x.fifth")
shared("q14_fame_bands", f"WITH f AS (SELECT track_id, count(*) AS n FROM plays GROUP BY track_id), b AS (SELECT s.genre, CASE WHEN f.n <= 20 THEN 'rare' WHEN f.n <= 30 THEN 'known' ELSE 'famous' END AS band FROM {SP} JOIN f ON f.track_id = p.track_id) SELECT genre, band, count(*) / CAST(sum(count(*)) OVER (PARTITION BY genre) AS DOUBLE) AS share FROM b GROUP BY genre, band")
shared("q15_exclusives", f"WITH d AS (SELECT p.track_id, s.dj_id, count(*) AS n FROM {SP} GROUP BY p.track_id, s.dj_id), e AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS djs, row_number() OVER (PARTITION BY dj_id ORDER BY n DESC, track_id) AS k FROM d) SELECT dj_id, track_id, n, djs <= 2 AS exclusive FROM e WHERE k <= 2")
shared("q16_djs_per_track", f"WITH d AS (SELECT p.track_id, count(DISTINCT s.dj_id) AS djs FROM {SP} GROUP BY p.track_id) SELECT CASE WHEN djs = 1 THEN '1' WHEN djs <= 20 THEN '2-20' WHEN djs <= 30 THEN '21-30' ELSE '31+' END AS band, count(*) AS tracks FROM d GROUP BY CASE WHEN djs = 1 THEN '1' WHEN djs <= 20 THEN '2-20' WHEN djs <= 30 THEN '21-30' ELSE '31+' END")
shared("q17_sharing_pairs", f"WITH d AS (SELECT DISTINCT s.dj_id, p.track_id FROM {SP}) SELECT x.dj_id AS dj_a, y.dj_id AS dj_b, count(*) AS n FROM d x JOIN d y ON x.track_id = y.track_id AND x.dj_id < y.dj_id GROUP BY x.dj_id, y.dj_id ORDER BY n DESC, dj_a, dj_b LIMIT 20")
shared("q18_repeat_share", f"WITH r AS (SELECT s.dj_id, s.setting, p.track_id, row_number() OVER (PARTITION BY s.dj_id, p.track_id ORDER BY s.played_on, s.set_id, p.position) > 1 AS again FROM {SP}) SELECT setting, round(avg(CASE WHEN again THEN 100.0E0 ELSE 0 END), 6) AS pct FROM r GROUP BY setting")
shared("q19_speed_shares", f"SELECT coalesce(s.genre, 'All') AS genre, round(avg(CASE WHEN p.discount < 0.03E0 THEN 100.0E0 ELSE 0 END), 6) AS slowed, round(avg(CASE WHEN p.discount BETWEEN 0.03E0 AND 0.07E0 THEN 100.0E0 ELSE 0 END), 6) AS untouched, round(avg(CASE WHEN p.discount > 0.07E0 THEN 100.0E0 ELSE 0 END), 6) AS sped_up FROM {SP} GROUP BY ROLLUP (s.genre)")
shared("q20_dj_census", f"SELECT s.dj_id, count(DISTINCT s.set_id) AS sets, count(*) AS plays, count(DISTINCT p.track_id) AS tracks, count(DISTINCT s.genre) AS genres, min(s.played_on) AS first_on, max(s.played_on) AS last_on FROM {SP} GROUP BY s.dj_id")
shared("q21_factor_eta", f"WITH t AS (SELECT avg(p.qty) AS m, var_pop(p.qty) * count(p.qty) AS ss FROM {SP}), x AS (SELECT s.genre, s.setting, p.qty FROM {SP}), g AS (SELECT 'genre' AS factor, genre AS level, count(*) AS n, avg(qty) AS gm FROM x GROUP BY genre UNION ALL SELECT 'setting' AS factor, setting AS level, count(*) AS n, avg(qty) AS gm FROM x GROUP BY setting) SELECT factor, level, round(n * 100.0E0 / sum(n) OVER (PARTITION BY factor), 6) AS share, round(gm, 6) AS mean, round(sum(n * (gm - m) * (gm - m)) OVER (PARTITION BY factor) / ss, 6) + 0.0E0 AS eta2 FROM g CROSS JOIN t")
shared("q22_overlay_density", "WITH d AS (SELECT set_id, count(*) AS n, count(CASE WHEN discount > 0.07E0 THEN 1 END) AS overlays FROM plays GROUP BY set_id) SELECT set_id, overlays, overlays / CAST(n AS DOUBLE) AS density FROM d ORDER BY density DESC, set_id LIMIT 50")
shared("q22b_overlay_pairs", "WITH x AS (SELECT set_id, position, track_id, discount > 0.07E0 AS overlay, max(CASE WHEN discount <= 0.07E0 THEN position END) OVER (PARTITION BY set_id ORDER BY position) AS parent FROM plays), y AS (SELECT o.track_id AS overlay, p.track_id AS parent FROM x o JOIN x p ON p.set_id = o.set_id AND p.position = o.parent WHERE o.overlay) SELECT parent, overlay, count(*) AS n FROM y GROUP BY parent, overlay ORDER BY n DESC, parent, overlay LIMIT 50")
shared("q23_situation_crosstab", f"WITH c AS (SELECT s.setting, s.genre, count(*) AS n, avg(p.qty) AS level FROM {SP} GROUP BY s.setting, s.genre), r AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY n DESC, genre) AS k FROM c) SELECT setting, genre, n, round(level, 6) AS level FROM r WHERE k <= 3")
shared("q24_status_counts", "SELECT 'sets' AS what, setting AS status, count(*) AS n FROM sets GROUP BY setting UNION ALL SELECT 'plays' AS what, CASE WHEN qty > 25 THEN 'done' ELSE 'pending' END AS status, count(*) AS n FROM plays GROUP BY CASE WHEN qty > 25 THEN 'done' ELSE 'pending' END")
