"""Queries over the operators that are built from DataFrame calls, each with SQL where one can state it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.operators import joins, postings, sequences, splits, vectors
from setloom.plans.registry import query, run_sql, table, view
from setloom.sources import stage_table
from setloom.streaming import windows


# --- joins ---------------------------------------------------------------------------------------------
@query("j15_band_join", "SELECT a.track_id, b.track_id AS other FROM tracks a JOIN tracks b ON a.style = b.style AND a.artist <> b.artist AND abs(ln(a.bpm / b.bpm)) <= 0.05 + 1e-12")
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasible next tracks: equal style, other artist, tempo within the band."""
    t = view(spark, sf_dir, "tracks")
    a, b = t.select("track_id", "style", "artist", "bpm"), t.select(F.col("track_id").alias("other"), "style", F.col("artist").alias("artist2"), F.col("bpm").alias("bpm2"))
    return joins.band_join(a, b, ["style"], "bpm", "bpm2", 0.05, "artist <> artist2").select("track_id", "other")


@query("j16_as_of", "WITH v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') SELECT c.user_id, c.event_id, coalesce((SELECT max_by(v.value, v.ts) FROM v WHERE v.user_id = c.user_id AND v.ts <= c.ts), (SELECT min_by(v.value, v.ts) FROM v WHERE v.user_id = c.user_id)) AS value FROM c")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click with the user's last purchase before it, or the first one."""
    e = table(spark, sf_dir, "events")
    clicks, buys = e.where("event_type = 'click'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.as_of_join(clicks, buys, ["user_id"], "ts", "value").select("user_id", "event_id", "value")


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks (item, frame, bin): users are items, quarters of hours are frames, bands of values are bins."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select(F.col("user_id").alias("item"), F.expr("cast(unix_timestamp(cast(ts as timestamp)) as bigint) div 900").alias("frame"), F.floor(F.col("value") / 20).alias("bin")).distinct()


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks (item, h, frame) of the peaks."""
    return joins.peak_pairs(_peaks(spark, sf_dir))


_MET = """peaks AS (SELECT DISTINCT user_id AS item, CAST(floor(epoch(ts) / 900) AS BIGINT) AS frame, CAST(floor(value / 20) AS BIGINT) AS bin FROM events WHERE value IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY frame, bin) AS n FROM peaks),
  h AS (SELECT a.item, a.frame, a.bin AS f1, b.bin AS f2, b.frame - a.frame AS gap FROM k a JOIN k b ON a.item = b.item AND b.n BETWEEN a.n + 1 AND a.n + 3 AND b.frame - a.frame <= 50),
  met AS (SELECT a.item AS record, b.item AS mix, a.frame AS rf, b.frame AS mf FROM h a JOIN h b ON a.f1 = b.f1 AND a.f2 = b.f2 AND a.gap = b.gap AND a.item <> b.item)"""
_TALLY = f"""{_MET}, tally AS (SELECT record, mix, mf - rf AS "offset", count(*) AS votes FROM met GROUP BY ALL)"""
_PEAK = f"""{_TALLY}, r AS (SELECT *, row_number() OVER (PARTITION BY record, mix ORDER BY votes DESC, "offset") AS k FROM tally), peak AS (SELECT record, mix, "offset", votes FROM r WHERE k = 1)"""
#: Frames of ten days that J13 restricts the mix to.
_SPAN = (1_894_080, 1_895_040)


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item against every other one."""
    h = _postings(spark, sf_dir)
    return postings.offset_votes(h, h)


@query("j11_postings_join", f'WITH {_TALLY} SELECT record, mix, "offset", votes FROM tally')
def votes_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by offset of shared landmarks."""
    return _votes(spark, sf_dir)


@query("j12_postings_band", f'WITH {_TALLY} SELECT record, mix, "offset", votes FROM tally WHERE abs("offset" - 10 * (mix - record)) <= 400')
def postings_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes whose offset is near the expected one."""
    return joins.within_band(_votes(spark, sf_dir), 10 * (F.col("mix") - F.col("record")), 400)


@query("a10_vote_peak", f'WITH {_PEAK} SELECT record, mix, "offset", votes FROM peak')
def vote_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offset of every record and mix."""
    h = _postings(spark, sf_dir)
    return postings.offset_peaks(h, h)


@query("j13_span_restricted", f'WITH {_MET} SELECT record, mix, mf - rf AS "offset", count(*) AS votes FROM met WHERE mf >= {_SPAN[0]} AND mf < {_SPAN[1]} GROUP BY ALL')
def span_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of landmarks within a span of the mix's frames; the span is cut before the join."""
    h = _postings(spark, sf_dir)
    return postings.offset_votes(h, h.where((F.col("frame") >= _SPAN[0]) & (F.col("frame") < _SPAN[1])))


@query("l32_same_recording", f"""WITH {_PEAK}, buyers AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), loud AS (SELECT record, max(votes) AS loudest FROM peak WHERE mix NOT IN (SELECT user_id FROM buyers) GROUP BY record)
  SELECT p.record, p.mix, p.votes, p.votes >= greatest(4, 2 * coalesce(l.loudest, 0)) AS same FROM peak p LEFT JOIN loud l ON l.record = p.record""")
def same_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose best vote reaches the record's floor: twice the loudest control, at least 4. Users who never buy are controls."""
    p = vote_peak(spark, sf_dir).select("record", "mix", "votes")
    buyers = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("mix")).distinct()
    loud = p.join(F.broadcast(buyers), "mix", "left_anti").groupBy("record").agg(F.max("votes").alias("loudest"))
    return p.join(F.broadcast(loud), "record", "left").select("record", "mix", "votes", (F.col("votes") >= F.greatest(F.lit(4), 2 * F.coalesce("loudest", F.lit(0)))).alias("same"))


#: Length and hop of the windows of an anchored curve, and how far an offset may be from the anchor, in frames.
_WINDOWS, _TOLERANCE = ((16, 4), (40, 10)), 2


@query("e02_anchored_curve", f"""WITH {_PEAK}, w(size, hop) AS (VALUES {", ".join(map(str, _WINDOWS))}),
  c AS (SELECT m.record, m.mix, w.size, w.hop * unnest(range(CAST(floor((m.mf - w.size) / w.hop) AS BIGINT) + 1, CAST(floor(m.mf / w.hop) AS BIGINT) + 1)) AS start, m.mf - m.rf AS found
    FROM met m JOIN peak p ON p.record = m.record AND p.mix = m.mix AND abs(m.mf - m.rf - p."offset") <= {_TOLERANCE} CROSS JOIN w),
  n AS (SELECT record, mix, size, start, found, count(*) AS votes FROM c GROUP BY ALL)
  SELECT record, mix, CAST(size AS INT) AS size, start, max(votes) AS votes FROM n GROUP BY record, mix, size, start""")
def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes along each mix in sliding windows of two sizes: of each window the best offset near the anchor."""
    h = _postings(spark, sf_dir)
    return postings.anchored_curve(h, h, _WINDOWS, _TOLERANCE)


#: Speeds in the order in which they are tried, and the fine steps around the best. Fixed values.
COARSE_RATES, FINE_RATE_STEP, FINE_RATE_STEPS = (1.0, 0.99, 1.01, 0.98, 1.02, 0.97, 1.03, 0.96, 1.04), 0.0005, 5
#: Votes that settle the first speed, and that are worth fine steps; for landmarks of events.
_EARLY, _FINE_LEAST = 6, 3


def _speed_sql() -> str:
    """The same search, a step of it after another."""

    def tried(n: str, rates: str, pairs: str) -> list[str]:
        return [
            f"{n}p AS (SELECT DISTINCT p.item, r.rate, CAST(floor(p.frame / r.rate) AS BIGINT) AS frame, p.bin FROM p0 p JOIN {rates} r ON r.item = p.item)",
            f"{n}k AS (SELECT *, row_number() OVER (PARTITION BY item, rate ORDER BY frame, bin) AS n FROM {n}p)",
            f"{n}h AS (SELECT a.item, a.rate, a.frame, a.bin AS f1, b.bin AS f2, b.frame - a.frame AS gap FROM {n}k a JOIN {n}k b ON a.item = b.item AND a.rate = b.rate AND b.n BETWEEN a.n + 1 AND a.n + 3 AND b.frame - a.frame <= 50)",
            f"""{n}v AS (SELECT a.item AS record, b.item AS mix, a.rate, b.frame - a.frame AS "offset", count(*) AS votes FROM {n}h a JOIN mh b ON a.f1 = b.f1 AND a.f2 = b.f2 AND a.gap = b.gap AND a.item <> b.item {pairs} GROUP BY ALL)""",
            f"""{n}b AS (SELECT * FROM {n}v QUALIFY row_number() OVER (PARTITION BY record, mix, rate ORDER BY votes DESC, "offset") = 1)""",
        ]

    parts = [
        _MET.split(",\n  k AS")[0],
        "p0 AS (SELECT item, frame - min(frame) OVER (PARTITION BY item) AS frame, bin FROM peaks)",
        "one AS (SELECT DISTINCT item, 1.0E0 AS rate FROM p0)",
        *tried("m", "one", "AND FALSE")[:2],
        "mh AS (SELECT a.item, a.frame, a.bin AS f1, b.bin AS f2, b.frame - a.frame AS gap FROM mk a JOIN mk b ON a.item = b.item AND b.n BETWEEN a.n + 1 AND a.n + 3 AND b.frame - a.frame <= 50)",
        f"o(rate, nth) AS (VALUES {', '.join(f'({r!r}E0, {k})' for k, r in enumerate(COARSE_RATES))})",
        "cr AS (SELECT i.item, o.rate FROM (SELECT DISTINCT item FROM p0) i, o)",
        *tried("c", "cr", ""),
        "cn AS (SELECT c.*, o.nth, max(CASE WHEN o.nth = 0 THEN c.votes END) OVER (PARTITION BY c.record, c.mix) AS first FROM cb c JOIN o ON o.rate = c.rate)",
        f"""s0 AS (SELECT record, mix, rate, "offset", votes FROM cn WHERE nth = 0 OR coalesce(first, 0) < {_EARLY} QUALIFY row_number() OVER (PARTITION BY record, mix ORDER BY votes DESC, nth) = 1)""",
    ]
    for k in range(1, FINE_RATE_STEPS + 1):
        off = f"{k * FINE_RATE_STEP!r}E0"
        parts += [
            f"n{k} AS (SELECT record, mix, 0 AS side, rate - {off} AS rate FROM s{k - 1} WHERE votes >= {_FINE_LEAST} UNION ALL SELECT record, mix, 1, rate + {off} FROM s{k - 1} WHERE votes >= {_FINE_LEAST})",
            f"r{k} AS (SELECT DISTINCT record AS item, rate FROM n{k})",
            *tried(f"f{k}", f"r{k}", f"JOIN n{k} w ON w.record = a.item AND w.mix = b.item AND w.rate = a.rate"),
            f"""s{k} AS (SELECT record, mix, rate, "offset", votes FROM (SELECT -1 AS side, * FROM s{k - 1} UNION ALL BY NAME SELECT w.side, f.* FROM f{k}b f JOIN n{k} w ON w.record = f.record AND w.mix = f.mix AND w.rate = f.rate) u QUALIFY row_number() OVER (PARTITION BY record, mix ORDER BY votes DESC, side) = 1)""",
        ]
    return f"""WITH {', '.join(parts)} SELECT record, mix, rate, "offset", votes FROM s{FINE_RATE_STEPS}"""


@query("l03_speed_search", _speed_sql())
def speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speed and offset at which every item's landmarks fit every other item's best."""
    peaks = _peaks(spark, sf_dir)
    start = peaks.groupBy("item").agg(F.min("frame").alias("start"))
    own = peaks.join(start, "item").select("item", (F.col("frame") - F.col("start")).alias("frame"), "bin")
    return joins.speed_search(own, COARSE_RATES, _EARLY, _FINE_LEAST, FINE_RATE_STEP, FINE_RATE_STEPS, stage_table.kept)


_TEMPLATES = [("cut", [5.0, 0.01]), ("blend", [25.0, 0.04]), ("long", [45.0, 0.09])]


@query("j21_nearest_template", """WITH d AS (SELECT set_id, position, sqrt((pow(qty - 5, 2) + pow(discount - 0.01, 2)) / 1) AS a, sqrt(pow(qty - 25, 2) + pow(discount - 0.04, 2)) AS b, sqrt(pow(qty - 45, 2) + pow(discount - 0.09, 2)) AS c FROM plays)
  SELECT set_id, position, CASE WHEN a <= b AND a <= c THEN 'cut' WHEN b <= c THEN 'blend' ELSE 'long' END AS nearest, round(least(a, b, c) / sqrt(2), 6) AS distance FROM d""")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of three templates."""
    return joins.nearest_template(view(spark, sf_dir, "plays"), ["qty", "discount"], _TEMPLATES).select("set_id", "position", "nearest", F.round("distance", 6).alias("distance"))


@query("j22_nearest_element", "SELECT set_id, position, list_min([abs(qty - 10), abs(qty - 20), abs(qty - 40)]) AS away FROM plays")
def nearest_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest of an array's values."""
    drops = F.array(F.lit(10.0), F.lit(20.0), F.lit(40.0))
    return view(spark, sf_dir, "plays").select("set_id", "position", F.array_min(F.transform(drops, lambda x: F.abs(F.col("qty") - x))).alias("away"))


_PICK = "SELECT set_id, genre FROM (SELECT set_id, genre, row_number() OVER (PARTITION BY genre ORDER BY md5(concat_ws('|', '42', genre, set_id)), set_id) AS k FROM sets) r WHERE k <= {}"


@query("j25_control_selection", "WITH pool AS (SELECT set_id, genre FROM sets WHERE set_id NOT IN (SELECT set_id FROM sets WHERE total > 250000)) " + _PICK.format(5).replace("FROM sets", "FROM pool"))
def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five controls by genre from the sets that aren't excluded."""
    s = view(spark, sf_dir, "sets").select("set_id", "genre", "total")
    return joins.hash_pick(s.join(s.where("total > 250000").select("set_id"), "set_id", "left_anti"), ["genre"], "set_id", 5).select("set_id", "genre")


@query("t08_seeded_sample", _PICK.format(20))
def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sets by genre in seeded hash order."""
    return joins.hash_pick(view(spark, sf_dir, "sets"), ["genre"], "set_id", 20).select("set_id", "genre")


@query("t09_category_cap", _PICK.format(500))
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500 sets by genre."""
    return joins.hash_pick(view(spark, sf_dir, "sets"), ["genre"], "set_id", 500).select("set_id", "genre")


_BAND = "SELECT a.track_id, b.track_id AS other FROM tracks a JOIN tracks b ON a.style = b.style AND a.artist <> b.artist AND abs(ln(a.bpm / b.bpm)) <= 0.05 + 1e-12"


@query("l19_negative_sampling", f"""WITH p AS ({_BAND}), c AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY md5(concat_ws('|', '42', track_id, other)), other) - 1 AS draw, row_number() OVER (PARTITION BY track_id ORDER BY other) - 1 AS at FROM p),
  d AS (SELECT DISTINCT track_id, n, unnest(range(9)) AS draw FROM c WHERE n < 9)
  SELECT track_id, draw, other FROM c WHERE n >= 9 AND draw < 9 UNION ALL SELECT d.track_id, d.draw, c.other FROM d JOIN c ON c.track_id = d.track_id AND c.at = (d.track_id * 7919 + d.draw * 104729 + 42) % d.n""")
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine feasible negatives of every track, with replacement where there are fewer."""
    t = view(spark, sf_dir, "tracks")
    a, b = t.select("track_id", "style", "artist", "bpm"), t.select(F.col("track_id").alias("other"), "style", F.col("artist").alias("artist2"), F.col("bpm").alias("bpm2"))
    named = b.withColumn("__end", F.col("other").cast("string"))

    def pairs_of(limits: DataFrame, where: str | None) -> DataFrame:
        return joins.band_join(a.join(limits, "track_id"), named, ["style"], "bpm", "bpm2", 0.05, "artist <> artist2" + (f" AND {where}" if where else ""))

    return sequences.negatives_of(pairs_of, joins.band_sizes(a, b, ["style"], "bpm", "bpm2", 0.05, "track_id"), "track_id", "other", 9, stage_table.kept)


# --- sequences and events --------------------------------------------------------------------------------
_HOURS = "SELECT user_id, epoch(ts) / 3600.0 AS t, event_id FROM events"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"))


@query("e07_capped_sessions", f"""WITH e AS ({_HOURS}), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 12 THEN 0 ELSE 1 END AS new FROM e),
  i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM f), p AS (SELECT *, floor((t - min(t) OVER (PARTITION BY user_id, island)) / 24) AS part FROM i)
  SELECT user_id, CAST(island AS BIGINT) AS island, CAST(part AS BIGINT) AS part, round(min(t), 6) AS "start", round(max(t), 6) AS "end", count(*) AS n FROM p GROUP BY user_id, island, part""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of 12 hours, cut every 24."""
    s = sequences.capped_sessions(_hours(spark, sf_dir), ["user_id"], "t", 12, 24)
    return s.select("user_id", "island", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


@query("w17_context", "SELECT set_id, position, array_to_string(list_concat(list_resize([]::BIGINT[], greatest(0, 4 - least(4, position + 1))::BIGINT, -1::BIGINT), list(track_id) OVER (PARTITION BY set_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), ' ') AS context FROM plays")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four tracks up to each play, padded."""
    return sequences.context(view(spark, sf_dir, "plays"), ["set_id"], "position", "track_id", 4).select("set_id", "position", F.array_join("context", " ").alias("context"))


@query("l10_l11_l12_proof_summary")
def proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest rising run of quantities by set, its median under 2,000 shuffles and its chance."""
    return sequences.proof_summary(view(spark, sf_dir, "plays"), "set_id", "position", "qty", shuffles=2000)


@query("l10_longest_rising", """WITH RECURSIVE chain AS (SELECT set_id, position, qty, 1 AS n FROM plays UNION ALL SELECT p.set_id, p.position, p.qty, c.n + 1 FROM chain c JOIN plays p ON p.set_id = c.set_id AND p.position > c.position AND p.qty > c.qty)
  SELECT set_id, max(n) AS rising FROM chain GROUP BY set_id""")
def rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the longest strictly rising subsequence of quantities by set."""
    return sequences.longest_rising_length(view(spark, sf_dir, "plays"), "set_id", "position", "qty", "rising")


@query("t10_greedy_picks", """WITH o AS (SELECT set_id, list([position] ORDER BY qty DESC, position) AS l FROM plays GROUP BY set_id),
  t AS (SELECT set_id, list_reduce(l, lambda taken, x: CASE WHEN list_min(list_transform(taken, lambda y: abs(y - x[1]))) >= 2 THEN list_concat(taken, x) ELSE taken END) AS taken FROM o)
  SELECT set_id, unnest(taken) AS position FROM t""")
def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaviest plays, at least two places apart."""
    return sequences.greedy_picks(view(spark, sf_dir, "plays"), "set_id", "position", "qty", 2)


@query("t04_top_of_each_then_all", "WITH c AS (SELECT a.track_id, b.track_id AS other, 1 - abs(b.energy - 25) / 50.0 AS score FROM tracks a JOIN tracks b ON a.style = b.style AND a.artist <> b.artist AND abs(ln(a.bpm / b.bpm)) <= 0.05 + 1e-12), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, other) AS k FROM c) SELECT track_id, other, score FROM r WHERE k <= 8 ORDER BY score DESC, track_id, other LIMIT 50")
def top_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best next tracks of every track, and the fifty best of those."""
    t = view(spark, sf_dir, "tracks")
    score = 1 - F.abs(F.col("energy") - 25) / 50.0
    a, b = t.select("track_id", "style", "artist", "bpm"), t.select(F.col("track_id").alias("other"), "style", F.col("artist").alias("artist2"), F.col("bpm").alias("bpm2"), score.alias("score"))
    best = joins.best_in_band(a, b, ["style"], "bpm", "bpm2", 0.05, "track_id", [("score", True), ("other", False)], "artist <> artist2", 8)
    return best.orderBy(F.desc("score"), "track_id", "other").limit(50).select("track_id", "other", "score")


@query("f09_text_similarity")
def text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of neighbouring titles."""
    t = view(spark, sf_dir, "tracks").select("track_id", "title")
    other = t.select((F.col("track_id") - 1).alias("track_id"), F.col("title").alias("next_title"))
    return sequences.similarity(t.join(other, "track_id"), "title", "next_title")


def _beam_sql(steps: int, width: int) -> str:
    """The same search, a step of it after another."""
    parts = ["g AS (SELECT quantile_cont(energy, 0.15) AS lo, quantile_cont(energy, 0.85) AS hi, stddev_pop(energy) + 1e-9 AS sd FROM tracks)", "b0 AS (SELECT [track_id] AS path, [artist] AS used, bpm, energy, 0.0 AS score FROM tracks WHERE track_id = 1)"]
    for k, shape in enumerate(sequences.energy_targets(steps)[1:], 1):
        parts += [
            f"c{k} AS (SELECT b.path, b.used, b.score, p.track_id, p.artist, p.bpm, p.energy, -(abs(p.energy - b.energy) / 50.0 + 10 * abs(ln(p.bpm / b.bpm))) AS pair FROM b{k - 1} b JOIN tracks p ON abs(ln(b.bpm / p.bpm)) <= 0.05 AND NOT list_contains(b.path, p.track_id) AND NOT list_contains(b.used, p.artist))",
            f"z{k} AS (SELECT *, score + (pair - avg(pair) OVER (PARTITION BY path)) / (stddev_pop(pair) OVER (PARTITION BY path) + 1e-9) + 0.7 * (1 - abs(energy - (g.lo + {shape} * (g.hi - g.lo))) / (2 * g.sd)) AS total FROM c{k}, g)",
            f"t{k} AS (SELECT list_append(path, track_id) AS path, list_append(used, artist) AS used, bpm, energy, total AS score FROM z{k} QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(total, 9) DESC, track_id) <= {width})",
            f"u{k} AS (SELECT * FROM t{k} QUALIFY row_number() OVER (PARTITION BY list_sort(path), path[-1] ORDER BY round(score, 9) DESC, path) = 1)",
            f"b{k} AS (SELECT * FROM u{k} ORDER BY round(score, 9) DESC, path LIMIT {width})",
        ]
    return f"WITH {', '.join(parts)} SELECT array_to_string(path, '>') AS path, round(score, 6) AS score FROM b{steps}"


@query("l16_t04_beam_search", _beam_sql(4, 8))
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight best paths of four further tracks from track 1."""
    return sequences.beam_search(view(spark, sf_dir, "tracks").withColumn("credits", F.split("artist", " & ")), 1, 4)


@query("l17_slot_repair", """WITH g AS (SELECT stddev_pop(energy) + 1e-9 AS sd FROM tracks), n AS (SELECT t.track_id, abs(ln(t.bpm / a.bpm)) AS da, abs(ln(t.bpm / b.bpm)) AS db, abs(t.energy - a.energy) / 50.0 + abs(t.energy - b.energy) / 50.0 AS de, abs(t.energy - (a.energy + b.energy) / 2.0) / (2 * g.sd) AS off
    FROM tracks t, tracks a, tracks b, g WHERE a.track_id = 1 AND b.track_id = 2 AND t.track_id NOT IN (1, 2) AND t.artist <> a.artist AND t.artist <> b.artist)
  SELECT track_id, round(0.7 * (1 - off) - de - 10 * (da + db), 6) AS score FROM n WHERE da <= 0.3 AND db <= 0.3 ORDER BY round(0.7 * (1 - off) - de - 10 * (da + db), 6) DESC, track_id LIMIT 5""")
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tracks that fit best between tracks 1 and 2: valid against both, closest to both, near the middle energy."""
    return sequences.slot_repair(view(spark, sf_dir, "tracks"), 1, 2, 5, 0.3)


_ALIAS = """w AS (SELECT CAST(ts AS DATE) AS mix, user_id AS id, min(epoch(ts) / 3600.0) AS t0, list(DISTINCT hour(ts)) AS hours, arg_min(event_type, (ts, event_id)) AS opens FROM events GROUP BY 1, 2),
  p AS (SELECT b.mix, b.id, max(a.id) AS before FROM w a JOIN w b ON a.mix = b.mix AND a.id < b.id AND abs(a.t0 - b.t0) <= 1 AND a.opens = b.opens AND len(list_intersect(a.hours, b.hours)) >= 0.8 * least(len(a.hours), len(b.hours)) GROUP BY b.mix, b.id),
  up AS (SELECT mix, id, before FROM p UNION ALL SELECT up.mix, up.id, p.before FROM up JOIN p ON p.mix = up.mix AND p.id = up.before)"""


@query("e09_alias_canonical", f"WITH RECURSIVE {_ALIAS} SELECT w.mix, w.id, coalesce(min(up.before), w.id) AS canonical FROM w LEFT JOIN up ON up.mix = w.mix AND up.id = w.id GROUP BY w.mix, w.id")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one id that each user of a day counts under: first hours within one, hours shared to 0.8 of the fewer, equal first events."""
    e = table(spark, sf_dir, "events").withColumn("mix", F.to_date("ts"))
    w = e.groupBy("mix", F.col("user_id").alias("id")).agg((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("t0"), F.collect_set(F.hour("ts")).alias("hours"), F.min_by("event_type", F.struct("ts", "event_id")).alias("opens"))
    return sequences.canonical_ids(w, "mix", "id", "t0", "hours", 1.0, 0.8, same=["opens"])


@query("e14_e15_s15_stream_log", """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, value, n FROM r WHERE k = 1""")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log by a stream that is drained twice from one checkpoint, then replayed: each user's last row, and how many there are."""
    like = table(spark, sf_dir, "events")
    path = f"{_folder(spark)}/log-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run finds nothing left to do
        stream = windows.read_stream(spark, f"{sf_dir}/events.parquet*", like).select("event_id", "user_id", "value")
        windows.append_log(stream, ["event_id"], f"{path}/rows", f"{path}/checkpoint")
    log = spark.read.parquet(f"{path}/rows")
    return log.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"), F.count("*").alias("n"))


@query("l13_entity_split", """WITH c AS (SELECT genre, dj_id, count(*) AS n FROM sets GROUP BY genre, dj_id), h AS (SELECT *, row_number() OVER (PARTITION BY dj_id ORDER BY n DESC, genre) AS k, sum(n) OVER (PARTITION BY dj_id) AS every FROM c),
  f AS (SELECT * FROM h WHERE k = 1), r AS (SELECT genre, sum(every) * 0.15 AS room FROM f GROUP BY genre),
  a AS (SELECT f.dj_id, sum(every) OVER (PARTITION BY genre ORDER BY md5(CAST(dj_id AS VARCHAR)), dj_id ROWS UNBOUNDED PRECEDING) AS upto, genre FROM f WHERE every BETWEEN 3 AND 40)
  SELECT f.dj_id, CASE WHEN a.upto <= r.room THEN 'validation' ELSE 'train' END AS split FROM f LEFT JOIN a ON a.dj_id = f.dj_id LEFT JOIN r ON r.genre = f.genre""")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole DJs on one side, 15 % of each genre's sets in validation."""
    return splits.entity_split(spark, view(spark, sf_dir, "sets").select("dj_id", "genre", "set_id"), "dj_id", "genre", 0.15, 3, 40)


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("l20_hard_negatives", f"""WITH c AS (SELECT a.vec_id, b.vec_id AS other, {_COSINE} AS cosine FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 100 = 0),
  k AS (SELECT 'hard' AS kind, * FROM c UNION ALL SELECT 'semi-hard' AS kind, * FROM c WHERE round(cosine, 6) BETWEEN 0.4 AND 0.9), r AS (SELECT *, row_number() OVER (PARTITION BY kind, vec_id ORDER BY round(cosine, 6) DESC, other) AS k FROM k)
  SELECT kind, vec_id, other, round(cosine, 5) AS cosine FROM r WHERE k <= 5""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of other labels, and those at a distance of 0.1 to 0.6, for every id divisible by 100 against all."""
    every = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    queries = every.where("vec_id % 100 = 0")
    hard, semi = (vectors.nearest(queries, every, 5, other_label=True, least=lo, most=hi).withColumn("kind", F.lit(kind)) for kind, lo, hi in (("hard", -2.0, 2.0), ("semi-hard", 0.4, 0.9)))
    return hard.unionByName(semi).select("kind", F.col("id").alias("vec_id"), "other", F.round("cosine", 5).alias("cosine"))


@query("l22_similarity_stats", f"WITH c AS (SELECT {_COSINE} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT round(avg(cosine), 5) AS mean, round(stddev_pop(cosine), 5) AS sd, round(min(cosine), 5) AS lo, round(max(cosine), 5) AS hi FROM c")
def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and extremes of the cosines of all pairs of different vectors."""
    found = vectors.similarity_stats(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return found.select(*(F.round(c, 5).alias(c) for c in ("mean", "sd", "lo", "hi")))


@query("l26_rank_metrics", f"""WITH c AS (SELECT a.vec_id AS q, a.label = b.label AS alike, round({_COSINE}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, count(*) FILTER (NOT alike) OVER (PARTITION BY q ORDER BY score DESC) AS upto, count(*) FILTER (NOT alike) OVER (PARTITION BY q, score) AS ties, count(*) FILTER (NOT alike) OVER (PARTITION BY q) AS others FROM c),
  t AS (SELECT 1 + upto - ties AS rank, (2 * (others - upto) + ties) / (2.0 * others) AS area FROM r WHERE alike AND others > 0)
  SELECT round(avg(area), 6) AS auc, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_at_k, round(avg(1.0 / rank), 6) AS mrr, quantile_cont(rank, 0.5) AS median_rank FROM t""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine as a ranker, every vector against all others: same label is relevant; one true and the other labels' vectors."""
    return splits.vector_rank_metrics(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


# --- sources and sinks -------------------------------------------------------------------------------------
def _folder(spark: SparkSession) -> str:
    return f"{stage_table.shared_dir(spark)}/setloom-io-{spark.sparkContext.applicationId}"


@query("s01_csv_round_trip", "SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV and read by an explicit schema."""
    path = f"{_folder(spark)}/csv"
    stage_table.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return stage_table.read_csv(spark, path, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))


@query("s05_json_lines", "SELECT set_id, position, track_id FROM plays")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with nested track lists written as JSON lines, read by schema and exploded."""
    path = f"{_folder(spark)}/json"
    nested = view(spark, sf_dir, "plays").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("position", "track_id"))).alias("tracklist"))
    nested.write.mode("overwrite").json(path)
    back = stage_table.read_json_lines(spark, path, nested.schema)
    return back.select("set_id", F.explode_outer("tracklist").alias("t")).select("set_id", "t.position", "t.track_id")


@query("s09_json_document", "SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place, n_name AS name FROM nation")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document of regions with nations, parsed and flattened."""
    doc = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    text = doc.select("n_regionkey", F.to_json(F.struct("nations")).alias("j"))
    parsed = text.select(F.col("n_regionkey").alias("region"), F.from_json("j", "nations array<struct<n_nationkey: int, n_name: string>>").alias("d"))
    return parsed.select("region", F.posexplode("d.nations").alias("p", "n")).select("region", (F.col("p") + 1).alias("place"), F.col("n.n_name").alias("name"))


@query("s12_e11_append_and_resume", "SELECT c_custkey, c_name FROM customer")
def append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage table filled twice with overlapping rows, at first up to the middle key, then with all: every key once."""
    path = f"{_folder(spark)}/stage"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").limit(0).write.mode("overwrite").parquet(path)
    stage = stage_table.StageTable(spark, path, T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())]), ("c_custkey",))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    middle = customers.agg(((F.min("c_custkey") + F.max("c_custkey")) / 2).alias("middle"))
    stage.append(customers.join(F.broadcast(middle), F.col("c_custkey") <= F.col("middle")).drop("middle"))
    stage.append(customers)
    return stage.rows()


@query("s06_s07_folder_scan", "SELECT 'part' AS stem, count(*) > 0 AS full FROM part")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by stem."""
    return stage_table.read_folder(spark, f"{sf_dir}/part.parquet", "*").select("stem", (F.col("bytes") > 0).alias("full"))


@query("s16_dataset_export", "SELECT genre, count(*) AS n FROM sets GROUP BY genre")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets exported by date and read back as the latest version."""
    path = f"{_folder(spark)}/export"
    for date in ("2024-01-01", "2024-02-01"):
        view(spark, sf_dir, "sets").select("set_id", "genre").write.mode("overwrite").parquet(f"{path}/date={date}/sets")
    return stage_table.latest_version(spark, path, "sets").groupBy("genre").agg(F.count("*").alias("n"))


# --- streams -----------------------------------------------------------------------------------------------
_SLIDE = """SELECT s AS "start", event_type, count(*) AS n, round(sum(value), 4) AS votes FROM (
  SELECT event_type, value, to_timestamp(CAST(floor(epoch(ts) / 7200) * 7200 - k * 7200 AS BIGINT)) AT TIME ZONE 'UTC' AS s FROM events, (VALUES (0), (1), (2)) o(k)) x GROUP BY s, event_type"""


@query("e01_sliding_votes", _SLIDE)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in sliding windows of six hours, every two."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sliding_votes(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("e01_sliding_votes_stream", _SLIDE)
def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Structured Streaming over all that is there."""
    like = table(spark, sf_dir, "events")
    stream = windows.read_stream(spark, f"{sf_dir}/events.parquet*", like)
    return windows.drain(windows.sliding_votes(stream)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("e07_gap_sessions", f"""WITH e AS (SELECT user_id, ts FROM events), f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM e),
  i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of 12 hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = windows.sessions(e)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
