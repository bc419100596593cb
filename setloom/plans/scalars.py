"""Scalar functions over strings, dates, numbers, arrays and JSON, each bound to a table of the test data."""

from __future__ import annotations

from setloom.plans.registry import shared

KEY = "regexp_replace(lower({}), '[^a-z0-9]', '')"
KEY_G = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def both(name: str, sql: str) -> None:
    """Register SQL whose only difference is that DuckDB must be told to replace every match."""
    shared(name, sql.replace("<g>", "").replace("\\", "\\\\"), sql.replace("<g>", ", 'g'"))


# ids and keys
shared("f01_track_id", "SELECT track_id, substring(md5(lower(concat(artist, '|', title))), 1, 12) AS id FROM tracks")
shared("f01b_set_id", "SELECT page_id, substring(md5(url), 1, 10) AS id FROM pages")
both("f02_record_key", "SELECT track_id, regexp_replace(lower(concat(artist, title)), '[^a-z0-9]', ''<g>) AS record_key, regexp_replace(replace(replace(lower(title), '&', 'and'), '+', 'plus'), '[^a-z0-9]', ''<g>) AS dj_key FROM tracks")
shared("f03_split_title", "SELECT n_nationkey, CASE WHEN strpos(x, ' - ') > 0 THEN substring(x, 1, strpos(x, ' - ') - 1) ELSE '' END AS artist, CASE WHEN strpos(x, ' - ') > 0 THEN substring(x, strpos(x, ' - ') + 3) ELSE x END AS title FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE concat(n_name, ' - ', 'x') END AS x FROM nation) t".replace("strpos", "instr"))
shared("f04_genre_cascade", "SELECT track_id, CASE WHEN lower(style) LIKE '%small%' THEN 'drum' WHEN lower(style) LIKE '%economy%' THEN 'trance' WHEN lower(style) LIKE '%standard%' THEN 'tech house' WHEN lower(style) LIKE '%promo%' THEN 'techno' ELSE 'other' END AS genre FROM tracks")
shared("f05_setting", "SELECT doc_id, CASE WHEN regexp_like(lower(text), '(club|festival|live)') AND NOT regexp_like(lower(text), '(radio|mix)') THEN 'club' WHEN regexp_like(lower(text), '(radio|mix)') THEN 'radio' WHEN text LIKE '%@%' THEN 'club' ELSE 'unknown' END AS setting FROM documents", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(club|festival|live)') AND NOT regexp_matches(lower(text), '(radio|mix)') THEN 'club' WHEN regexp_matches(lower(text), '(radio|mix)') THEN 'radio' WHEN text LIKE '%@%' THEN 'club' ELSE 'unknown' END AS setting FROM documents")
shared("f05b_seam_id", "SELECT set_id, position, concat_ws('_', set_id, track_id, position) AS seam_id FROM plays")
#: Words that keep a bracket. Fixed values.
VERSION_WORDS = ("remix", "mix", "edit", "version", "dub", "instrumental", "reprise", "remaster")
_NAMED = "concat(title, CASE track_id % 4 WHEN 0 THEN ' [promo]' WHEN 1 THEN ' [Extended Mix]' WHEN 2 THEN ' [x Remix] [label]' ELSE ' [remixed]' END)"
shared(
    "f06_clean_name",
    f"SELECT track_id, trim(regexp_replace({_NAMED}, '(?i)\\\\[(?!([^\\\\]]*\\\\s)?({'|'.join(VERSION_WORDS)})(\\\\s[^\\\\]]*)?\\\\])[^\\\\]]*\\\\]', '')) AS name FROM tracks",
    f"SELECT track_id, trim(array_to_string(list_filter(regexp_extract_all({_NAMED}, '\\[[^\\]]*\\]|[^\\[]+|\\['), lambda x: NOT regexp_full_match(x, '\\[[^\\]]*\\]') OR len(list_intersect(string_split(lower(x[2:-2]), ' '), {list(VERSION_WORDS)})) > 0), '')) AS name FROM tracks",
)
both("p04_placeholder", "SELECT n_nationkey, regexp_replace(concat(n_name, ' (feat x) (live)'), '( *\\([^)]*\\))+ *$', ''<g>) AS reduced FROM nation")
shared("p10_regex_row_filter", "SELECT doc_id FROM documents WHERE NOT regexp_like(coalesce(text, ''), '[0-9]')", "SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[0-9]')")
shared("p15_candidate_gate", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 300 AND 1200 AND NOT regexp_like(text, '(@|http|[|])')", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 300 AND 1200 AND NOT regexp_matches(text, '(@|http|[|])')")
shared("f07_split_artists", "SELECT track_id, array_join(array_sort(array_distinct(split(lower(title), ' '))), '|') AS artists FROM tracks", "SELECT track_id, array_to_string(list_sort(list_distinct(string_split(lower(title), ' '))), '|') AS artists FROM tracks")
shared("f08_word_overlap", "SELECT a.track_id, size(array_intersect(split(a.title, ' '), split(b.title, ' '))) / CAST(size(array_distinct(split(a.title, ' '))) AS DOUBLE) AS share FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1", "SELECT a.track_id, len(list_intersect(string_split(a.title, ' '), string_split(b.title, ' '))) / CAST(len(list_distinct(string_split(a.title, ' '))) AS DOUBLE) AS share FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")
shared("f10_words_minus_generic", "SELECT track_id, array_join(array_sort(array_except(split(lower(title), ' '), array('the', 'mix', 'part'))), '|') AS words FROM tracks", "SELECT track_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(title), ' '), lambda x: x NOT IN ('the', 'mix', 'part')))), '|') AS words FROM tracks")
both("f11_dj_from_title", "SELECT set_id, substring(regexp_replace(regexp_replace(concat(CAST(CAST(played_on AS DATE) AS STRING), ' dj', dj_id, ' @ ', genre), '^[0-9-]+ ', ''<g>), ' @ .*$', ''<g>), 1, 60) AS dj FROM sets".replace("AS STRING", "AS VARCHAR(20)"))
shared("f12_dj_from_slug", "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS slug FROM pages")
shared("f13_cue_to_minutes", "SELECT event_id, hour(ts) * 60 + minute(ts) + second(ts) / 60.0E0 AS minutes, lpad(CAST(minute(ts) AS VARCHAR(2)), 2, '0') AS mm FROM votes")
shared("f14_normalise_key", "SELECT track_id, CASE energy % 4 WHEN 0 THEN 'C#' WHEN 1 THEN 'D#m' WHEN 2 THEN 'F#' ELSE 'A#m' END AS key_sharp FROM tracks")
both("f15_own_music", "SELECT track_id, length(regexp_replace(lower(artist), '[^a-z0-9]', ''<g>)) >= 4 AND instr(regexp_replace(lower(concat(title, artist)), '[^a-z0-9]', ''<g>), substring(regexp_replace(lower(artist), '[^a-z0-9]', ''<g>), 1, 8)) > 0 AS own FROM tracks")
shared("f16_search_queries", "SELECT track_id, concat(artist, ' ', title) AS q1, concat(title, ' ', artist) AS q2, concat('\"', title, '\"') AS q3 FROM tracks")
shared("f17_display_name", "WITH k AS (SELECT lower(c_mktsegment) AS k, min(c_name) AS name FROM customer GROUP BY lower(c_mktsegment)) SELECT c.c_custkey, coalesce(k.name, c.c_name) AS name FROM customer c LEFT JOIN k ON lower(c.c_mktsegment) = k.k")
shared("f18_name_score", "SELECT a.track_id, round(0.6E0 * size(array_intersect(split(a.title, ' '), split(b.title, ' '))) + 0.4E0 * (CASE WHEN a.artist = b.artist THEN 1 ELSE 0 END) - 0.01E0 * levenshtein(a.title, b.title), 6) AS score FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1", "SELECT a.track_id, round(0.6 * len(list_intersect(string_split(a.title, ' '), string_split(b.title, ' '))) + 0.4 * (CASE WHEN a.artist = b.artist THEN 1 ELSE 0 END) - 0.01 * levenshtein(a.title, b.title), 6) AS score FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")
shared("u05_subset", "SELECT a.track_id, size(array_except(split(a.title, ' '), split(b.title, ' '))) = 0 AS inside FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1", "SELECT a.track_id, len(list_filter(string_split(a.title, ' '), lambda x: NOT list_contains(string_split(b.title, ' '), x))) = 0 AS inside FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")

# dates, numbers, arrays, JSON
shared("f30_date_from_text", "SELECT set_id, to_date(regexp_extract(concat('x/', CAST(CAST(played_on AS DATE) AS VARCHAR(10)), '-set'), '((19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})', 1)) AS day FROM sets", "SELECT set_id, CAST(regexp_extract(concat('x/', CAST(CAST(played_on AS DATE) AS VARCHAR), '-set'), '((19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})', 1) AS DATE) AS day FROM sets")
shared("f31_months", "SELECT set_id, datediff(played_on, TIMESTAMP_NTZ '1992-01-01 00:00:00') / 30.4E0 AS months FROM sets", "SELECT set_id, date_diff('day', TIMESTAMP '1992-01-01 00:00:00', played_on) / 30.4E0 AS months FROM sets")
shared("f32_year", "SELECT set_id, CAST(substring(CAST(played_on AS VARCHAR(30)), 1, 4) AS INT) AS year FROM sets")
CAMELOT = "CASE WHEN a.energy > 40 OR b.energy > 40 THEN 2.5E0 ELSE least(abs(a.energy % 12 - b.energy % 12), 12 - abs(a.energy % 12 - b.energy % 12)) + CASE WHEN a.energy % 2 <> b.energy % 2 THEN 0.5E0 ELSE 0.0E0 END END"
shared("f33_camelot", f"SELECT a.track_id, {CAMELOT} AS distance FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")
shared("f34_camelot_plain", "SELECT a.track_id, CASE WHEN a.energy > 40 OR b.energy > 40 THEN 6 ELSE least(abs(a.energy % 12 - b.energy % 12), 12 - abs(a.energy % 12 - b.energy % 12)) END AS distance FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")
shared("f35_compatibility", f"SELECT a.track_id, round(0.5E0 * greatest(0.0E0, 1 - abs(ln(a.bpm / b.bpm)) / 0.5E0) + 0.3E0 * greatest(0.0E0, 1 - {CAMELOT} / 6) + 0.2E0 * greatest(0.0E0, 1 - abs(a.energy - b.energy) / 50.0E0), 6) AS score FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")
shared("f36_overlap_tier", "SELECT track_id, CASE WHEN energy >= 40 THEN 64 WHEN energy >= 25 THEN 32 WHEN energy >= 10 THEN 16 ELSE 8 END AS max_overlap FROM tracks")
shared("f37_log_ratio", "SELECT a.track_id, round(ln(a.bpm / b.bpm), 9) AS lr, round(ln(1 + a.energy), 9) AS l1, least(greatest(a.energy - b.energy, -20), 20) AS clipped FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1")
shared("f38_z_within", "SELECT track_id, round((bpm - avg(bpm) OVER (PARTITION BY style)) / (stddev_pop(bpm) OVER (PARTITION BY style) + 1e-9), 6) AS z FROM tracks")
shared("f39_curves", "SELECT position, round(sin(3.141592653589793E0 * position / 7), 9) AS arc, CASE WHEN position < 4 THEN position / 4.0E0 ELSE 1.0E0 END AS build FROM plays WHERE set_id = (SELECT min(set_id) FROM plays) OR position = 6 GROUP BY position")
shared("f40_cosine", "SELECT a.vec_id, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0.0E0, (s, x) -> s + x) / sqrt(aggregate(a.embedding, 0.0E0, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate(b.embedding, 0.0E0, (s, x) -> s + CAST(x AS DOUBLE) * x)), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
shared("f41_span_mean", "SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, posexplode(embedding) AS (pos, x) FROM embeddings) t WHERE pos < 4 GROUP BY label, pos", "SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) t WHERE pos < 4 GROUP BY label, pos")
shared("f42_bar_seconds", "SELECT track_id, round(240 / bpm, 9) AS bar_s, CASE WHEN energy = 0 THEN NULL ELSE round(8 * 240 / bpm / energy, 6) END AS bars FROM tracks")
shared("f43_grid_snap", "SELECT event_id, rint(votes / 10) * 10 AS snapped FROM votes", "SELECT event_id, round_even(votes / 10, 0) * 10 AS snapped FROM votes")
shared("f44_affine_map", "SELECT set_id, position, (qty - 3) * 1.02E0 AS mix_time, qty / 1.02E0 + 3 AS record_time FROM plays")
shared("f45_window_bounds", "SELECT set_id, position, greatest(0, least(qty, 60) - 25) AS lo, least(qty + 25, 60) AS hi FROM plays")
shared("f46_json_flatten", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM votes", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM votes")
shared("f47_array_text", "SELECT track_id, size(split(concat_ws(' ', artist, style), ' ')) AS n, concat(artist, '=', title) AS pair FROM tracks", "SELECT track_id, len(string_split(concat_ws(' ', artist, style), ' ')) AS n, concat(artist, '=', title) AS pair FROM tracks")
shared("f48_encodings", "SELECT set_id, CASE WHEN setting = 'F' THEN 1 ELSE 0 END AS is_f, CASE WHEN setting = 'O' THEN 1 ELSE 0 END AS is_o, round(sin(6.283185307179586E0 * month(played_on) / 12), 9) + 0.0E0 AS month_sin, round(cos(6.283185307179586E0 * month(played_on) / 12), 9) + 0.0E0 AS month_cos FROM sets")
shared("s08_json_column", "SELECT series_id, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM votes GROUP BY series_id", "SELECT series_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM votes GROUP BY series_id")
shared("s10_html_rows", "SELECT page_id, size(regexp_extract_all(html, '(<p)', 1)) AS paragraphs, size(regexp_extract_all(html, '(<a )', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages", "SELECT page_id, len(regexp_extract_all(html, '(<p)', 1)) AS paragraphs, len(regexp_extract_all(html, '(<a )', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
shared("s11_text_lines", "SELECT doc_id, pos, line FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM documents) t WHERE length(line) BETWEEN 10 AND 200", "SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) t WHERE length(line) BETWEEN 10 AND 200")
