"""Quality rules with DataFrame expressions only: distribution divergence from language references.

A document's character-class histogram and its histogram of common words are compared with those of its
language by Jensen-Shannon distance (base 2, 0 to 1). References are sums over all documents of the
language; a language outside :data:`COMMON_WORDS` is held against all documents together, so at most
``len(COMMON_WORDS) + 1`` small rows ever reach the driver. Short documents are not judged by histograms
that they are too short for (``min_chars``, ``min_words``).

Null texts count as empty: no words, so ``base_failed``. An unknown or null language uses the pooled
reference. Repeated rows are judged alike and all stay; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import table, text_or_empty

#: Frequent words by language. Fixed values.
COMMON_WORDS = {
    "de": ("die", "der", "und", "in", "den", "das", "ist", "nicht"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "with"),
    "es": ("de", "la", "que", "el", "en", "los", "un", "con"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "que"),
}
POOLED = "*"
CLASSES = ("lower", "upper", "digit", "stop", "symbol", "other", "space")
WORD_GAP = r"[\x20\x09-\x0D]+"


def _histograms(docs: DataFrame) -> DataFrame:
    """Adds counts: ``n_words``, ``word_chars``, ``n_symbols``, ``chars`` by class and ``common`` by word."""
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(POOLED))
    solid = reduce(lambda x, gap: F.replace(x, F.lit(gap), F.lit("")), " \n\t\r\x0b\x0c", F.col("__text"))
    df = docs.withColumn("__lang", lang).withColumn("__solid", solid).withColumn("__r1", F.regexp_replace("__solid", "[a-z]+", ""))
    df = df.withColumn("__r2", F.regexp_replace("__r1", "[A-Z]+", ""))
    df = df.withColumn("__r3", F.regexp_replace("__r2", "[0-9]+", ""))
    df = df.withColumn("__r4", F.regexp_replace("__r3", r"""[.,;:!?'"()\-]+""", ""))
    df = df.withColumn("__r5", F.regexp_replace("__r4", r"[#*$%&|<>]+", ""))
    n = [F.length(c) for c in ("__solid", "__r1", "__r2", "__r3", "__r4", "__r5")]
    chars = F.array(*(n[i] - n[i + 1] for i in range(5)), n[5], F.length("__text") - n[0])
    df = df.withColumn("__chars", chars).withColumn("word_chars", n[0].cast("long")).withColumn("n_symbols", (n[4] - n[5]).cast("long"))
    df = df.drop("__solid", "__r1", "__r2", "__r3", "__r4", "__r5")
    df = df.withColumn("__trimmed", F.btrim("__text", F.lit(" \t\n\x0b\f\r")))
    words = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", WORD_GAP))
    df = df.withColumn("__words", words).drop("__trimmed").withColumn("n_words", F.size("__words").cast("long"))
    # index of each common word in its language's list; the pooled row has no list of its own
    lists = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    df = df.withColumn("__list", F.coalesce(lists[F.col("__lang")], F.array().cast("array<string>")))
    df = df.withColumn("__hits", F.expr("filter(transform(__words, w -> if(length(w) < 6, array_position(__list, lower(w)), 0L)), x -> x > 0)"))
    common = [F.expr(f"size(filter(__hits, x -> x = {k + 1}))") for k in range(8)]
    return df.withColumn("__common", F.array(*common, (F.col("n_words") - F.size("__hits")).cast("int"))).drop("__list", "__hits")


def _shares(counts: Column) -> Column:
    """Counts to shares; all 0 if there is nothing to count."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def language_references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word shares of every language, over all documents; five rows at most."""
    counted = _histograms(docs.select("lang", text_or_empty().alias("__text")))
    sums = [F.sum(F.col("__chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("__common")[i]).alias(f"w{i}") for i in range(9)]
    rows = {r["__lang"]: r for r in counted.groupBy("__lang").agg(*sums).collect()}
    share = lambda x: [v / max(1, sum(x)) for v in x]
    chars = {k: [r[f"c{i}"] or 0 for i in range(len(CLASSES))] for k, r in rows.items()}
    common = {k: [r[f"w{i}"] or 0 for i in range(9)] for k, r in rows.items()}
    chars[POOLED] = reduce(lambda a, b: [x + y for x, y in zip(a, b)], chars.values(), [0] * len(CLASSES))
    common.pop(POOLED, None)  # words of a language without a list say nothing
    return {k: (share(v), share(common[k]) if k in common else []) for k, v in chars.items()}


def judge(docs: DataFrame, max_char_distance: float = 0.3, max_word_distance: float = 0.22, min_chars: int = 200, min_words: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``keep`` columns, the counts, both distances, ``base_failed`` and ``kept``.

    ``docs`` has ``lang`` and ``text``. The references are learned from ``docs`` in a first pass.
    """
    refs = language_references(docs)
    df = _histograms(docs.select(*keep, F.col("lang"), text_or_empty().alias("__text")) if "lang" not in keep else docs.select(*keep, text_or_empty().alias("__text")))
    # lines with a word that equal an earlier line
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    # words in windows of three that are found twice: equal windows are neighbours once sorted
    df = df.withColumn("__windows", F.expr("if(n_words < 4, array(), transform(sequence(0, int(n_words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"))
    df = df.withColumn("__sorted", F.expr("if(size(array_distinct(__windows)) = size(__windows), null, sort_array(transform(__windows, (h, i) -> struct(h as h, i as i))))"))
    df = df.withColumn("__again", F.expr("filter(__sorted, (x, i) -> get(__sorted, i - 1).h <=> x.h or get(__sorted, i + 1).h <=> x.h)"))
    df = df.withColumn("n_repeat_words", F.expr("coalesce(cast(size(array_distinct(flatten(transform(__again, x -> array(x.i, x.i + 1, x.i + 2))))) as long), 0L)"))
    df = df.withColumn("n_repeat_words", F.when(F.col("__sorted").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_repeat_words")))
    literal = lambda x: F.array(*(F.lit(float(v)) for v in x)).cast("array<double>")
    chars, words = literal(refs[POOLED][0]), literal([])
    for k in COMMON_WORDS:
        if k in refs:
            chars, words = F.when(F.col("__lang") == k, literal(refs[k][0])).otherwise(chars), F.when(F.col("__lang") == k, literal(refs[k][1])).otherwise(words)
    df = df.withColumn("char_distance", F.when(F.expr("aggregate(__chars, 0, (a, x) -> a + x)") >= min_chars, js_distance(_shares(F.col("__chars")), chars)))
    df = df.withColumn("word_distance", F.when((F.col("n_words") >= min_words) & (F.size(words) > 0), js_distance(_shares(F.col("__common")), words)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    verdict = F.struct(*counts, failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance")
    # generated columns hold a caller's filter here: below the steps above it would repeat each of them many times
    return df.select(*keep, F.inline(F.array(verdict)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document; distances to six places."""
    judged = judge(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def _duck() -> str:
    """The same by DuckDB: words by regular expression, windows as rows, references as sums."""
    named = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    classes = ["[a-z]", "[A-Z]", "[0-9]", """[.,;:!?''"()\\-]""", "[#*$%&|<>]"]
    count = ", ".join(f"length(solid) - length(regexp_replace(solid, '{c}', '', 'g'))" for c in classes)
    hits = ", ".join(f"len(list_filter(words, lambda w: lower(w) = list[{k + 1}]))" for k in range(8))
    sums = lambda c, n: ", ".join(f"sum({c}[{k + 1}])" for k in range(n))
    share = lambda x: f"list_transform({x}, lambda v: CASE WHEN list_sum({x}) > 0 THEN v / CAST(list_sum({x}) AS DOUBLE) ELSE 0.0 END)"
    distance = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0.0 END)) / 2, 0.0))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({named}) THEN lang ELSE '{POOLED}' END AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS solid, CASE lang {lists} ELSE [] END AS list,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
h AS (SELECT r, doc_id, lang, words, text, lines, len(words) AS n_words, length(solid) AS word_chars, [{count}, 0, length(text) - length(solid)] AS five, length(solid) AS n_solid, [{hits}] AS eight FROM w),
c AS (SELECT *, [five[1], five[2], five[3], five[4], five[5], n_solid - list_sum(five[1:5]), five[7]] AS chars, list_append(eight, n_words - list_sum(eight)) AS common FROM h),
ref AS (SELECT lang, [{sums("chars", 7)}] AS chars, [{sums("common", 9)}] AS common FROM c GROUP BY lang),
every AS (SELECT [{sums("chars", 7)}] AS chars FROM c),
x AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT r, words, unnest(range(1, n_words - 1)) AS i FROM c) t),
y AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
again AS (SELECT r, count(DISTINCT i + o) AS n FROM y, (VALUES (0), (1), (2)) v(o) GROUP BY r),
j AS (SELECT c.*, coalesce(again.n, 0) AS n_repeat_words,
  CASE WHEN length(c.text) >= 200 THEN {distance(share("c.chars"), share(f"CASE WHEN c.lang = '{POOLED}' THEN every.chars ELSE ref.chars END"))} END AS char_distance,
  CASE WHEN c.n_words >= 100 AND c.lang <> '{POOLED}' THEN {distance(share("c.common"), share("ref.common"))} END AS word_distance
  FROM c JOIN ref ON ref.lang = c.lang CROSS JOIN every LEFT JOIN again ON again.r = c.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(chars[5] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(char_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.22 AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM j
"""


SQL = _duck()
