"""License scans: an exact set-similarity join of text blocks with license templates.

Words of a text are compared as sets. Texts are cut into overlapping blocks of words, of a size that goes
with the template's length, so that every place of a template lies within one block. Words of all templates
are ordered by how many documents hold them, rarest first, counted over the whole corpus. A block reaches
the containment ``|block & template| / |template| >= threshold`` only if it

- has one of the template's first ``n - need + 1`` words in that order (prefix filter),
- has at least ``need`` template words at all (length filter), and
- can have enough common words before and behind the prefix word, on both sides (positional filter).

What passes is verified by the intersection itself, so nothing is missed and nothing false is found. The
templates are few and given; their index goes to every task, and documents are neither shuffled nor joined
by key, so a hot word or source has no effect. A phrase is a template with threshold 1 whose words must
also stand consecutively, which is checked in the blocks found.

Null and empty texts give no words and no matches; repeated rows are scanned alike and all stay; other
columns are ignored; an empty table gives no rows. Words equally rare are ordered by their bytes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import lower_words, map_batches, table, text_or_empty

#: Phrases of the base labels. Fixed values.
PHRASES = {"mit": ("under the mit license",), "apache-2": ("apache license version 2",), "cc-by-nc": ("cc by nc",)}
#: Opening words of common license notices. Fixed values.
TEMPLATES = {
    "apache-2": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "cc-by": ("this work is licensed under a creative commons attribution 4.0 international license",),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0"),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4.0 international license",),
    "gpl-3": (
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "released under the mit license",
    ),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2.0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}


class Index:
    """The templates' prefix index. ``frequency``: documents by word; words without one count as rarest."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, tuple[str, ...]], threshold: float, frequency: dict[bytes, int]):
        listed = [(label, lower_words(t), threshold, False) for label, ts in templates.items() for t in ts]
        listed += [(label, lower_words(t), 1.0, True) for label, ts in phrases.items() for t in ts]
        self.order = {w: k for k, w in enumerate(sorted({w for x in listed for w in x[1]}, key=lambda w: (frequency.get(w, 0), w)))}
        self.by_prefix: dict[int, list[int]] = {}
        self.entries = []
        for k, (label, words, least, phrase) in enumerate(listed):
            ids = [self.order[w] for w in words]
            own = sorted(set(ids))
            need = max(1, math.ceil(least * len(own) - 1e-9))
            step = max(8, 1 << (len(ids) - 1).bit_length())
            self.entries.append((label, ids, own, need, phrase, step))
            for x in own[: len(own) - need + 1]:
                self.by_prefix.setdefault(x, []).append(k)
        self.starts_any = np.zeros(len(self.order) + 1, bool)
        self.starts_any[list(self.by_prefix)] = True

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """(label, is a phrase's place, first word, end word, containment) of every match, in order."""
        get = self.order.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        spots = np.flatnonzero(self.starts_any[ids])
        found: dict[tuple[int, int], tuple[str, bool, int, int, float]] = {}
        done: set[tuple[int, int]] = set()
        for at in spots.tolist():
            for k in self.by_prefix[int(ids[at])]:
                label, seq, own, need, phrase, step = self.entries[k]
                for block in {at // step, max(0, at // step - 1)}:
                    if (k, block) in done:
                        continue
                    done.add((k, block))
                    part = ids[block * step : block * step + 2 * step]
                    have = np.unique(part[part >= 0])
                    if len(have) < need:
                        continue
                    # common words stand before, at, or behind this one, on both sides
                    mine, its = int(np.searchsorted(have, ids[at])), own.index(int(ids[at]))
                    if min(mine, its) + min(len(have) - mine, len(own) - its) < need:
                        continue
                    common = np.intersect1d(have, own, assume_unique=True)
                    if len(common) < need:
                        continue
                    if phrase:
                        for s in np.flatnonzero(part == seq[0]).tolist():
                            if part[s : s + len(seq)].tolist() == seq:
                                found[k, block * step + s] = (label, True, block * step + s, block * step + s + len(seq), 1.0)
                    else:
                        inside = np.flatnonzero(np.isin(part, common))
                        found[k, -1 - block] = (label, False, block * step + int(inside[0]), block * step + int(inside[-1]) + 1, len(common) / len(own))
        return sorted(found.values(), key=lambda m: (m[2], m[3], m[0], m[1]))


def word_frequency(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each of the given words; counts are summed per task before the shuffle."""

    def start():
        def run(cols):
            n = Counter()
            for t in cols["t"]:
                n.update(words.intersection(lower_words(t)))
            return {"word": list(n), "n": list(n.values())} if n else None

        return run

    rows = map_batches(docs.select(text_or_empty(text_col).alias("t")), "word binary, n bigint", start)
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, key: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, tuple[str, ...]] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per document: key, ``n_words`` and ``matches``, an array of (label, phrase, first_word, end_word, containment)."""
    vocabulary = {w for group in (templates, phrases) for ts in group.values() for t in ts for w in lower_words(t)}
    frequency = word_frequency(docs, vocabulary, text_col)

    def start():
        index = Index(templates, phrases, threshold, frequency)
        fields = ("label", "phrase", "first_word", "end_word", "containment")

        def run(cols):
            words = [lower_words(t) for t in cols["t"]]
            return {key: cols[key], "n_words": list(map(len, words)), "matches": [[dict(zip(fields, m)) for m in index.matches(w)] for w in words]}

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text_or_empty(text_col).alias("t")), f"`{key}` {kind}, n_words bigint, matches array<struct<label: string, phrase: boolean, first_word: bigint, end_word: bigint, containment: double>>", start)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels, and the method's labels and score, of every document."""
    found = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("matches", lambda m: m.phrase))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m.first_word)).alias("first_word"),
        F.array_max(F.transform("base", lambda m: m.first_word)).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.containment)), F.lit(0.0)).alias("score"),
    )


def _duck() -> str:
    """The same by DuckDB: words as rows, phrases by their first word, blocks by the template words in them."""
    index = Index(TEMPLATES, PHRASES, 0.8, {})
    name = {v: k.decode() for k, v in index.order.items()}
    quoted = lambda words: "[" + ", ".join(f"'{name[x]}'" for x in words) + "]"
    rows = ", ".join(f"({k}, '{label}', {quoted(seq)}, {quoted(own)}, {need}, {phrase}, {step})" for k, (label, seq, own, need, phrase, step) in enumerate(index.entries))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t(k, label, seq, own, need, phrase, step) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT r, p, words[p + 1] AS word FROM (SELECT r, words, unnest(range(len(words))) AS p FROM d) x),
base AS (SELECT w.r, t.label, w.p FROM w JOIN t ON t.phrase AND w.word = t.seq[1] JOIN d ON d.r = w.r AND d.words[w.p + 1 : w.p + len(t.seq)] = t.seq),
o AS (SELECT k, label, len(own) AS size, need, step, unnest(own) AS word FROM t WHERE NOT phrase),
h AS (SELECT w.r, o.k, o.label, o.size, o.need, o.word, w.p // o.step - v.back AS block FROM w JOIN o ON o.word = w.word, (VALUES (0), (1)) v(back) WHERE w.p // o.step >= v.back),
m AS (SELECT r, label, count(DISTINCT word) / CAST(size AS DOUBLE) AS share FROM h GROUP BY r, k, label, size, need, block HAVING count(DISTINCT word) >= need),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT r, label, share FROM m UNION ALL SELECT r, label, 1.0 FROM base) y GROUP BY r)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0) AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN a ON a.r = d.r
"""


SQL = _duck()
