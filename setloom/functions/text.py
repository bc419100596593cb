"""Names and titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keep a bracket. Fixed values.
VERSION_WORDS = ("remix", "mix", "edit", "version", "dub", "instrumental", "reprise", "remaster")


def record_key(*parts: Column) -> Column:
    """Small letters and digits of the joined parts."""
    return F.regexp_replace(F.lower(F.concat(*parts)), "[^a-z0-9]", "")


def clean_name(name: Column, keep: tuple[str, ...] = VERSION_WORDS) -> Column:
    """The name without its brackets, but for those that hold one of the words to keep."""
    kept = rf"(?![^\]]*?(?<=[\[\s])(?:{'|'.join(keep)})(?=[\s\]]))"
    return F.btrim(F.regexp_replace(name, rf"(?i)\[{kept}[^\]]*\]", ""))


def split_title(title: Column) -> Column:
    """(artist, title) around the first `` - ``; without one the artist is empty."""
    at = F.instr(title, " - ")
    return F.struct(F.when(at > 0, F.substr(title, F.lit(1), at - 1)).otherwise(F.lit("")).alias("artist"), F.when(at > 0, F.substr(title, at + 3)).otherwise(title).alias("title"))


def own_music(artist: Column, dj: Column) -> Column:
    """Whether the first eight characters of the DJ's key, four at least, stand in the artist's."""
    key = F.substring(record_key(dj), 1, 8)
    return (F.length(key) >= 4) & F.contains(record_key(artist), key)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the first text's distinct words that the second has too."""
    words = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    return F.size(F.array_intersect(words(a), words(b))) / F.size(words(a)).cast("double")
