"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``min_match`` words (a seed) are a candidate pair. Seeds
are found by Karp-Rabin fingerprints of the document's words against those of the items, and are checked word
by word. The pair is then tiled: runs of ``FIRST`` words or more that are unmarked on both sides are sought
first, by fingerprints that run over both texts, then ever shorter ones, at last those of ``min_match`` words.
Of all maximal runs found the longest is marked; runs that lost words to it are cut and tried again. Tiles may
stand in any order, so reordered passages count in full. An item is leaked into a document if tiles cover at
least ``coverage`` of its words.

Items are read in blocks of at most ``block_words`` words; every block is held against all documents, so
the benchmark may be of any size while each task holds one block. Documents are not shuffled.

Items without words never match; an item shorter than ``min_match`` must occur as a whole. Null and empty
texts have no words. Repeated rows give repeated pairs. Runs of equal length are taken by their place in the
item, then in the document. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import lower_words, map_batches, table, text_or_empty

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Words of the runs that are sought first, and pairs of equal windows that are looked at once.
FIRST, PAIRS = 32, 1_000_000


class Words:
    """A text as numbers (negative ones match nothing), with fingerprints of its windows of any length, modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        power = np.full(len(ids) + 1, _BACK, np.uint64)
        power[0] = 1
        sums = (ids + 2).astype(np.uint64) * np.cumprod(power)[: len(ids)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sums)))
        power[1:] = _BASE
        self.power = np.cumprod(power)

    def __len__(self) -> int:
        return len(self.ids)

    def fingerprints(self, n: int) -> np.ndarray:
        """Of the windows of n words, one for each start: sums that run along, shifted to the window's start."""
        return (self.sums[n:] - self.sums[: len(self.sums) - n]) * self.power[: max(0, len(self.sums) - n)]

    def windows(self, free: np.ndarray, n: int) -> np.ndarray:
        """Starts of the windows of n words that are all free."""
        taken = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(taken[n:] == taken[: len(taken) - n]) if len(self) >= n else np.zeros(0, np.int64)


def common_runs(a: Words, b: Words, free_a: np.ndarray, free_b: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(-length, start in a, start in b) of all maximal common runs of n free words or more."""
    at_a, at_b = a.windows(free_a, n), b.windows(free_b, n)
    if not len(at_a) or not len(at_b):
        return []
    marks = a.fingerprints(n)[at_a]
    order = np.argsort(marks, kind="stable")
    at_a, marks = at_a[order], marks[order]
    sought = b.fingerprints(n)[at_b]
    lo = np.searchsorted(marks, sought)
    times = np.searchsorted(marks, sought, side="right") - lo
    hit = np.flatnonzero(times)
    upto = np.cumsum(times[hit])
    starts, ends, done = [], [], 0
    while done < len(hit):  # some windows of b at a time, so that texts that repeat themselves don't make all pairs at once
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, side="right")))
        some = hit[done:stop]
        k = times[some]
        j = np.repeat(at_b[some], k)
        i = at_a[np.repeat(lo[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        same = lambda x, y: (x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b)) & free_a[x % len(a)] & free_b[y % len(b)] & (a.ids[x % len(a)] == b.ids[y % len(b)])
        first, last = ~same(i - 1, j - 1), ~same(i + n, j + n)
        starts.append(np.column_stack((j - i, i))[first])
        ends.append(np.column_stack((j - i, i))[last])
        done = stop
    if not starts:
        return []
    (d, i), (_, e) = (x[np.lexsort((x[:, 1], x[:, 0]))].T for x in (np.concatenate(starts), np.concatenate(ends)))
    found = [(x - y - n, x, x + diagonal) for diagonal, x, y in zip(d.tolist(), i.tolist(), e.tolist())]
    # fingerprints only propose
    return [r for r in found if np.array_equal(a.ids[r[1] : r[1] - r[0]], b.ids[r[2] : r[2] - r[0]])]


def tile(a: Words, b: Words, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length) of at least k words, longest first."""
    free_a, free_b, tiles = a.ids >= 0, b.ids >= 0, []
    n = max(k, min(FIRST, len(a), len(b)))
    while True:
        runs = common_runs(a, b, free_a, free_b, n)
        longest = -min(runs)[0] if runs else 0
        if longest > 2 * n:
            n = longest
            continue
        heapq.heapify(runs)
        while runs:
            length, i, j = heapq.heappop(runs)
            free = free_a[i : i - length] & free_b[j : j - length]
            if free.all():
                tiles.append((i, j, -length))
                free_a[i : i - length] = False
                free_b[j : j - length] = False
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0])))).reshape(-1, 2)
            for s, e in edges.tolist():  # what is left of it, in unbroken parts
                if e - s >= n:
                    heapq.heappush(runs, (s - e, i + s, j + s))
        if n == k:
            return tiles
        n = max(k, n // 2)


class Block:
    """Some benchmark items, ready to be held against documents."""

    def __init__(self, items: list[tuple[object, list[bytes]]], min_match: int):
        self.items = [(key, words) for key, words in items if words]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.words = [Words(np.array([self.vocabulary[w] for w in ws], np.int64)) for _, ws in self.items]
        seeds: dict[int, dict[int, set[int]]] = {}
        for n, item in enumerate(self.words):
            k = min(min_match, len(item))
            places = seeds.setdefault(k, {})
            for h in item.fingerprints(k).tolist():
                places.setdefault(h, set()).add(n)
        self.seeds = {k: (np.array(sorted(places), np.uint64), places) for k, places in seeds.items()}

    def tiles(self, words: list[bytes]) -> Iterator[tuple[object, int, list[tuple[int, int, int]]]]:
        """(item's key, item's words, tiles) for every item that shares a seed with the words."""
        get = self.vocabulary.get
        text = Words(np.array([get(w, -1) for w in words], np.int64))
        for k, (known, places) in self.seeds.items():
            spots = text.windows(text.ids >= 0, k)
            if not len(spots):
                continue
            marks = np.unique(text.fingerprints(k)[spots])
            marks = marks[known[np.minimum(np.searchsorted(known, marks), len(known) - 1)] == marks]
            for n in sorted(set().union(*(places[h] for h in marks.tolist()))):
                tiles = tile(self.words[n], text, k)
                if tiles:
                    yield self.items[n][0], len(self.words[n]), tiles


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    block, size = [], 0
    for key, text in items.toLocalIterator():
        words = lower_words(text)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((key, words))
        size += len(words)
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, block_words: int = 2_000_000, key: str = "doc_id") -> DataFrame:
    """One row per leaked pair: document key, item_id, n_tiles, covered_words, item_words, coverage, tiles."""
    fields = ("item_start", "doc_start", "length")

    def held_against(items):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # of ``block_words`` words, or one item

        def start():
            block = Block(shared.value, min_match)

            def run(cols):
                rows = []
                for doc, text in zip(cols[key], cols["t"]):
                    for item, size, tiles in block.tiles(lower_words(text)):
                        covered = sum(x[2] for x in tiles)
                        if covered >= coverage * size:
                            rows.append((doc, item, len(tiles), covered, size, covered / size, [dict(zip(fields, x)) for x in tiles]))
                return dict(zip((key, "item_id", "n_tiles", "covered_words", "item_words", "coverage", "tiles"), map(list, zip(*rows)))) if rows else None

            return run

        schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_tiles bigint, covered_words bigint, item_words bigint, coverage double, tiles array<struct<item_start: bigint, doc_start: bigint, length: bigint>>"
        return map_batches(docs.select(key, text_or_empty().alias("t")), schema, start)

    return reduce(DataFrame.unionByName, map(held_against, _blocks(benchmark.select("item_id", "text"), block_words)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item leaked into it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")
