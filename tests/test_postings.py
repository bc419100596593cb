"""Votes of shared landmarks against plain counting, and that pairs aren't shuffled."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from setloom import catalog
from setloom.operators import postings


def landmarks(copies=4):
    rng, rows = random.Random(8), []
    for item in range(12):
        own = [(rng.choice("abcd"), rng.randint(0, 60)) for _ in range(rng.randint(1, 9))]
        rows += [(f"i{item}-{k}", h, f) for k in range(1 + copies * (item % 3 == 0)) for h, f in own]
    return rows


def counted(rows):
    """{(record, mix): votes by offset}"""
    out = {}
    for r, h, f in rows:
        for m, g, e in rows:
            if r != m and h == g:
                out.setdefault((r, m), Counter())[e - f] += 1
    return out


def best(votes):
    return max(votes.items(), key=lambda x: (x[1], -x[0]))


def test_votes_of_copies_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 1)
    rows = landmarks()
    h = spark.createDataFrame(rows + [(None, "a", 1), ("z", "a", None)], "item string, h string, frame int")
    want = counted(rows)
    got = [tuple(r) for r in postings.offset_votes(h, h).collect()]
    assert sorted(got) == sorted((*p, o, n) for p, v in want.items() for o, n in v.items())
    assert sorted(map(tuple, postings.offset_peaks(h, h).collect())) == sorted((*p, *best(v)) for p, v in want.items())


def test_curve_and_rates(spark):
    rows = landmarks(1)
    want = Counter()
    peak = {p: best(v)[0] for p, v in counted(rows).items()}
    for r, h, f in rows:
        for m, g, e in rows:
            if r != m and h == g and abs(e - f - peak[r, m]) <= 2:
                for size, hop in ((16, 4), (7, 3)):
                    for k in range((e - size) // hop + 1, e // hop + 1):
                        want[r, m, size, k * hop, e - f] += 1
    top = {}
    for (*key, _), n in want.items():
        top[tuple(key)] = max(n, top.get(tuple(key), 0))
    h = spark.createDataFrame(rows, "item string, h string, frame int")
    assert {tuple(r)[:4]: r.votes for r in postings.anchored_curve(h, h, ((16, 4), (7, 3)), 2).collect()} == top
    rated = [(*r, n) for n in (2, 0, 1) for r in rows if (len(r[0]) + r[2] * n) % 3 or not n and r[2] % 2]
    found = {}
    for n in range(3):
        for r, h_, f, k in rated:
            for m, g, e in rows:
                if k == n and r != m and h_ == g:
                    found.setdefault((r, m), {}).setdefault(n, Counter())[e - f] += 1
    wanted = []
    for pair, by in found.items():
        tops = {n: best(v) for n, v in by.items()}
        first = tops.get(0, (0, 0))[1]
        n = 0 if first >= 4 else max(tops, key=lambda n: (tops[n][1], -n))
        wanted.append((*pair, n, *tops[n]))
    a = spark.createDataFrame(rated, "item string, h string, frame int, nth int")
    assert sorted(map(tuple, postings.rate_peaks(a, h, 4).collect())) == sorted(wanted)
    assert sorted(map(tuple, postings.rate_peaks(a, h, 4, 2, 4).collect())) == sorted(w for w in wanted if 2 <= w[-1] < 4)


@pytest.mark.parametrize("wide", [1, 10**9])
def test_meetings_in_small_parts(monkeypatch, wide):
    monkeypatch.setattr(postings, "MEETINGS", 5)
    monkeypatch.setattr(postings, "ROWS", 3)
    rows = [(i, h, f * wide * 10**6 if wide > 1 else f) for i, h, f in landmarks()]
    own = {}
    for i, h, f in rows:
        own.setdefault(i, []).append((h, f))
    classes = {}
    for i, p in own.items():
        classes.setdefault(tuple(sorted(p)), []).append(i)
    kind = pa.list_(pa.struct([("h", pa.string()), ("frame", pa.int64()), ("nth", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(list(classes.values())), pa.array([[{"h": h, "frame": f, "nth": 0} for h, f in p] for p in classes], kind)], names=["items", "posts"])
    schema = pa.schema([("record", pa.string()), ("mix", pa.string()), ("offset", pa.int64()), ("votes", pa.int64())])
    side = postings._Side([batch.slice(0, 3), batch.slice(3)])
    got = [r for b in postings._meet(side, side, postings._all, {}, schema) for r in zip(*b.to_pydict().values())]
    assert sorted(got) == sorted((*p, o, n) for p, v in counted(rows).items() for o, n in v.items())


@pytest.mark.parametrize("name", ["j11_postings_join", "a10_vote_peak", "e02_anchored_curve", "l32_same_recording", "j13_span_restricted"])
def test_pairs_are_not_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(record\S*, mix|SortMergeJoin", plan)
