import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.operators import joins, sequences, splits
from setloom.sources.stage_table import StageTable, read_csv, write_csv


def test_longest_rising():
    assert sequences.longest_rising([10, 50, 20, 30, 5, 40]) == [10, 20, 30, 40]
    assert sequences.longest_rising([]) == []
    assert sequences.order_chance([1, 2, 3, 4, 5, 6, 7, 8], 500, 1) < 0.01


def test_shuffles_equal_one_by_one():
    rng = random.Random(5)
    for n in (0, 1, 2, 5, 8, 70):
        values = [float(rng.randint(0, n)) for _ in range(n)]
        own, pool, lengths = random.Random(3), list(values), []
        for _ in range(100):
            own.shuffle(pool)
            lengths.append(len(sequences.longest_rising(pool)))
        assert sequences.median_shuffled(values, 100, 3) == sorted(lengths)[50]
        assert sequences.order_chance(values, 100, 3) == sum(x >= len(sequences.longest_rising(values)) for x in lengths) / 100


def test_registered_proof_summary_runs_2000_shuffles(spark):
    from setloom.plans.composed import proof

    got = proof(spark, "/root/testdata/sf0.001").collect()
    assert any(round(r.chance * 2000) % 40 for r in got)  # finer than 50 shuffles
    assert all(abs(r.chance * 2000 - round(r.chance * 2000)) < 1e-6 and 1 <= r.median_shuffled <= r.n for r in got)


def test_capped_sessions(spark):
    rows = spark.createDataFrame([(1, float(t)) for t in [*range(0, 70, 10), 200]], "k int, t double")
    got = sequences.capped_sessions(rows, ["k"], "t", 10.1, 30).orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in got] == [(0, 20, 3), (30, 50, 3), (60, 60, 1), (200, 200, 1)]


def test_as_of_takes_last_and_falls_back_to_first(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b")], "k int, t double, v string")
    got = {(r.k, r.t): r.v for r in joins.as_of_join(left, right, ["k"], "t", "v").collect()}
    assert got == {(1, 5.0): "b", (1, 0.0): "a", (2, 1.0): None}


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, k % 2, rng.uniform(90, 180)) for k in range(120)]
    a = spark.createDataFrame(rows, "id int, g int, x double")
    b = a.select(F.col("id").alias("other"), "g", F.col("x").alias("y"))
    from math import log

    want = {(p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and abs(log(p[2] / q[2])) <= 0.05}
    got = [(r.id, r.other) for r in joins.band_join(a, b, ["g"], "x", "y", 0.05).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "CartesianProduct" not in joins.band_join(a, b, ["g"], "x", "y", 0.05)._jdf.queryExecution().toString()


def test_offset_votes_find_the_shift(spark):
    peaks = [("r", f, f * 7 % 11) for f in range(0, 60, 3)]
    shifted = [("m", f + 100, b) for _, f, b in peaks]
    h = joins.peak_pairs(spark.createDataFrame(peaks + shifted, "item string, frame int, bin int"))
    best = joins.best_offset(joins.offset_votes(h.where("item = 'r'"), h.where("item = 'm'"))).first()
    assert best.offset == 100 and best.votes > 20


def test_split_keeps_entities_whole(spark):
    rows = [(f"d{d}", f"g{d % 2}", s) for d in range(40) for s in range(5)]
    got = splits.entity_split(spark, spark.createDataFrame(rows, "dj string, genre string, set_id int"), "dj", "genre", 0.2, 3, 40).collect()
    assert len(got) == 40 and 4 <= sum(r.split == "validation" for r in got) <= 8


def test_rank_metrics_take_all_vectors_and_components(spark):
    from statistics import mean, median

    from setloom.plans.composed import metrics

    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    unit = {i: [v / sum(x * x for x in e) ** 0.5 for v in e] for i, _, e in rows}
    cosine = lambda i, j: round(sum(x * y for x, y in zip(unit[i], unit[j])), 9)
    rows, auc, ranks = rows[:60], [], []
    for i, label, _ in rows:
        other = [cosine(i, j) for j, x, _ in rows if x != label]
        for s in [cosine(i, j) for j, x, _ in rows if x == label and j != i]:
            ranks.append(1 + sum(o > s for o in other))
            auc.append(mean((s > o) + (s == o) / 2 for o in other))
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    for block in (7, 1024):
        got = splits.vector_rank_metrics(table, block=block).first()
        assert abs(got.auc - mean(auc)) < 2e-6 and got.median_rank == median(ranks)
        assert abs(got.hit_at_k - mean(r <= 10 for r in ranks)) < 2e-6 and abs(got.mrr - mean(1 / r for r in ranks)) < 2e-6
    whole = splits.vector_rank_metrics(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding")).first()
    assert metrics(spark, "/root/testdata/sf0.001").first() == whole


def test_stage_table(spark, tmp_path):
    t = StageTable(spark, str(tmp_path / "t"), T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())]), ("k",))
    assert t.rows().count() == 0
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.append(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted((r.k, r.v) for r in t.rows().collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert t.without(spark.createDataFrame([(1,)], "k int")).count() == 2
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1, 2)], "k int, z int"))


def test_csv_round_trip(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, None, ["a", "b"])], "k int, v string, w array<string>"), str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("w", T.StringType())]))
    assert [tuple(r) for r in back.collect()] == [(1, None, "a b")]


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    from setloom.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "ROWS", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    rows = spark.createDataFrame([(k, int(k % 3), x[k].tolist()) for k in range(40)], "id bigint, label int, vector array<double>")
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    cosine = u @ u.T
    got = sorted((r.id, r.other) for r in vectors.nearest(rows.where("id % 4 = 0"), rows, 3, other_label=True).collect())
    want = []
    for q in range(0, 40, 4):
        fit = sorted((round(-cosine[q, o], 6), o) for o in range(40) if o % 3 != q % 3)
        want += [(q, o) for _, o in fit[:3]]
    assert got == sorted(want)
    every = cosine[~np.eye(40, dtype=bool)]
    stats = vectors.similarity_stats(rows).first()
    assert np.allclose([stats["mean"], stats["sd"], stats["lo"], stats["hi"]], [every.mean(), every.std(), every.min(), every.max()])


def test_canonical_ids_follow_the_last_match_before(spark):
    rows = [("m", 1, 425.31, [43, 44, 45]), ("m", 2, 425.27, [43, 44, 45]), ("m", 3, 300.0, [30, 31]), ("m", 5, 426.2, [43, 44, 45, 46]), ("n", 2, 425.3, [43])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "mix string, id bigint, t0 double, cells array<int>, same string")
    got = {(r.mix, r.id): r.canonical for r in sequences.canonical_ids(table, "mix", "id", "t0", "cells", 1.0, 0.8, ["same"]).collect()}
    assert got == {("m", 1): 1, ("m", 2): 1, ("m", 3): 3, ("m", 5): 1, ("n", 2): 2}


def test_rising_lengths_and_picks_by_array_functions(spark):
    rng = random.Random(4)
    groups = {g: [rng.randint(0, 9) for _ in range(rng.randint(1, 30))] for g in range(30)}
    rows = spark.createDataFrame([(g, k, float(v)) for g, vs in groups.items() for k, v in enumerate(vs)], "g int, k int, v double")
    got = {r.g: r.n for r in sequences.longest_rising_length(rows, "g", "k", "v", "n").collect()}
    assert got == {g: len(sequences.longest_rising(vs)) for g, vs in groups.items()}
    assert sequences.longest_rising([10, 50, 20, 30, 5, 40]) == [10, 20, 30, 40]
    taken = {}
    for r in sequences.greedy_picks(rows, "g", "k", "v", 3).collect():
        taken.setdefault(r.g, set()).add(r.k)
    for g, vs in groups.items():
        want = []
        for _, k in sorted((-v, k) for k, v in enumerate(vs)):
            if all(abs(k - t) >= 3 for t in want):
                want.append(k)
        assert taken[g] == set(want)


def test_band_join_deals_a_bucket_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BAND_CELL", 16)
    rng = random.Random(6)
    rows = [(k, 0, rng.uniform(100, 104)) for k in range(300)]
    a = spark.createDataFrame(rows, "id int, g int, x double")
    met = joins.band_join(a, a.select(F.col("id").alias("other"), "g", F.col("x").alias("y")), ["g"], "x", "y", 0.05, "id <> other")
    got = met.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.other) for r in got) == [(p, q) for p in range(300) for q in range(300) if p != q]
    sizes = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert len(sizes) > 30 and max(sizes) < len(got) / 10


@pytest.mark.parametrize("first", [1, 3, 64])
def test_best_in_band_equals_ranking_the_whole_band(spark, first):
    rng = random.Random(7)
    rows = [(k % 190, k % 2, rng.choice("abc"), rng.uniform(90, 180), rng.randint(0, 5)) for k in range(200)]
    a = spark.createDataFrame(rows, "id int, g int, n string, x double, w int").drop("w")
    b = spark.createDataFrame(rows, "other int, g int, n2 string, y double, w int")
    got = joins.best_in_band(a, b, ["g"], "x", "y", 0.05, "id", [("w", True), ("other", False)], "n <> n2", 4, first)
    from math import log

    want = []
    for i in range(190):
        fit = sorted((-q[4], q[0]) for p in rows if p[0] == i for q in rows if p[1] == q[1] and p[2] != q[2] and abs(log(p[3] / q[3])) <= 0.05)
        want += [(i, -w, o) for w, o in fit[:4]]
    assert sorted((r.id, r.w, r.other) for r in got.collect()) == sorted(want)


def test_negatives_rank_few_pairs(spark):
    """Keys with thousands of candidates, with fewer than their limit lets pass, with fewer than wanted and with none."""
    sizes = {1: 3000, 2: 700, 3: 100, 4: 5, 5: 0, 6: 40}
    every = spark.createDataFrame([(k, o) for k, n in sizes.items() for o in range(n)], "key long, other long")
    bounds = spark.createDataFrame([(k, 100_000 if k == 6 else 2 * n + 1) for k, n in sizes.items()], "key long, most long")
    made = []

    def pairs_of(limits, where):
        pairs = every.withColumn("__end", F.col("other").cast("string")).join(limits, "key")
        made.append(pairs.where(where) if where else pairs)
        return made[-1]

    got = sequences.negatives_of(pairs_of, bounds, "key", "other", 9, lambda df: df.localCheckpoint())
    want = sequences.negatives(every, "key", "other", 9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 9 <= made[0].where("key = 1").count() < 300 and {r.key for r in made[1].select("key").distinct().collect()} == {4, 6}


def test_distinct_orders_are_shuffled_once(spark, tmp_path):
    """Sixty thousand groups of a few orders, as one group at a time gives them."""
    rng = random.Random(9)
    orders = [[float(rng.randint(0, 9)) for _ in range(n)] for n in (1, 2, 3, 5, 8, 13, 70)] + [[4.0, 1.0, 9.0], [2.0, 1.0, 3.0]]
    want = [(len(v), len(sequences.longest_rising(v)), sequences.median_shuffled(v, 200, 3), sequences.order_chance(v, 200, 3)) for v in orders]
    ranks = [tuple(sorted(set(v)).index(x) + 1 for x in v) for v in orders]
    assert [(len(v), *f) for v, f in zip(orders, sequences.order_summaries(ranks, 200, 3))] == want
    rows = spark.createDataFrame([(g, k, x) for g, v in enumerate(orders) for k, x in reversed(list(enumerate(v)))], "g long, k int, v double")
    many = rows.crossJoin(spark.range(60_000 // len(orders)).withColumnRenamed("id", "c")).withColumn("id", F.col("c") * len(orders) + F.col("g"))
    got = sequences.proof_summary(many, "id", "k", "v", 200, 3)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    for r in got.groupBy((F.col("id") % len(orders)).alias("g"), "n", "rising", "median_shuffled", "chance").count().collect():
        assert (r.n, r.rising, r.median_shuffled, r.chance) == want[r.g] and r["count"] == 60_000 // len(orders)
