"""Splits of whole entities and ranking metrics without leaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entity_split(spark: SparkSession, sets: DataFrame, entity: str, stratum: str, share: float, least: int, most: int) -> DataFrame:
    """(entity, split): whole entities go to validation until ``share`` of each stratum's sets is reached.

    Entities of ``least`` to ``most`` sets qualify, in a fixed hash order; a running sum decides, so the fill
    is a window rather than a loop on the driver.
    """
    counted = sets.groupBy(stratum, entity).agg(F.count("*").alias("n"))
    home = counted.withColumn("k", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), stratum))).where("k = 1").drop("k")
    sizes = counted.groupBy(entity).agg(F.sum("n").alias("all"))
    fit = home.join(sizes, entity)
    room = fit.groupBy(stratum).agg((F.sum("all") * share).alias("room"))
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(entity).cast("string")), entity).rowsBetween(Window.unboundedPreceding, 0)
    able = fit.where(F.col("all").between(least, most)).withColumn("upto", F.sum("all").over(w)).join(room, stratum)
    chosen = able.where("upto <= room").select(entity)
    return fit.select(entity).join(chosen.withColumn("split", F.lit("validation")), entity, "left").select(entity, F.coalesce("split", F.lit("train")).alias("split"))


def rank_metrics(scores: DataFrame, group: str, score: str, truth: str, k: int = 10) -> DataFrame:
    """AUC (ties count half), hit@k, MRR and median rank over groups of scored candidates."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    peers = Window.partitionBy(group, score)
    ranked = scores.withColumn("better", F.rank().over(w) - 1).withColumn("ties", F.sum((~F.col(truth)).cast("int")).over(peers)).withColumn("negatives", F.sum((~F.col(truth)).cast("int")).over(Window.partitionBy(group)))
    true = ranked.where(truth).where("negatives > 0")
    worse = F.col("negatives") - F.least(F.col("better"), F.col("negatives")) - F.col("ties")
    return true.agg(
        F.round(F.avg((F.greatest(worse, F.lit(0)) + F.col("ties") / 2) / F.col("negatives")), 6).alias("auc"),
        F.round(F.avg((F.col("better") < k).cast("double")), 6).alias("hit_at_k"),
        F.round(F.avg(1 / (1 + F.col("better"))), 6).alias("mrr"),
        F.expr("percentile(1 + better, 0.5)").alias("median_rank"),
    )


def vector_rank_metrics(vectors: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """AUC (ties count half), hit@k, MRR and median rank of cosine as a ranker over ``vectors`` (id, label, vector).

    Every vector is a query against all others: each one of its label is ranked among those of other labels.
    Queries go in about ``rows / block`` blocks, dealt by hash of the id, and a block meets all vectors in one task, which
    holds them and one query's scores; a task's answer is one row per rank. All pairs are scored, so work
    grows with the square of the rows and what is shuffled with rows times blocks. Rows without a label are in no pair.
    """
    vectors = vectors.toDF("id", "label", "vector").where("label IS NOT NULL AND vector IS NOT NULL")
    blocks = max(1, -(-vectors.count() // block))
    query = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = vectors.withColumn("own", query).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ranked(t: pa.Table) -> pa.Table:
        ids, labels, own = t["id"].to_numpy(), t["label"].to_numpy(), t["own"].to_numpy() == t["block"].to_numpy()
        x = pc.list_flatten(t["vector"]).to_numpy().astype(np.float64).reshape(len(ids), -1)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        counts, areas = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1)
        for q in np.flatnonzero(own):
            score, like = np.round(x @ x[q], 9), labels == labels[q]
            others, true = np.sort(score[~like]), score[like & (ids != ids[q])]
            if len(others) and len(true):
                worse, upto = np.searchsorted(others, true), np.searchsorted(others, true, side="right")
                rank = 1 + len(others) - upto
                counts += np.bincount(rank, minlength=len(counts))
                areas += np.bincount(rank, (worse + upto) / (2 * len(others)), len(counts))
        found = np.flatnonzero(counts)
        return pa.table({"rank": found, "n": counts[found], "area": areas[found]})

    by_rank = dealt.groupBy("block").applyInArrow(ranked, "rank long, n long, area double")
    n = F.sum("n")
    return by_rank.agg(
        F.round(F.sum("area") / n, 6).alias("auc"),
        F.round(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / n, 6).alias("hit_at_k"),
        F.round(F.sum(F.col("n") / F.col("rank")) / n, 6).alias("mrr"),
        F.expr("percentile(rank, 0.5, n)").alias("median_rank"),
    )
