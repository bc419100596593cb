"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Evidence of a document is the sum of log likelihood ratios of its words, marks and shape, as learned from a
bounded sample of labelled rows. The rate of a host is shrunk towards the global rate, the rate of a path
towards its host's, each by a strength that the method of moments gives: hosts with few documents, or that
differ no more than chance lets them, take the rate above them. A document's posterior adds what its path
(without the document itself) says above the global rate to its own evidence.

Only the model comes from a sample (``sample`` labelled rows, by hash of the id). Rates are grouped sums over
all documents, summed before they are shuffled. Scores are kept as thin rows; rates are broadcast if their
counted rows are few, else joined with the document side dealt over ``salts`` parts of each key, so a host with a
third of all documents is no hot key.

Null and empty texts have no evidence; null hosts and paths are groups of their own. Repeated rows are scored
alike and all stay, and of repeated labels of a document the worst counts; labels without an id or of unknown documents
teach nothing, a null label counts as good. Without labels of both kinds a target has no evidence and its rate is the
sample's (half without labels). Features equally telling are taken in the order of their bytes. Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import lower_words, map_batches, materialize, table, text_or_empty

TARGETS = ("bad", "toxic")
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
#: Most rows of rates that are broadcast.
BROADCAST_RATES = 200_000


def features(text: str) -> set[bytes]:
    """Words, runs of marks (after \\x01) and the text's shape (after \\x02)."""
    raw = text.encode()
    words = lower_words(text)
    found = set(words)
    distinct = len(found)
    marks = _MARKS.findall(raw)
    found.update(b"\x01" + m[:8] for m in marks)
    n = max(1, len(words))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shape = (f"n{min(12, int(math.log2(n)))}", f"d{int(10 * distinct / n)}" if n >= 50 else "d", f"m{min(10, int(5 * sum(map(len, marks)) / n))}", f"u{min(10, int(20 * upper / max(1, len(raw))))}")
    found.update(b"\x02" + x.encode() for x in shape)
    return found


class _FeatureCounts:
    """A task's counts of features over its sampled documents: all, bad, toxic."""

    def __init__(self, labels: dict[int, tuple[int, int]]):
        self.labels, self.n = labels, (Counter(), Counter(), Counter())

    def __call__(self, cols: dict[str, list]) -> None:
        for i, t in zip(cols["doc_id"], cols["t"]):
            if i in self.labels:
                f = features(t)
                for k, on in enumerate((1, *self.labels[i])):
                    if on:
                        self.n[k].update(f)

    def finish(self) -> dict[str, list] | None:
        keys = list(self.n[0])
        return {"f": keys, **{c: [self.n[k][f] for f in keys] for k, c in enumerate(("n", *TARGETS))}} if keys else None


def fit(docs: DataFrame, labels: DataFrame, sample: int = 50_000, most: int = 5_000) -> tuple[list[float], list[dict[bytes, float]]]:
    """Prior log odds and feature weights of each target.

    At most ``sample`` labelled rows teach, and at most ``most`` features per target are kept: those whose
    presence differs most between the classes (chi-square).
    """
    single = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = {r.doc_id: (int(r.quality == 0), int(r.toxic == 1)) for r in chosen.select("doc_id", "quality", "toxic").collect()}
    sizes = [sum(x[k] for x in known.values()) for k in range(2)]
    total = len(known)
    priors = [math.log((n + 0.5) / (total - n + 0.5)) for n in sizes]
    counts = map_batches(docs.select("doc_id", text_or_empty().alias("t")), "f binary, n bigint, bad bigint, toxic bigint", lambda: _FeatureCounts(known))
    counts = materialize(counts.groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS))).where("n >= 5"))
    weights = []
    for target, ones in zip(TARGETS, sizes):
        zeros = total - ones
        if not ones or not zeros:
            weights.append({})
            continue
        a, b = (F.col(target) + 0.5) / (ones + 1), (F.col("n") - F.col(target) + 0.5) / (zeros + 1)
        expected = F.col("n") * ones / total
        chi = (F.col(target) - expected) ** 2 / expected + (F.col(target) - expected) ** 2 / (F.col("n") * zeros / total)
        best = counts.select("f", F.log(a / b).alias("w"), chi.alias("chi")).where("chi >= 30").orderBy(F.desc("chi"), "f").limit(most)
        weights.append({bytes(r.f): r.w for r in best.collect()})
    return priors, weights


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, rate: Column | float) -> float:
    """Beta prior strength by the method of moments, from groups (n, s): how many documents' worth of
    evidence the rate above weighs."""
    p = F.col("s") / F.col("n")
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (p - rate) ** 2).alias("v"), F.sum(rate * (1 - rate)).alias("noise"), F.sum(F.col("n") * rate * (1 - rate)).alias("u")).first()
    if not r.n or r.k < 2:
        return 1e6
    between = (r.v - r.noise) / r.n
    return 1e6 if between <= 1e-12 else min(1e6, max(1.0, r.u / r.n / between - 1))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = 50_000, salts: int = 32) -> DataFrame:
    """Per document: doc_id, host, path, bad, toxic (posteriors), evidence of both, and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def start():
        priors, weights = shared.value

        def run(cols):
            out = {"doc_id": cols["doc_id"], "host": cols["host"], "path": cols["path"], "bad_e": [], "toxic_e": []}
            for t in cols["t"]:
                f = features(t) if t else ()
                for name, prior, w in zip(("bad_e", "toxic_e"), priors, weights):
                    out[name].append(max(-20.0, min(20.0, prior + math.fsum(w[x] for x in f if x in w))))
            return out

        return run

    thin = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), text_or_empty().alias("t"))
    scored = materialize(map_batches(thin, "doc_id bigint, host string, path string, bad_e double, toxic_e double", start))
    probability = {t: _sigmoid(F.col(f"{t}_e")) for t in TARGETS}
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(probability[t]).alias(t) for t in TARGETS)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(t).alias(f"h_{t}") for t in TARGETS))
    rates = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    whole = paths.agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    mean = {t: min(1 - 1e-6, max(1e-6, (whole[t] or 0.0) / max(1, whole.n or 0))) for t in TARGETS}
    final = {}
    for t in TARGETS:
        top = _strength(hosts.select(F.col("hn").alias("n"), F.col(f"h_{t}").alias("s")), F.lit(mean[t]))
        own = (F.col(f"h_{t}") + top * mean[t]) / (F.col("hn") + top)
        rates = rates.withColumn(f"r_{t}", own)
        low = _strength(rates.select("n", F.col(t).alias("s"), f"r_{t}"), F.col(f"r_{t}"))
        rest = (F.col(t) - probability[t] + low * F.col(f"r_{t}")) / (F.col("n") - 1 + low)
        rest = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rest))
        final[t] = _sigmoid(F.col(f"{t}_e") + F.log(rest / (1 - rest)) - math.log(mean[t] / (1 - mean[t])))
    rates = rates.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "n", *TARGETS, *(f"r_{t}" for t in TARGETS))
    if paths.count() <= BROADCAST_RATES:
        both = scored.join(F.broadcast(rates), scored.host.eqNullSafe(rates.rh) & scored.path.eqNullSafe(rates.rp))
    else:
        dealt = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        spread = rates.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = dealt.join(spread, dealt.host.eqNullSafe(spread.rh) & dealt.path.eqNullSafe(spread.rp) & (dealt.salt == spread.salt2))
    return both.select("doc_id", "host", "path", *(final[t].alias(f"p_{t}") for t in TARGETS), "bad_e", "toxic_e").withColumn("kept", (F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
