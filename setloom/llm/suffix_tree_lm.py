"""Language-model scores from a probabilistic suffix tree over bytes.

Symbols are the bytes of the text with A-Z in lower case, then an end symbol. A context is up to ``depth`` bytes
before a symbol. Every context of the training texts is a candidate state, however rare, and it is retained if
its next-symbol distribution diverges from that of its longest proper suffix:
``N(s) * KL(P(.|s) || P(.|suffix(s)))`` must reach ``gain`` nats. Suffixes of retained contexts are retained
too, and so are all contexts of one byte. Next-symbol distributions are smoothed towards the suffix's

    P(a|s) = (c(s, a) + g(s) * P(a|suffix(s))) / (N(s) + g(s))

where g(s) is the number of symbols seen after s; the root is smoothed with 0.5 for each of 256 symbols. A text
is scored by the longest suffix state at each byte.

The tree grows with the corpus and stays distributed. Documents are packed into batches; a batch sends its
different windows (``depth`` bytes and a symbol in one number) with their training counts, once each, dealt by
the two bytes before the symbol, so that all longer contexts of a suffix meet in one bucket. Buckets sum the
counts, build their part of the tree, and answer every window of every batch with its log probability, in
16 bits. Only
the counts after contexts of at most one byte, 65,536 at most, are needed everywhere. A bucket's windows are
merged as they come, and batches beyond ``SALTED`` are dealt to several tasks for a bucket, each with its part of the tree.

The unigram base needs the exact count of every word. Words with at least ``least_word`` of all tokens (at most
``1 / least_word``) are looked up in the task; all others go through one join by word.

Null and empty texts have the end symbol and end token only. A null document id counts as held out.
Repeated rows are scored each on its own, and all of them train. Other columns are ignored. Without training
documents the tree is its root, uniform over symbols. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.batches import by_first, opened, pack, packed_batches, parts, record_batch, single_rows, unpack
from setloom.llm.common import discard, give_back, materialize, parallelism, table, text_or_empty

#: Bytes that UTF-8 never uses: what stands before a text, and its end.
START, END = 0xFE, 0xFF
#: The end as a word; it holds white space, so no word of a text equals it.
END_TOKEN = b" "
#: Bytes of texts in a batch (or one text), symbols that are looked at once, buckets, batches that one task answers for a bucket.
BATCH, CHUNK, BUCKETS, SALTED = 10_000_000, 250_000, 1024, 4096
#: Windows of a batch that are sorted at once, at least; they bound memory.
SORTED = 1_000_000
#: Steps to a unit of the root of -log10 P, as which a log probability is sent: 16 bits reach 10**-16, and a symbol of
#: log probability -x is off by 0.00006 times the root of x at most.
STEPS = 16_384
_U = np.uint64


def held_out(doc_id: int | None) -> bool:
    """Whether the document is kept from training: crc32 of its id as text leaves 0 modulo 10."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def symbol_windows(raw: bytes, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(the last ``depth + 1`` symbols up to every symbol as one number each, each one's text), by chunks."""
    padded = np.full(len(raw) + len(sizes) * (depth + 1) + 8, START, np.uint8)
    ends = np.cumsum(sizes + depth + 1)
    at = 0
    low = np.frombuffer(raw.lower(), np.uint8)
    for size, end in zip(sizes.tolist(), ends.tolist()):
        padded[end - 1 - size : end - 1] = low[at : at + size]
        at += size
    del low
    padded[ends - 1] = END
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))  # every eight bytes from each byte on
    total = len(padded) - 8 - depth
    for c in range(0, total, CHUNK):
        stop = min(c + CHUNK, total)
        real = padded[c + depth : stop + depth] != START
        inside = np.arange(*np.searchsorted(ends, (c + depth, stop + depth - 1), side="right") + (0, 1))  # texts of the chunk
        symbols = np.minimum(ends[inside], stop + depth) - np.maximum(ends[inside] - sizes[inside] - 1, c + depth)
        yield eight[c:stop].astype(_U)[real] >> _U(8 * (7 - depth)), np.repeat(inside, np.maximum(symbols, 0))


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")  # what is sorted already is merged, many times faster
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))[: len(codes)])
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


def distinct_windows(raw: bytes, sizes: np.ndarray, training: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a batch, sorted, and how often each stands in training texts."""
    codes, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    waiting: dict[int, list[np.ndarray]] = {1: [], 0: []}
    held = 0

    def sort() -> None:
        nonlocal codes, counts
        for weight, some in waiting.items():
            if some:
                one = np.concatenate(some)
                some.clear()
                one.sort()
                first = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))[: len(one)])
                n = np.diff(first, append=len(one)) * weight
                one = one[first]
                at = np.searchsorted(codes, one)
                new = np.ones(len(one), bool)
                within = at < len(codes)
                new[within] = codes[at[within]] != one[within]
                counts[at[~new]] += n[~new]
                codes, counts = np.insert(codes, at[new], one[new]), np.insert(counts, at[new], n[new])

    every = bool(training.all())
    for code, text in symbol_windows(raw, sizes, depth):
        if every:
            waiting[1].append(code)
        else:
            learns = training[text]
            waiting[1].append(code[learns])
            waiting[0].append(code[~learns])
        held += len(code)
        if held > SORTED:
            sort()
            held = 0
    sort()
    return codes, counts


def text_scores(raw: bytes, sizes: np.ndarray, depth: int, codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Sum over each text of its windows' log probabilities, given in steps by sorted code.

    ``codes`` has every window of the texts, so a hashed slot whose codes all have the same steps tells them without
    a comparison; codes of other slots are sought."""
    bits = min(max(10, len(codes).bit_length() + 3), 24)
    slot_of = lambda x: ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)
    told = np.zeros(1 << bits, np.uint16)
    some = [slice(at, at + CHUNK) for at in range(0, len(codes), CHUNK)]
    for x in some:
        told[slot_of(codes[x])] = steps[x]
    for x in some:  # a slot has the steps of its last code, or is marked; every code of other steps marks it
        slot = slot_of(codes[x])
        told[slot[told[slot] != steps[x]]] = 65_535  # a code of as many steps is sought as well
    worth = -((np.arange(65_536) / STEPS) ** 2)
    score = np.zeros(len(sizes))
    for code, text in symbol_windows(raw, sizes, depth):
        found = told[slot_of(code)]
        unsure = np.flatnonzero(found == 65_535)
        some = code[unsure]
        order = np.argsort(some)  # sought in order, which is many times faster
        found[unsure[order]] = steps[np.searchsorted(codes, some[order])]
        score += np.bincount(text, worth[found], len(sizes))
    return score


def text_words(low: bytes, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts in lower case, the end as the last one; the number of every word in turn, each
    text's end behind its words; and the words of each text, its end included."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
    lists = pc.ascii_split_whitespace(texts)
    cuts = lists.offsets.to_numpy()
    words = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).cast(pa.large_binary()).dictionary_encode()
    number, distinct = words.indices.to_numpy(), words.dictionary
    full = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)  # white space at either end leaves an empty word
    real = full[number] if len(number) else np.zeros(0, bool)
    before = np.concatenate(([0], np.cumsum(real)))[cuts - cuts[0]]
    number = np.insert((np.cumsum(full) - 1).astype(np.int32)[number[real]], before[1:], int(full.sum()))
    return pa.concat_arrays([distinct.filter(pa.array(full)), pa.array([END_TOKEN], pa.large_binary())]), number, np.diff(before) + 1


def bucket_of(codes: np.ndarray) -> np.ndarray:
    """The bucket of windows: by the two bytes before the symbol, which all longer contexts share."""
    return ((((codes >> _U(8)) & _U(0xFFFF)) * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) % BUCKETS


class Shallow:
    """Counts after contexts of at most one byte: ``log P`` of all (byte, symbol) and the counts themselves."""

    def __init__(self, pairs: dict[int, int]):
        """``pairs``: training count by (byte before, symbol) as one number."""
        self.c = np.zeros((256, 256))
        for key, n in pairs.items():
            self.c[key >> 8, key & 255] = n
        self.n = self.c.sum(axis=1)
        root = (self.c.sum(axis=0) + 0.5) / (self.n.sum() + 128)
        seen = (self.c > 0).sum(axis=1)
        weight = np.maximum(1, seen)[:, None]  # a byte never seen says what the root says
        self.p = (self.c + weight * root) / (self.n[:, None] + weight)


def bucket_tree(codes: np.ndarray, counts: np.ndarray, depth: int, shallow: Shallow, gain: float) -> np.ndarray:
    """log10 P of the symbol of every window (sorted, distinct), all windows of some two-byte contexts."""
    levels, retained = {}, {}
    for d in range(2, depth + 1):
        key = codes & _U((1 << 8 * (d + 1)) - 1) if d < 7 else codes
        entry, of = np.unique(key, return_inverse=True)
        c = np.bincount(of, counts, len(entry))
        context, owner = np.unique(entry >> _U(8), return_inverse=True)
        levels[d] = (entry, of, c, context, owner, np.bincount(owner, c, len(context)))
    for d in range(2, depth + 1):
        entry, _, c, context, owner, n = levels[d]
        if d == 2:
            pair = ((entry & _U(0xFFFF)) >> _U(8)).astype(np.int64), (entry & _U(0xFF)).astype(np.int64)
            below, total = shallow.c[pair], shallow.n[pair[0]]
        else:
            up = levels[d - 1]
            at = np.searchsorted(up[0], entry & _U((1 << 8 * d) - 1))
            below, total = up[2][at], up[5][up[4][at]]
        seen = c > 0
        term = c[seen] * np.log(c[seen] / n[owner[seen]] * total[seen] / below[seen])
        retained[d] = np.bincount(owner[seen], term, len(context)) >= gain
    for d in range(depth, 2, -1):  # suffixes of retained contexts stay
        up = levels[d - 1][3]
        retained[d - 1][np.searchsorted(up, levels[d][3][retained[d]] & _U((1 << 8 * (d - 1)) - 1))] = True
    p = shallow.p[((codes & _U(0xFFFF)) >> _U(8)).astype(np.int64), (codes & _U(0xFF)).astype(np.int64)]
    for d in range(2, depth + 1):
        entry, of, c, context, owner, n = levels[d]
        state = retained[d][owner][of]
        weight = np.bincount(owner, c > 0, len(context))
        c, n, g = c[of][state], n[owner][of][state], weight[owner][of][state]
        p[state] = (c + g * p[state]) / (n + g)
    return np.log10(p)


def _ask(packed: DataFrame, depth: int) -> DataFrame:
    """Per batch: its windows by bucket, and its counts of words in training texts; as a table."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("packed", pa.binary()), ("word", pa.binary()), ("pair", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(65_536, np.int64)
        for number, ids, sizes, texts in single_rows(batches):
            sizes, raw = opened(sizes, texts)
            training = np.array([not held_out(i) for i in ids], bool)
            words, of, each = text_words(raw.lower(), sizes)
            give_back()
            n = np.bincount(of, np.repeat(training, each), len(words)).astype(np.int64)
            words, n = words.filter(pa.array(n > 0)).cast(pa.binary()), pa.array(n[n > 0])
            for at in range(0, len(n), 100_000):
                some = {"word": words.slice(at, 100_000), "n": n.slice(at, 100_000)}
                rows = len(some["n"])
                yield pa.RecordBatch.from_arrays([some.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)
            del words, of, each, n
            give_back()
            codes, counts = distinct_windows(raw, sizes, training, depth)
            pairs += np.bincount((codes & _U(0xFFFF)).astype(np.int64), counts, 65_536).astype(np.int64)
            bucket = bucket_of(codes)
            order = np.argsort(bucket.astype(np.uint16), kind="stable")
            codes, counts = codes[order], counts[order]
            yield record_batch([(b, number, pack(codes[x], counts[x].astype(np.uint32)), None, None, None) for b, x in parts(bucket[order])], schema)
            del raw, codes, counts, bucket, order  # or they stay while the next batch is read
            give_back()
        yield record_batch([(None, None, None, None, int(k), int(pairs[k])) for k in np.flatnonzero(pairs)], schema)
        give_back()

    return materialize(packed.select("batch", "ids", "sizes", "texts").mapInArrow(run, "bucket int, batch bigint, packed binary, word binary, pair int, n bigint"))


def _summed(rows: DataFrame, by: list[str], tasks: int, kind: type, finish=None) -> DataFrame:
    """Windows and counts (of the given kind of number) of rows (bucket, packed) summed by ``by``; ``finish`` may
    make of them what is packed."""
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, counts, held = None, [], [], 0

        def out():
            one, n = merged(codes, counts)
            return record_batch([(now[0], pack(one, finish(one, n) if finish else n))], schema)

        for *key, packed in single_rows(batches):
            if now is not None and key != now:
                yield out()
                codes, counts, held = [], [], 0
            now = key
            one, n = unpack(packed, _U, kind)
            codes.append(one)
            counts.append(n.astype(np.int64))
            held += len(one)
            if len(codes) > 1 and held > 2 * len(codes[0]) + 1_000_000:  # what came since outweighs what is merged
                one, n = merged(codes, counts)
                codes, counts, held = [one], [n], len(one)
        if now is not None:
            yield out()
        give_back()

    dealt = rows.select(*by, "packed").repartition(tasks, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "bucket int, packed binary")


def learned(asks: DataFrame, shallow, salts: int, tasks: int, depth: int, gain: float) -> DataFrame:
    """The tree as a table (bucket, packed): the windows of each bucket and their log10 P."""

    def finish(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        log = np.minimum(0, bucket_tree(codes, counts, depth, shallow.value, gain))
        return np.minimum(np.rint(np.sqrt(-log) * STEPS), 65_535).astype(np.uint16)

    if salts == 1:
        return materialize(_summed(asks, ["bucket"], tasks, np.uint32, finish))
    salted = asks.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    return materialize(_summed(_summed(salted, ["bucket", "salt"], tasks, np.uint32), ["bucket"], tasks, np.int64, finish))


def _answered(asks: DataFrame, tree: DataFrame, salts: int, tasks: int) -> DataFrame:
    """Every batch's windows by bucket with their log10 P (batch, bucket, packed)."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = score = None
        out: list[tuple] = []
        for bucket, _, batch, packed in single_rows(batches):
            if batch is None:
                known, score = unpack(packed, _U, np.uint16)
            else:
                codes, _ = unpack(packed, _U, np.uint32)
                out.append((batch, bucket, pack(score[np.searchsorted(known, codes)])))
            if len(out) >= 256:
                yield record_batch(out, schema)
                out = []
        yield record_batch(out, schema)
        give_back()

    salt = F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int").alias("salt")
    every = tree.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("bigint").alias("batch"), "packed")
    dealt = asks.select("bucket", salt, "batch", "packed").unionByName(every).repartition(tasks, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("batch").asc_nulls_first())
    return dealt.mapInArrow(run, "batch bigint, bucket int, packed binary")


def score_documents(docs: DataFrame, depth: int = 6, gain: float = 10.0, least_word: float = 1e-6) -> DataFrame:
    """One row per document of ``docs`` (``doc_id``, ``text``): base and tree scores. See the module."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    spark = docs.sparkSession
    tasks = parallelism(spark)
    packed = packed_batches(docs.select("doc_id", text_or_empty().alias("t")), BATCH)
    found = _ask(packed, depth)
    asks = found.where("bucket IS NOT NULL").select("bucket", "batch", "packed")
    words = materialize(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")))
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    common = words.where(F.col("c") >= least_word * total).toArrow()
    pairs = found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    shallow = spark.sparkContext.broadcast(Shallow({r.pair: r.n for r in pairs}))
    salts = max(1, -(-packed.count() // SALTED))
    tree = learned(asks, shallow, salts, tasks, depth, gain)
    answered = materialize(_answered(asks, tree, salts, tasks))
    discard(found)
    discard(tree)
    answers = answered.groupBy("batch").agg(F.collect_list(F.struct("bucket", "packed")).alias("told"))
    scale = total + 0.1 * (distinct + 1)
    frequent = spark.sparkContext.broadcast((common.column("word").combine_chunks().cast(pa.large_binary()), [math.log10((c + 0.1) / scale) for c in common.column("c").to_pylist()]))
    kind = "doc_id bigint, held_out boolean, n_tokens bigint, near bigint, near_score double, rare array<binary>, score double"
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("near", pa.int64()), ("near_score", pa.float64()), ("rare", pa.list_(pa.binary())), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.array([*frequent.value[1], 0.0])  # all but the last, for words that aren't here, are below zero
        for ids, sizes, texts, told in single_rows(batches):
            lengths, raw = opened(sizes, texts)
            codes, _ = distinct_windows(raw, lengths, np.ones(len(ids), bool), depth)
            order = np.argsort(bucket_of(codes).astype(np.uint16), kind="stable")
            steps = np.zeros(len(codes), np.uint16)
            steps[order] = np.concatenate([unpack(x["packed"], np.uint16)[0] for x in sorted(told, key=lambda x: x["bucket"])])
            score = text_scores(raw, lengths, depth, codes, steps)
            del codes, order, steps, told
            give_back()
            words, number, each = text_words(raw.lower(), lengths)
            give_back()
            value = logs[pc.fill_null(pc.index_in(words, frequent.value[0]), -1).to_numpy()[number]]
            last = np.cumsum(each)
            rare = number[value == 0]
            upto = np.cumsum(value == 0)[last - 1]
            sums = [math.fsum(value[a:b].tolist()) for a, b in zip((last - each).tolist(), last.tolist())]
            for at in range(0, len(ids), 1024):
                x = slice(at, at + 1024)
                cuts = np.concatenate(([upto[at - 1] if at else 0], upto[x]))
                lists = pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), words.take(pa.array(rare[cuts[0] : cuts[-1]])).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()), pa.array([held_out(i) for i in ids[x]], pa.bool_()), pa.array(each[x]), pa.array(each[x] - np.diff(cuts)), pa.array(sums[x], pa.float64()), lists, pa.array(score[x])], schema=schema)
            del raw, score, words, number, each, value, last, rare, upto, sums, lists
            give_back()

    rows = packed.join(answers, "batch").select("ids", "sizes", "texts", "told").mapInArrow(scored, kind)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    discard(answered)
    discard(packed)
    rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(scale))
    rare = rare.groupBy("row").agg(F.count("c").alias("far"), F.sum(log).alias("far_score"))
    both = rows.drop("rare").join(rare, "row", "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("near") + F.coalesce("far", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("near_score") + F.coalesce("far_score", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and tree scores of every document."""
    return score_documents(table(spark, sf_dir, "documents"))
