"""Removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id;
strings are judged on the input. Documents are never compared in pairs and no suffix array of all bytes is
kept. Instead:

1. Documents are packed into batches of about ``BATCH`` bytes. The ``LENGTH``-byte windows of a batch are told
   apart by their minimizer, the least hash of the ``GRAM``-byte strings in them; neighbouring windows of one
   minimizer form a run, so equal windows always lie in runs of equal minimizers. A batch sends each of its
   minimizers once, as 32 bits in one of many buckets, and gets back a bit for each: whether it also stands in
   another document. A wrong bit only sends bytes in vain.
2. The bytes of runs whose minimizer is shared (suffixes to begin a window with, and what they need to be read
   to ``LENGTH`` bytes) go to an index by bucket. Runs of a minimizer with more than ``CROWD`` different runs
   go by their single windows instead, which spreads them.
3. An index is a logarithmic family: runs that are equal byte by byte are one; where a minimizer has several
   unequal runs, these come in batches, each batch gets its suffix array (window starts in the order of the
   bytes from there), is merge-scanned against the arrays of the existing levels for matches of ``LENGTH``
   bytes, and levels of similar size are merged. Wherever a smaller document turns up, the places of the
   larger ones are sent back.
4. Each batch gets its places and gives its documents' results.

A batch sends equal runs only once (those of larger documents are known to be removed), so a passage that is
everywhere loads an index with one run from each batch. All matches are of bytes, not of hashes. An index holds
one bucket at a time, and buckets and tasks grow in number with the bytes of the corpus, so memory doesn't.
Texts are read in pieces of ``CHUNK`` bytes, so that a very long one needs no more than its own bytes.

A null id counts as 2**63 - 1; documents of equal id don't affect each other, and repeated rows have equal
results. Null and empty texts have no bytes. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.batches import by_first, opened, pack, packed_batches, parts, record_batch, single_rows, unpack
from setloom.llm.common import discard, give_back, materialize, parallelism, table, text_or_empty

#: Length of the strings that count as repeated, in bytes, and of the grams that minimizers are chosen from.
LENGTH, GRAM = 50, 24
#: Bytes of texts in a batch (or one text), and bytes that are hashed at once.
BATCH, CHUNK = 4_000_000, 1_000_000
#: Different runs of a minimizer beyond which its windows are dealt one by one.
CROWD = 50_000
#: Windows that an index takes in at once.
TAKEN = 1_000_000
#: Bytes of the corpus for each bucket and for each task of an index.
BUCKET_BYTES, TASK_BYTES = 8_000_000, 64_000_000
NULL_ID = (1 << 63) - 1
_U = np.uint64
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_B = 0x9E3779B97F4A7C15
_P = {k: _U(pow(_B, k, 1 << 64)) for k in (1, 2, 4, 8, 18, 34)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Runs:
    """The runs of a batch of joined texts: ``starts`` (bytes), ``counts`` (windows), ``codes`` (minimizers) and
    ``marks`` (64-bit fingerprints of their bytes). Windows don't cross from one text to the next."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray):
        parts = []
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw)) if len(raw) else np.zeros(0, np.int64)
        for c in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
            n = min(CHUNK, len(raw) - LENGTH + 1 - c)
            parts.append(self._chunk(raw[c : c + n + LENGTH - 1], left[c : c + n] >= LENGTH, c))
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.starts, self.counts, self.codes, self.marks = (np.concatenate(x) for x in zip(none, *parts))

    @staticmethod
    def _chunk(raw: np.ndarray, whole: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
        h1 = _BYTE[raw]
        h2 = h1[:-1] * _P[1] + h1[1:]
        h4 = h2[:-2] * _P[2] + h2[2:]
        h8 = h4[:-4] * _P[4] + h4[4:]
        h16 = h8[:-8] * _P[8] + h8[8:]
        least = _mix(h16[:-8] * _P[8] + h8[16:])
        for step in (1, 2, 4, 8, 11):  # the least of 2, 4, 8, 16 and 27 grams
            least = np.minimum(least[:-step], least[step:])
        cut = np.flatnonzero((least[1:] != least[:-1]) | (whole[1:] != whole[:-1])) + 1
        starts = np.concatenate(([0], cut))
        counts = np.diff(np.append(starts, len(least)))
        keep = whole[starts]
        starts, counts = starts[keep], counts[keep]
        if len(counts) and counts.max() > LENGTH:  # text that repeats itself
            n = -(-counts // LENGTH)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts, counts = np.repeat(starts, n) + nth * LENGTH, np.minimum(LENGTH, np.repeat(counts, n) - nth * LENGTH)

        def at(i: np.ndarray) -> np.ndarray:
            return _mix(h16[i] * _P[34] + h16[i + 16] * _P[18] + h16[i + 32] * _P[2] + h2[i + 48])

        marks = _mix(at(starts) * _U(3) + at(starts + counts - 1) + counts.astype(np.uint64) * _U(_B))
        return starts + offset, counts, least[starts], marks


def _owners(ids: list) -> np.ndarray:
    return np.array([NULL_ID if i is None else i for i in ids], np.int64)


def _placed(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each minimizer, in one number."""
    return (((codes >> _U(32)) % _U(buckets)) << _U(32)) | (codes & _U(0xFFFFFFFF))


def _by_bucket(places: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its part) of places sorted by bucket."""
    return parts((places >> _U(32)).astype(np.int64))


def _ask(packed: DataFrame, buckets: int) -> DataFrame:
    """Step 1, a batch's side: its minimizers by bucket, with the number of different runs and whether several
    of its documents have them."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("info", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, sizes, texts in single_rows(batches):
            ids, (sizes, raw) = _owners(ids), opened(sizes, texts)
            runs = Runs(np.frombuffer(raw, np.uint8), sizes)
            place, inverse = np.unique(_placed(runs.codes, buckets), return_inverse=True)
            if not len(place):
                continue
            doc = ids[np.searchsorted(np.cumsum(sizes), runs.starts, side="right")]
            order = np.lexsort((doc, inverse))
            lowest, highest = doc[order][np.searchsorted(inverse[order], np.arange(len(place)))], doc[order][np.searchsorted(inverse[order], np.arange(len(place)), side="right") - 1]
            order = np.lexsort((runs.marks, inverse))
            new = np.concatenate(([True], (np.diff(inverse[order]) != 0) | (runs.marks[order][1:] != runs.marks[order][:-1])))
            different = np.bincount(inverse[order][new], minlength=len(place))
            info = (np.minimum(different, 32767) << 1 | (lowest != highest)).astype(np.uint16)
            found = [(b, number, place[x].astype(np.uint32).tobytes(), info[x].tobytes()) for b, x in _by_bucket(place)]
            yield record_batch(found, schema)
        give_back()

    return packed.select("batch", "ids", "sizes", "texts").mapInArrow(run, "bucket int, batch bigint, keys binary, info binary")


def _answer(asked: DataFrame, tasks: int) -> DataFrame:
    """Step 1, an index's side: bits for the minimizers of every batch that are shared, and for those crowded."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("shared", pa.binary()), ("crowded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_first(batches):
            keys = [np.frombuffer(r[2], np.uint32) for r in rows]
            info = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows]).astype(np.int64)
            known, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            shared = (times > 1) | (np.bincount(which, info & 1, len(known)) > 0)
            crowded = shared & (np.bincount(which, info >> 1, len(known)) > CROWD)
            ends = np.cumsum([len(k) for k in keys])[:-1]
            bits = [[np.packbits(x).tobytes() for x in np.split(on[which], ends)] for on in (shared, crowded)]
            yield record_batch([(bucket, r[1], a, b) for r, a, b in zip(rows, *bits)], schema)
        give_back()

    dealt = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "bucket int, batch bigint, shared binary, crowded binary")


#: Kinds of rows: runs for an index; places of a batch known to be removed; places where a batch's run stands again.
PIECES, GONE, AGAIN = 0, 1, 2
_SENT = "bucket int, kind int, batch bigint, packed binary"


_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("packed", pa.binary())])


def _send(answered: DataFrame, buckets: int) -> DataFrame:
    """Step 2: bytes of the runs that are shared, each different run of a batch once (batch, ids, sizes, texts, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, sizes, texts, bits in single_rows(batches):
            ids, (sizes, raw) = _owners(ids), opened(sizes, texts)
            runs = Runs(np.frombuffer(raw, np.uint8), sizes)
            place, inverse = np.unique(_placed(runs.codes, buckets), return_inverse=True)
            shared, crowded = np.zeros(len(place), bool), np.zeros(len(place), bool)
            told = {b["bucket"]: b for b in bits}
            for b, x in _by_bucket(place):
                for on, name in ((shared, "shared"), (crowded, "crowded")):
                    on[x] = np.unpackbits(np.frombuffer(told[b][name], np.uint8), count=x.stop - x.start).astype(bool)
            pick = np.flatnonzero(shared[inverse])
            starts, counts, at = runs.starts[pick], runs.counts[pick], place[inverse[pick]]
            alone = crowded[inverse[pick]]
            if alone.any():  # windows one by one, by a hash of their own
                n = counts[alone]
                first = np.repeat(starts[alone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                spot = np.array([int.from_bytes(hashlib.blake2b(raw[s : s + LENGTH], digest_size=8).digest(), "little") for s in first.tolist()], np.uint64)
                starts, counts, at = np.concatenate((starts[~alone], first)), np.concatenate((counts[~alone], np.ones(len(first), np.int64))), np.concatenate((at[~alone], _placed(spot, buckets)))
            doc = ids[np.searchsorted(np.cumsum(sizes), starts, side="right")]
            order = np.lexsort((starts, doc))  # the smallest document's run speaks for its equals
            seen: dict[bytes, int] = {}
            own, gone, again = [], [], []
            for k, s, e, d in zip(order.tolist(), starts[order].tolist(), (starts + counts + LENGTH - 1)[order].tolist(), doc[order].tolist()):
                first = seen.setdefault(raw[s:e], k)
                if first == k:
                    own.append(k)
                elif doc[first] == d:
                    again.append((int(starts[first]), s, e - s - LENGTH + 1))
                else:
                    gone.append((s, e - s - LENGTH + 1))
            del seen
            rows, any_bucket = [], (number * _B >> 20) % buckets
            if gone:
                rows.append((any_bucket, GONE, number, pack(*(np.array(x, np.uint32) for x in zip(*gone)))))
            if again:
                rows.append((any_bucket, AGAIN, number, pack(*(np.array(x, np.uint32) for x in zip(*again)))))
            own = np.array(own, np.int64)
            own = own[np.lexsort((starts[own], at[own] >> _U(32)))]
            for b, x in _by_bucket(at[own]):
                k = own[x]
                ends = starts[k] + counts[k] + LENGTH - 1
                text = np.frombuffer(b"".join([raw[s:e] for s, e in zip(starts[k].tolist(), ends.tolist())]), np.uint8)
                rows.append((b, PIECES, number, pack(text, counts[k].astype(np.uint8), at[k].astype(np.uint32), np.diff(doc[k], prepend=0), np.diff(starts[k], prepend=0).astype(np.uint32))))
            yield record_batch(rows, _SENT_ARROW)
        give_back()

    return answered.select("batch", "ids", "sizes", "texts", "bits").mapInArrow(run, _SENT)


class LogIndex:
    """Suffix arrays in levels. Each holds windows in the order of their bytes, and for each the smallest known
    document and the place that stands for it (-1: a place already given up)."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    @staticmethod
    def suffix_array(text: np.ndarray, counts: np.ndarray, docs: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """Windows of joined runs in order; windows of one kind by document."""
        sizes = counts + LENGTH - 1
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + nth
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at].view(f"S{LENGTH}").ravel()
        docs, places = np.repeat(docs, counts), np.repeat(places, counts) + nth
        order = np.argsort(docs, kind="stable")
        order = order[np.argsort(windows[order], kind="stable")]
        return [windows[order], docs[order], places[order]]

    def add(self, level: list[np.ndarray]) -> np.ndarray:
        """Take a suffix array in; gives the places that turn out to stand in a smaller document too."""
        windows, docs, places = level
        new = np.concatenate(([True], windows[1:] != windows[:-1]))[: len(windows)]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        late = docs > docs[first][group]
        lost = [places[late]]
        windows, docs, places, group = windows[~late], docs[~late], places[~late], group[~late]
        kind, least = level[0][first], level[1][first]
        dead = np.zeros(len(kind), bool)  # whose owner an earlier level has
        for known in self.levels:
            a = np.searchsorted(known[0], kind)
            hit = np.flatnonzero(known[0][np.minimum(a, len(known[0]) - 1)] == kind)
            b = np.searchsorted(known[0], kind[hit], side="right")
            a, n = a[hit], b - a[hit]
            old = known[1][a]
            worse = old < least[hit]
            dead[hit[worse]] = True
            least[hit[worse]] = old[worse]
            a, n, now = a[old > least[hit]], n[old > least[hit]], least[hit][old > least[hit]]
            every = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            lost.append(known[2][every][known[2][every] >= 0])
            known[1][every], known[2][every] = np.repeat(now, n), -1
        lost.append(places[dead[group]])
        stay = ~dead[group]
        if stay.any():
            self.levels.append([windows[stay], docs[stay], places[stay]])
            while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
                late, early = self.levels.pop(), self.levels.pop()
                both = [np.concatenate(x) for x in zip(early, late)]
                order = np.argsort(both[0], kind="stable")  # two runs in order: merged in one pass
                self.levels.append([x[order] for x in both])
        return np.concatenate(lost)


def _resolved(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Step 3 for one bucket (rows of batch, packed): (batches, first windows, windows) that are removed."""
    text, counts, codes, docs, starts = zip(*(unpack(r[1], np.uint8, np.uint8, np.uint32, np.int64, np.uint32) for r in rows))
    batch = np.repeat(np.array([r[0] for r in rows], np.int64), [len(c) for c in counts])
    docs, starts = ([np.cumsum(x, dtype=x.dtype) for x in steps] for steps in (docs, starts))  # sent as steps
    counts, codes, docs, starts = (np.concatenate(x) for x in (counts, codes, docs, starts))
    counts, raw = counts.astype(np.int64), b"".join(x.tobytes() for x in text)
    ends = np.cumsum(counts + LENGTH - 1)
    begins = ends - counts - LENGTH + 1
    # runs equal byte by byte
    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(begins.tolist(), ends.tolist())], np.int64)
    del number
    order = np.lexsort((docs, kind))
    first = order[np.flatnonzero(np.concatenate(([True], np.diff(kind[order]) != 0)))]  # by kind, its smallest document's
    late = docs > docs[first][kind]
    yield batch[late], starts[late], counts[late]
    # minimizers with several kinds of runs: windows of each kind, for all that have its smallest document
    several = np.unique(codes[first], return_inverse=True, return_counts=True)
    open_kind = several[2][several[1]] > 1
    if not open_kind.any():
        return
    chosen = first[open_kind]
    index, gone = LogIndex(), []
    # a place is the kind's first byte in ``raw`` and the window in it
    at, taken = 0, np.cumsum(counts[chosen])
    while at < len(chosen):
        upto = max(at + 1, int(np.searchsorted(taken, (taken[at - 1] if at else 0) + TAKEN)))
        some = chosen[at:upto]
        joined = np.frombuffer(b"".join([raw[a:b] for a, b in zip(begins[some].tolist(), ends[some].tolist())]), np.uint8)
        gone.append(index.add(index.suffix_array(joined, counts[some], docs[some], begins[some])))
        at = upto
    gone = np.sort(np.concatenate(gone))
    if not len(gone):
        return
    new = np.concatenate(([True], (np.diff(gone) != 1) | (np.searchsorted(ends, gone[1:], side="right") != np.searchsorted(ends, gone[:-1], side="right"))))
    cut = np.flatnonzero(new)
    where, n = gone[cut], np.diff(np.append(cut, len(gone)))
    run = np.searchsorted(ends, where, side="right")
    shift = where - begins[run]
    # the same places in the other batches that have the run with the same document
    owner = np.flatnonzero(~late)
    owner = owner[np.argsort(kind[owner], kind="stable")]
    a, b = np.searchsorted(kind[owner], kind[run]), np.searchsorted(kind[owner], kind[run], side="right")
    times = b - a
    every = owner[np.repeat(a - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    yield batch[every], starts[every] + np.repeat(shift, times), np.repeat(n, times)


def _indexed(sent: DataFrame, tasks: int) -> DataFrame:
    """Step 3: deal the rows to indexes and give every batch its removed places (kind, batch, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_first(batches):
            out = [(bucket, kind, batch, packed) for _, kind, batch, packed in rows if kind != PIECES]
            pieces = [(batch, packed) for _, kind, batch, packed in rows if kind == PIECES]
            del rows
            for batch, first, n in _resolved(pieces) if pieces else ():
                order = np.lexsort((first, batch))
                batch, first, n = batch[order], first[order].astype(np.uint32), n[order].astype(np.uint32)
                cuts = np.flatnonzero(np.diff(batch)) + 1
                out += [(bucket, GONE, int(batch[a]), pack(first[a:b], n[a:b])) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]) if b > a]
            yield record_batch(out, _SENT_ARROW)
        give_back()

    dealt = sent.select("bucket", "kind", "batch", "packed").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _SENT).select("batch", F.struct("kind", "packed").alias("found"))


def _cut(raw: bytes, sizes: np.ndarray, found: list[dict]) -> Iterator[list[tuple[int, int]]]:
    """Removed spans (start, end) in bytes of each text of a batch."""
    edges = np.zeros(len(raw) + 1, np.int32)
    gone = np.zeros(len(raw) + 1, bool)
    for x in found:
        if x["kind"] == GONE:
            first, n = (v.astype(np.int64) for v in unpack(x["packed"], np.uint32, np.uint32))
            np.add.at(edges, first, 1)
            np.add.at(edges, first + n, -1)
    gone[:] = np.cumsum(edges) > 0
    for x in found:
        if x["kind"] == AGAIN:
            for first, other, n in zip(*(v.tolist() for v in unpack(x["packed"], np.uint32, np.uint32, np.uint32))):
                gone[other : other + n] |= gone[first : first + n]
    ends = np.cumsum(sizes)
    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))))
    # windows of a text end before its last bytes, so no run of them crosses into the next text
    spans = turns.reshape(-1, 2) + np.array([0, LENGTH - 1])
    owner = np.searchsorted(ends, spans[:, 0], side="right")
    if len(spans) > 1:  # windows apart may still cover bytes that meet
        new = np.concatenate(([True], (spans[1:, 0] > spans[:-1, 1]) | (np.diff(owner) != 0)))
        spans = np.column_stack((spans[new, 0], spans[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1), 1]))
        owner = owner[new]
    cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
    for k, base in enumerate((ends - sizes).tolist()):
        yield [(a - base, b - base) for a, b in spans[cuts[k] : cuts[k + 1]].tolist()]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and removed (array of start, end in bytes)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_or_empty().alias("t"))
    total = docs.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    tasks = max(parallelism(spark), -(-total // TASK_BYTES))
    buckets = max(8 * tasks, -(-total // BUCKET_BYTES))
    packed = packed_batches(docs, BATCH)
    answers = materialize(_answer(_ask(packed, buckets), tasks))
    bits = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "shared", "crowded")).alias("bits"))
    found = materialize(_indexed(_send(packed.join(bits, "batch"), buckets), tasks))
    discard(answers)
    removed = found.groupBy("batch").agg(F.collect_list("found").alias("found"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, texts, found in single_rows(batches):
            lengths, raw = opened(sizes, texts)
            out, base = [], 0
            for doc, size, spans in zip(ids, sizes, _cut(raw, lengths, found or [])):
                digest, at = hashlib.sha256(), base
                for a, b in spans:
                    digest.update(raw[at : base + a])
                    at = base + b
                digest.update(raw[at : base + size])
                out.append((doc, size, sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
                base += size
            yield record_batch(out, schema)
        give_back()

    whole = packed.join(removed, "batch", "left").select("ids", "sizes", "texts", "found")
    return whole.mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: bigint, end: bigint>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the digest of what is kept."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


#: The same by DuckDB: every window as hexadecimal text with its smallest document, and the bytes that are left.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d) t),
f AS (SELECT s, min(id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.r, w.p, coalesce(w.p > lag(w.p) OVER (PARTITION BY w.r ORDER BY w.p) + 50, TRUE) AS new FROM w JOIN f ON f.s = w.s WHERE w.id > f.first),
k AS (SELECT r, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS span FROM g),
spans AS (SELECT r, span, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY r, span),
kept AS (SELECT d.r, substr(d.h, 2 * lag(s.b, 1, 0) OVER (PARTITION BY d.r ORDER BY s.a) + 1, 2 * (s.a - lag(s.b, 1, 0) OVER (PARTITION BY d.r ORDER BY s.a))) AS piece, s.a, s.b FROM d JOIN spans s ON s.r = d.r),
x AS (SELECT r, string_agg(piece, '' ORDER BY a) AS head, max(b) AS b, count(*) AS n, sum(b - a) AS removed FROM kept GROUP BY r)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(x.removed, 0) AS BIGINT) AS n_removed, coalesce(x.n, 0) AS n_spans, sha256(unhex(coalesce(x.head, '') || substr(d.h, 2 * coalesce(x.b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x ON x.r = d.r
"""
