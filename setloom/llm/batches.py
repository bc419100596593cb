"""Documents packed into batches, and rows of packed arrays that batches and indexes send each other.

A batch is one row: the ids and sizes of its documents and their joined texts, compressed. Operators that ask a
distributed table about what a batch holds send one row for each batch and bucket, and get one back for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import give_back, materialize, slices


#: Level of compression; a batch is written once and shuffled as it is.
LEVEL = 5


def squeeze(raw: bytes) -> bytes:
    """Bytes compressed."""
    return pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one row's columns as compressed bytes, each behind its length."""
    raw = b"".join(len(x := a.tobytes()).to_bytes(8, "little") + x for a in arrays)
    return len(raw).to_bytes(8, "little") + squeeze(raw)


def unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of :func:`pack`, of the given kinds of numbers."""
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def packed_batches(docs: DataFrame, most: int) -> DataFrame:
    """Rows of documents (doc_id, t) packed into batches of ``most`` bytes or one text, as a table: batch, ids,
    sizes, texts."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([ids], schema[0].type), pa.array([[len(t) for t in texts]], schema[1].type), pa.array([squeeze(b"".join(texts))], pa.binary())], schema=schema)

        for batch in batches:
            for some in slices(batch, 512):
                for doc, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    raw = t.encode()
                    if ids and size + len(raw) > most:
                        yield flushed()
                        ids, texts, size = [], [], 0
                    ids.append(doc)
                    texts.append(raw)
                    size += len(raw)
        if ids:
            yield flushed()
        give_back()

    rows = docs.select("doc_id", "t").mapInArrow(run, "ids array<bigint>, sizes array<bigint>, texts binary")
    return materialize(rows.withColumn("batch", F.monotonically_increasing_id()))


def opened(sizes: list[int], texts: bytes) -> tuple[np.ndarray, bytes]:
    """A batch's sizes and joined bytes."""
    sizes = np.array(sizes, np.int64)
    total = int(sizes.sum())
    return sizes, pa.decompress(texts, total, codec="zstd", asbytes=True) if total else b""


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that only one is held as Python objects."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c.slice(at, 1).to_pylist()[0] for c in batch.columns)


def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(value, its rows) of rows that come sorted by their first column."""
    now, held = None, []
    for row in single_rows(batches):
        if held and row[0] != now:
            yield now, held
            held = []
        now = row[0]
        held.append(row)
    if held:
        yield now, held


def parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its part) of sorted buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow."""
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
