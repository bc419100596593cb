"""What the operators of this package share: reading tables, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.sources.stage_table import shared_dir

#: White space that parts words, as a character class; fixed by the query contracts.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/setloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # shuffle files of finished jobs go when the driver's JVM finds that nothing refers to them
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.setloom_path = path
    return out


def discard(written: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    spark = written.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.setloom_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and an executor's limit counts them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, rows: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows whose texts have ``most`` bytes, or one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], rows: int = 2048) -> DataFrame:
    """Run a Python function over column lists of at most ``rows`` rows and a few MB, through Arrow.

    ``make`` is called once per task and gives the function; a value of None gives no rows. If the function
    has an attribute ``finish``, that is called after the task's last rows and may give more.
    """
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)
        batch = part = out = None
        for batch in batches:
            for part in slices(batch, rows):
                out = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield packed(out)
        if hasattr(f, "finish") and (out := f.finish()) is not None:
            yield packed(out)
        f = batch = part = out = None
        give_back()

    return df.mapInArrow(run, spark_schema)


def parallelism(spark: SparkSession) -> int:
    """The shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Digits, small ASCII letters and every byte outside ASCII stay, capitals become small, all else parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def by_size(texts: list, most: int = 4_000_000) -> Iterator[list]:
    """The texts in their order, in groups of ``most`` bytes (characters, if they are strings) or one text."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group
