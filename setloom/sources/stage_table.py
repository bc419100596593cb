"""Stage tables: an explicit schema, a key, append-only writes; plus CSV and JSON lines in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on one machine one is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="setloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/setloom-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StageTable:
    """One row per key in a Parquet folder; rows are added or a new version is written, never changed in place."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple[str, ...]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def rows(self) -> DataFrame:
        """What is stored; a folder that doesn't exist yet has no rows."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def conform(self, df: DataFrame) -> DataFrame:
        """The table's columns in order: missing ones null, extra ones an error."""
        extra = set(df.columns) - set(self.schema.names)
        if extra:
            raise ValueError(f"columns not in the table: {sorted(extra)}")
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))

    def append(self, df: DataFrame) -> None:
        """Add the rows whose key isn't stored yet, so a resumed run adds nothing twice."""
        new = self.conform(df).dropDuplicates(list(self.key))
        new.join(self.rows().select(*self.key), list(self.key), "left_anti").write.mode("append").parquet(self.path)

    def without(self, keys: DataFrame) -> DataFrame:
        """The rows but for the given keys, to be written as a new version."""
        return self.rows().join(keys.select(*self.key).distinct(), list(self.key), "left_anti")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV with a header; empty cells are null and bad ones too, never inferred."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays as words parted by spaces, null as an empty cell."""
    flat = [F.array_join(f.name, " ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested JSON lines by a given schema."""
    return spark.read.schema(schema).json(path)


def read_folder(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files of a folder: stem, bytes and md5; unfinished ``.part`` files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.where(~F.col("path").endswith(".part")).select(stem.alias("stem"), F.length("content").alias("bytes"), F.md5("content").alias("md5"))


def latest_version(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table of the newest dated folder that has it, found by the folders' names alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/date=*/{table}")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    newest = max(f.getPath().getParent().getName() for f in found)
    return spark.read.option("basePath", path).parquet(f"{path}/{newest}/{table}")
