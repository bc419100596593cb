"""Named queries: a Spark callable and, where SQL can express it, DuckDB SQL of the same name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Views that the SQL below may name. A set is an order, a play is a line of it at a position, a track is a part.
VIEWS = {
    "plays": """SELECT l_orderkey AS set_id, l_partkey AS track_id, l_suppkey AS label_id, l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_shipdate AS shipped,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS position FROM lineitem""",
    "sets": "SELECT o_orderkey AS set_id, o_custkey AS dj_id, o_orderdate AS played_on, o_orderpriority AS genre, o_orderstatus AS setting, o_totalprice AS total FROM orders",
    "tracks": "SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist, p_type AS style, p_size AS energy, p_retailprice AS bpm FROM part",
    "votes": "SELECT event_id, user_id AS series_id, event_type AS kind, ts, value AS votes, props FROM events",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the data folder's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a table."""
    return run_sql(spark, sf_dir, VIEWS[name]) if name in VIEWS else table(spark, sf_dir, name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the tables of a folder; the names are bound by argument, so nothing is left in the catalog."""
    text = with_views(sql).replace("{", "{{").replace("}", "}}")
    names = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", text)]
    for t in names:
        text = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s+){t}\b(?!\s*\()", rf"\g<1>{{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names if f"{{{t}}}" in text})


def with_views(sql: str) -> str:
    """Put the definitions of the VIEWS that the SQL names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"


def shared(name: str, sql: str, oracle: str | None = None) -> None:
    """Register one SQL text for both engines, or two where the dialects differ."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLES[name] = with_views(oracle or sql)


def query(name: str, oracle: str | None = None):
    """Register a DataFrame function, and its SQL if given."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return keep
