"""The queries of the subpackage that SQL can state, against that SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from setloom.llm import quality_rules, queries  # noqa: E402
from setloom.llm.common import table  # noqa: E402
from test_queries import rows  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_verdicts_can_be_filtered(spark):
    judged = quality_rules.judge(table(spark, DATA, "documents"), keep=("doc_id",))
    kept = {r.doc_id for r in judged.collect() if r.kept}
    assert {r.doc_id for r in judged.where("kept").select("doc_id").collect()} == kept
    assert judged.where("NOT kept AND n_words > 3").count() <= judged.count() - len(kept)
