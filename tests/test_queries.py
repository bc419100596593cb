"""Every registered query against its SQL on the smallest tables, by row count and values."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from setloom import catalog
from setloom.plans.registry import TABLES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    try:
        return f"{float(x):.9g}"
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def against_sql(spark, folder, name, **tables):
    """The query and its SQL over tables of a folder of their own."""
    c = duckdb.connect()
    for t, pdf in tables.items():
        pdf.to_parquet(folder / f"{t}.parquet", coerce_timestamps="us")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return rows(catalog.QUERIES[name](spark, str(folder)).toPandas()), rows(c.execute(catalog.ORACLES[name]).df())


def test_energy_shape_at_thresholds(spark, tmp_path):
    """Sets whose correlation is 0.6 but for rounding."""
    v, p = np.random.default_rng(1).integers(1, 51, (2_000_000, 4)), np.arange(4)
    cov, vx, vy = 4 * (v * p).sum(1) - 6 * v.sum(1), 20, 4 * (v * v).sum(1) - v.sum(1) ** 2
    tied = v[(25 * cov * cov == 9 * vx * vy) & (vy > 0)]
    assert len(tied) > 100
    lines = [{"l_orderkey": k, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": i, "l_quantity": float(q), "l_extendedprice": 1.0, "l_discount": 0.0, "l_shipdate": datetime.datetime(2020, 1, 1)} for k, r in enumerate(tied) for i, q in enumerate(r)]
    got, want = against_sql(spark, tmp_path, "l09_energy_shape", lineitem=pd.DataFrame(lines))
    assert got == want


def tracks(rows):
    return pd.DataFrame(rows, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


def test_normalised_names_make_no_pairs(spark, tmp_path):
    """Two hundred thousand tracks of one name: four times ten to the tenth pairs."""
    n = 200_000
    tracks([(k % (n - 1), None if k == 7 else f"Hot {k % 2 * '- '}Bolt", "a", "S", 1, 900.0) for k in range(n)]).to_parquet(tmp_path / "part.parquet")
    got = {r.track_id: r.n for r in catalog.QUERIES["j20_normalised_names"](spark, str(tmp_path)).collect()}
    assert len(got) == n - 2 and got.pop(0) == 2 * (n - 1) and set(got.values()) == {n - 1}
    small = [(k % 9, None if k == 7 else f"Hot {k % 2 * '- '}Bolt {k % 3}", "a", "S", 1, 900.0) for k in range(30)]
    got, want = against_sql(spark, tmp_path, "j20_normalised_names", part=tracks(small))
    assert got == want
