"""The driver's queries against their SQL in DuckDB, where the driver's tables are at hand."""

import glob
import os

import pytest

import __spark_entry__ as entry
from lipika.plans.base import QUERIES, SQL

SF = os.environ.get("QUERIES_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert len(SQL) >= len(QUERIES) - 5


def cell(x) -> str:
    if x is None or x != x:
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_digits_after_the_first_line_are_respelled(spark, tmp_path):
    rows = [(0, "no digit\nroom 12"), (1, "7 first\nnone"), (2, "none\n\nat all"), (3, None), (4, "a\nb\n5")]
    spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: (r.n, r.n_changed) for r in QUERIES["rewrite_spelled_digits"](spark, str(tmp_path)).collect()}
    assert got == {"te": (2, 2), "ta": (1, 1), "hi": (1, 0), "en": (1, 0), None: (5, 3)}
