"""The pipeline's stages: columns, decisions, and what stays."""

import os
from collections import Counter

import pytest

from lipika.llm import queries
from tests.llm.test_operators import DOCS, quality_rows

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 11))


def cell(x) -> str:
    return "null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{SF}/{f}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.execute(queries.SQL[name])
    names = sorted(got.columns)
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert len(want.description) == len(names)
    assert sorted(tuple(cell(r[n]) for n in names) for r in got.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = quality_rows()
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)] + [(100, 0), (103, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    words = rows[0][1].split()
    spark.createDataFrame([(1, " ".join(words[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns
    ids = {k: Counter(r.doc_id for r in v.collect()) for k, v in seen.items()}
    assert set(range(40)) <= set(ids["quality"]) and 100 not in ids["quality"]
    assert max(ids["neardup"].values()) == 1 and len(ids["neardup"]) < len(ids["quality"])
    assert set(ids["neardup"]) - set(ids["decontamination"]) == {0}
    assert ids["mixing"] == ids["sharding"] and set(ids["mixing"]) <= set(ids["decontamination"])
    assert Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == ids["sharding"]
    assert pipeline.run(spark, str(_empty(spark, tmp_path))).count() == 0


def _empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    return tmp_path / "none"
