"""Sources, sinks and the streaming pipeline, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lipika.sources import corpus as src
from lipika.sources import sinks
from lipika.streaming import corpus as stream


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "te_digits.jsonl", '{"id":"a","text":"x"}\n\n{bad\n{"id":"b","text":"నా"}\n')
    assert [r.id for r in src.jsonl_tolerant(spark, p, "id string, text string").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST"):
        src.jsonl(spark, p, "id string, text string").collect()
    got = src.jsonl_captured(spark, p, "id string, text string").orderBy("line").collect()
    assert [(r.line, r.id, r.bad_json) for r in got] == [(1, "a", None), (3, None, "{bad"), (4, "b", None)]
    assert src.with_order(src.jsonl_tolerant(spark, p, "id string")).orderBy("ord").first().id == "a"


def test_line_numbers_across_splits(spark, tmp_path):
    for k in range(2):
        write(tmp_path / f"l/{k}.txt", "".join(f"{k}-{i}-{'x' * (i % 50)}\n" for i in range(1, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = src.numbered_lines(spark, str(tmp_path / "l"))
        assert lines.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path / "l")).rdd.getNumPartitions() > 4
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 8000 and all(int(r.value.split("-")[1]) == r.line for r in got)


def test_replies(spark):
    df = spark.createDataFrame([(1, '```json\n{"text": "a"}\n `{"text": "b"}`\n{"other": 1}\nhello\n{bad\n```'), (2, None)], "k int, content string")
    assert [(r.k, r.text) for r in src.jsonl_from_replies(df).collect()] == [(1, "a"), (1, "b")]


def test_tsv(spark, tmp_path):
    p = write(tmp_path / "a.tsv", "1\tf\tT\tN\n2\tf\tT\n3\tf\tT\tN\tx\ty\tFEMALE\n")
    assert [(r.id, r.gender) for r in src.tsv_headless(spark, p).collect()] == [("1", ""), ("3", "FEMALE")]
    p = write(tmp_path / "b.tsv", "client_id\tpath\tsentence\nc\tp\ts\nc\t\ts\nc\tp2\t\n")
    assert [r.path for r in src.tsv(spark, p).collect()] == ["p"]


def test_sidecars_templates_shards(spark, tmp_path):
    write(tmp_path / "r/x/a.json", json.dumps({"text": "t", "lang": "te", "duration_s": 1.5}))
    write(tmp_path / "r/x/a.wav", "w")
    write(tmp_path / "r/b.json", "{bad")
    write(tmp_path / "r/b.wav", "w")
    write(tmp_path / "r/c.json", "{}")
    got = src.sidecar_manifest(spark, str(tmp_path / "r")).collect()
    assert [(r.audio_path, r.text, r.duration_s) for r in got] == [(str(tmp_path / "r/x/a.wav"), "t", 1.5)]
    cls, lang = write(tmp_path / "c.txt", "# no\n\n"), write(tmp_path / "l.txt", "one\n#x\ntwo \n")
    assert sorted(r.template for r in src.templates(spark, cls, lang).collect()) == ["one", "two"]
    assert [r.template for r in src.templates(spark, write(tmp_path / "c2.txt", "own\n"), lang).collect()] == ["own"]
    assert src.templates(spark, str(tmp_path / "none.txt"), lang).count() == 2
    spark.range(20).repartition(4).write.parquet(str(tmp_path / "sh"))
    assert src.shards(spark, str(tmp_path / "sh"), 2).count() < 20 == src.shards(spark, str(tmp_path / "sh")).count()


def test_plan_and_cards(spark, tmp_path):
    assert src.plan("rows: 5 # five\nname: 'x'\n", {"rows": 1, "k": 2}) == {"rows": 5, "k": 2, "name": "x"}
    assert src.plan('{"rows": 7}', {}) == {"rows": 7} and src.plan(None, {"a": 1}) == {"a": 1}
    assert src.plan("langs: [te, 'hi'] # two\nmix:\n  - a: b\n  - 2\nrows: 3\n- stray\nnone:\n", {"mix": [9], "none": 1}) == {"langs": ["te", "hi"], "mix": ["a: b", 2], "rows": 3, "none": 1}
    p = write(tmp_path / "s.json", json.dumps({"by": {"x": {"ehr": 0.5}}}))
    assert src.scorecards(spark, p).select(src.lookup("json", "by.x.ehr"), src.lookup("json", "by.y")).first()[:] == (0.5, None)
    df = spark.createDataFrame([("", "b")], "speaker_id string, client_id string")
    assert src.alternates(df, "who", "speaker_id", "speaker", "client_id").first().who == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "te", "x"), ("b", "hi", "నా")], "id string, lang string, text string")
    sinks.write_jsonl(df, str(tmp_path / "out"), ["lang"])
    assert "నా" in "".join(p.read_text() for p in (tmp_path / "out").rglob("*.json"))
    path = f"{tmp_path}/app"
    assert sinks.append_new(df, path, ["id"]) == 0
    assert sinks.append_new(df.unionByName(spark.createDataFrame([("c", "te", "y")], df.schema)), path, ["id"]) == 2
    assert spark.read.parquet(path).count() == 3
    sinks.swap(spark.read.parquet(path).where("id <> 'a'"), path)
    sinks.swap(spark.read.parquet(path).where("id <> 'b'"), path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(f"{path}.orig").count() == 3
    sinks.write_predictions(df.withColumn("system", F.lit("s")).withColumn("holdout", F.lit("h")), f"{tmp_path}/pred")
    assert spark.read.json(f"{tmp_path}/pred").where("system = 's'").count() == 2
    assert sinks.prediction_name("s", "te", "h", 5, 5, 1.2) == "s_te_h_n5_b5_rp1.2_predictions.jsonl"
    assert json.loads(sinks.scorecard_json(df.limit(1)))["id"] == "a"
    sinks.write_paths(df.select(F.col("id").alias("audio_path")), f"{tmp_path}/paths")
    assert spark.read.text(f"{tmp_path}/paths").count() == 2


def test_stream(spark, tmp_path):
    ok = {"id": "1", "lang": "te", "entity_class": "digits", "text": "నా పేరు రవి 98"}
    write(tmp_path / "in/a.jsonl", "\n".join(json.dumps(x, ensure_ascii=False) for x in (ok, ok | {"id": "2"}, ok | {"id": "3", "text": "short"})))
    rows = stream.deduplicate(stream.accept(stream.read(spark, str(tmp_path / "in"))))
    stream.write(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0].entity_tokens[0].surface == "98"
    n = lambda b: b.groupBy("lang").count()
    stream.score_batches(stream.read(spark, str(tmp_path / "in")), n, str(tmp_path / "cards"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cards")).first()["count"] == 3
