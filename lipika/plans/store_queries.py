"""Queries on tables that are written, replaced and read back: manifests, predictions, scorecards, lists, templates, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import tagger
from lipika.functions.lexicon import SPELLED_DIGITS
from lipika.operators import planning as pl
from lipika.operators import quality as q
from lipika.operators.relational import drop_private
from lipika.operators.rewrite import preview, rewrite, rewrite_corpus
from lipika.plans.base import query, table
from lipika.sources import corpus as src
from lipika.sources import sinks
from lipika.sources.scratch import scratch

_LANGS = ["te", "ta", "hi", "en"]
_SPELLED = "CASE lang " + " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in SPELLED_DIGITS.items()) + " END"
_RESPELLED = f"""rows AS (SELECT c_custkey, c_name, {_LANGS}[c_custkey % 4 + 1] AS lang, regexp_extract(c_name, '\\d+') AS run FROM customer),
spelled AS (SELECT *, lang <> 'en' AND run <> '' AS changed, array_to_string(list_transform(string_split(run, ''), lambda x: {_SPELLED}[TRY_CAST(x AS INT) + 1]), ' ') AS said FROM rows),
done AS (SELECT c_custkey, lang, changed, CASE WHEN changed THEN replace(c_name, run, said) ELSE c_name END AS text FROM spelled)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as manifest rows: their names hold one run of digits."""
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text"), lang.alias("lang"), F.format_string("clips/%d.wav", "c_custkey").alias("audio_path"))
    return rows.withColumn("entity_tokens", tagger.tag("text", F.lit("digits")))


@query(f"WITH {_RESPELLED} SELECT c_custkey, text, changed, changed AS listed, count(*) OVER (PARTITION BY lang) AS n, count(*) FILTER (changed) OVER (PARTITION BY lang) AS n_changed FROM done")
def rewrite_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest respelled in place, the list of clips to make anew, and the counts, by one call."""
    path, listed = scratch(spark, "manifest"), scratch(spark, "paths")
    _clips(spark, sf_dir).write.parquet(path)
    counts = rewrite_corpus(spark.read.parquet(path), path, listed)
    paths = spark.read.text(listed).select(F.col("value").alias("audio_path"), F.lit(True).alias("listed"))
    rows = spark.read.parquet(path).join(paths, "audio_path", "left").join(F.broadcast(counts.where("lang is not null")), "lang")  # four rows
    return rows.select("c_custkey", "text", "changed", F.coalesce("listed", F.lit(False)).alias("listed"), "n", "n_changed")


@query(f"WITH {_RESPELLED} SELECT lang, c_custkey, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c_custkey) AS n FROM done WHERE changed) WHERE n <= 5")
def rewrite_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(rewrite(_clips(spark, sf_dir)), "c_custkey").select("lang", "c_custkey", "text")


@query("SELECT o_orderkey, o_orderstatus, true AS first_kept FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def swap_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced twice by what is read from it; the backup stays the first original."""
    path = scratch(spark, "swap")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.parquet(path)
    for k in (3, 5):
        sinks.swap(spark.read.parquet(path).where(F.col("o_orderkey") % k != 0), path)
    kept = spark.read.parquet(f"{path}.orig").agg(F.count("*").alias("n")).crossJoin(F.broadcast(orders.agg(F.count("*").alias("m"))))  # one row each
    return spark.read.parquet(path).crossJoin(F.broadcast(kept.select((F.col("n") == F.col("m")).alias("first_kept"))))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS sentence FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSV with a header; rows without path or sentence go."""
    key, path = F.col("p_partkey"), scratch(spark, "tsv")
    rows = table(spark, sf_dir, "part").select(key.alias("client_id"), F.when(key % 4 != 0, key.cast("string")).alias("path"), F.when(key % 7 != 0, F.col("p_name")).alias("sentence"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return src.tsv(spark, path).select("path", "sentence")


@query("""SELECT system, lang, count(*) AS n, max(length(text)) AS longest FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS system, lang, text FROM documents WHERE coalesce(text, '') <> '') GROUP BY ALL""")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable predictions by system, language and hold-out, written and read back without private columns."""
    path = scratch(spark, "predictions")
    rows = q.usable_text(table(spark, sf_dir, "documents")).select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("system"), "lang", F.lit("h").alias("holdout"), "text", F.col("doc_id").alias("_row"))
    sinks.write_predictions(drop_private(rows), path)
    back = spark.read.schema("text string, system string, lang string, holdout string").json(path)
    return back.groupBy("system", "lang").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT CAST(count(*) AS DOUBLE) AS n, CAST(max(o_orderkey) AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS other FROM orders")
def scorecard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorecard written as JSON text and looked up by dotted paths."""
    card = table(spark, sf_dir, "orders").agg(F.struct(F.count("*").alias("n"), F.struct(F.max("o_orderkey").alias("last")).alias("by")).alias("orders"))
    path = scratch(spark, "card")
    spark.createDataFrame([(sinks.scorecard_json(card),)], "value string").write.text(path)
    look = lambda p: src.lookup("json", p)
    return src.scorecards(spark, path).select(look("orders.n").alias("n"), look("orders.by.last").alias("last"), look("orders.by.none").alias("other"))


@query("SELECT 'own' AS kind, n_name AS template FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'fallback', r_name FROM region")
def template_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of a class that has some, and of one whose file holds comments and blank lines alone."""
    own, empty, lang = (scratch(spark, "templates") for _ in range(3))
    line = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    table(spark, sf_dir, "nation").select(F.coalesce(line, F.concat(F.lit("# "), "n_name")).alias("value")).write.text(own)
    table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("  # none").alias("value")).write.text(empty)
    table(spark, sf_dir, "region").select(F.concat(F.lit(" "), "r_name").alias("value")).write.text(lang)
    return src.templates(spark, own, lang).select(F.lit("own").alias("kind"), "template").unionByName(src.templates(spark, empty, lang).select(F.lit("fallback").alias("kind"), "template"))


@query("SELECT CAST(3 AS BIGINT) AS n_files, (SELECT count(*) FROM supplier) AS n_rows, (SELECT min(s_suppkey) FROM supplier) AS first_key")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in name order: the first holds the smallest keys; all of them hold all rows."""
    path = scratch(spark, "shards")
    table(spark, sf_dir, "supplier").select("s_suppkey").repartitionByRange(3, "s_suppkey").write.parquet(path)
    files = src.files(spark, path, "*.parquet").agg(F.count_distinct("stem").alias("n_files"))
    rows = src.shards(spark, path).agg(F.count("*").alias("n_rows"))
    first = src.shards(spark, path, 1).agg(F.min("s_suppkey").alias("first_key"))
    return files.crossJoin(rows).crossJoin(first)  # one row each


@query("""SELECT o_orderpriority, CASE WHEN sum(o_totalprice) > 100000 THEN 'over' ELSE 'ok' END AS warning, CAST(0 AS BIGINT) AS n_spans FROM orders GROUP BY o_orderpriority""")
def cost_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs over a limit; a class without a pattern has no entity spans."""
    spans = F.size(tagger.tag(F.col("o_orderpriority"), F.lit("general"))).cast("long")
    sums = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("cost"))
    return sums.select("o_orderpriority", pl.cost_warning(F.col("cost"), 100000.0).alias("warning"), spans.alias("n_spans"))
