"""Queries on sources, sinks, streams, SQL functions and the remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import tagger
from lipika.functions.register import register
from lipika.functions.text import key_norm, plain_norm
from lipika.operators import metrics as m
from lipika.operators import relational as rel
from lipika.plans.base import SQL_PAIRS, SQL_SENTENCES, plain_tight, query, sentences, sql_norm, sql_tokens, table
from lipika.plans.scoring_queries import SQL_TURN_CODES, tagged_pairs, turn_pairs
from lipika.plans.text_queries import _REASON
from lipika.sources import corpus as src
from lipika.sources import sinks
from lipika.sources.scratch import scratch
from lipika.streaming import corpus as stream


@query(f"WITH {SQL_SENTENCES} SELECT id, lang, entity_class, text FROM sentences")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(sentences(table(spark, sf_dir, "documents")).select("id", "lang", "entity_class", "text"), path, ["lang", "entity_class"])
    return src.jsonl(spark, path, "id string, lang string, entity_class string, text string").select("id", "lang", "entity_class", "text")


def _broken_lines(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines, every seventh cut in half."""
    path = scratch(spark, "broken")
    line = F.to_json(F.struct("event_id", "event_type"))
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 10)).otherwise(line)
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
    return path


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")
def jsonl_tolerant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.jsonl_tolerant(spark, _broken_lines(spark, sf_dir), "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id % 7 = 0 AS bad, count(*) AS n FROM events GROUP BY 1")
def jsonl_captured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.jsonl_captured(spark, _broken_lines(spark, sf_dir), "event_id long, event_type string")
    return rows.groupBy(F.col("bad_json").isNotNull().alias("bad")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS gender FROM orders WHERE o_orderkey % 3 <> 1")
def tsv_headless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three kinds of ragged rows: seven fields, three (dropped), four
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderkey"), "o_orderstatus")
    four = F.concat_ws("\t", "k", F.lit("f"), F.lit("t"), F.lit("n"))
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("\t", four, F.lit("x"), F.lit("y"), "o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, F.concat_ws("\t", "k", F.lit("f"), F.lit("t"))).otherwise(four)
    path = scratch(spark, "tsv")
    o.select(line.alias("value")).write.text(path)
    return src.tsv_headless(spark, path).select("id", "gender")


@query("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS text FROM events WHERE user_id % 5 <> 0")
def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    line = F.when(F.col("user_id") % 5 == 0, F.lit("no object here")).otherwise(F.concat(F.lit('`{"text": "'), F.col("user_id").cast("string"), F.lit('"}`')))
    return src.jsonl_from_replies(e.select("event_type", F.concat_ws("\n", F.lit("```json"), line, F.lit("```")).alias("content")))


@query("SELECT doc_id, lang FROM documents")
def append_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), scratch(spark, "append")
    sinks.append_new(docs.where("doc_id % 2 = 0"), path, ["doc_id"])
    sinks.append_new(docs, path, ["doc_id"])
    return spark.read.parquet(path)


@query(f"""WITH {SQL_SENTENCES}, ok AS (SELECT * FROM sentences WHERE {_REASON} = 'ok')
SELECT lang, entity_class, count(DISTINCT {sql_norm('text')}) AS n FROM ok GROUP BY ALL""")
def streamed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate, tag and deduplicate on a file stream that is drained once."""
    root = scratch(spark, "stream")
    rows = sentences(table(spark, sf_dir, "documents"))
    sinks.write_jsonl(rows.select("id", "lang", "entity_class", "text"), f"{root}/in")
    out = stream.deduplicate(stream.accept(stream.read(spark, f"{root}/in")))
    stream.write(out, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").groupBy("lang", "entity_class").agg(F.count("*").alias("n"))


@query(f"""SELECT lang, CAST(sum(len({sql_tokens('text')})) AS BIGINT) AS n_tokens, CAST(sum(len(regexp_extract_all(text, '\\p{{Nd}}+'))) AS BIGINT) AS n_runs,
  round(avg(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), 1.0)), 4) AS sfr FROM documents GROUP BY lang""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("lipika_documents")
    return spark.sql("SELECT lang, CAST(sum(token_count(text)) AS BIGINT) AS n_tokens, CAST(sum(size(tag_digit_run(text))) AS BIGINT) AS n_runs, round(avg(script_fidelity(text, 'en')), 4) AS sfr FROM lipika_documents GROUP BY lang")


@query()
def key_norm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each full normal form (NFKC and case folding), by the key's hash."""
    keyed = table(spark, sf_dir, "documents").select(F.md5(key_norm("text")).alias("key"), F.struct("doc_id", "lang", "source").alias("row"))
    return keyed.groupBy("key").agg(F.min("row").alias("row")).select("row.*")


_LOAN, _NOUN = "[A-Za-z][A-Za-z0-9''-]*", "[A-Z][A-Za-z]+"


@query(f"""WITH {SQL_PAIRS}, s AS (SELECT text, {sql_norm('hypothesis')} AS norm FROM pairs),
t AS (SELECT 'english_loan' AS type, regexp_extract_all(text, '{_LOAN}') AS m, norm FROM s UNION ALL SELECT 'proper_noun', regexp_extract_all(text, '{_NOUN}'), norm FROM s),
c AS (SELECT type, sum(len(m)) AS n, sum(len(list_filter(m, lambda x: CASE WHEN type = 'english_loan' THEN contains(norm, lower(x)) ELSE list_contains(regexp_split_to_array(norm, ' '), lower(x)) END))) AS h FROM t GROUP BY type)
SELECT type, CAST(n AS BIGINT) AS n_tokens, CAST(h AS BIGINT) AS n_hits, round(CAST(h AS DOUBLE) / n, 4) AS ehr FROM c""")
def ehr_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans, nouns = (tagged_pairs(spark, sf_dir, c) for c in ("codemix", "proper_nouns"))
    both = loans.unionByName(nouns, allowMissingColumns=True)
    return m.ehr_by_type(m.score_tokens(both, norm=plain_norm, tight_form=plain_tight))


@query(f"WITH {SQL_TURN_CODES} SELECT conv_id, turn FROM coded WHERE length(r) > 0 AND levenshtein(a, b) <= 0.9 * length(r)")
def cer_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cer_filter(turn_pairs(spark, sf_dir), 0.9).select("conv_id", "turn")


@query("SELECT count(*) AS n, count(*) FILTER (p.page_id IS NOT NULL) AS with_page FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id")
def sibling_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.format_string("d/%d.json", "doc_id").alias("path"))
    both = docs.unionByName(table(spark, sf_dir, "pages").select(F.format_string("d/%d.wav", "page_id").alias("path")))
    have = rel.with_sibling(both, "json", "wav").agg(F.count("*").alias("with_page"))
    return docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(have))  # one row each


@query(rf"WITH {SQL_SENTENCES} SELECT id, len(regexp_extract_all(text, '\p{{Nd}}')) > 0 AS has_digit, len(regexp_extract_all(text, '[A-Z][A-Za-z]+')) AS n_nouns FROM sentences")
def tag_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(table(spark, sf_dir, "documents"))
    n = lambda c: F.size(tagger.tag("text", F.lit(c))).cast("long")
    return rows.select("id", (n("digits") > 0).alias("has_digit"), n("proper_nouns").alias("n_nouns"))
