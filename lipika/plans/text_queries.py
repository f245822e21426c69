"""Queries on text functions, tagging, validation, audit and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import tagger
from lipika.functions import text as tx
from lipika.operators import quality as q
from lipika.operators import relational as rel
from lipika.operators.rewrite import changed_counts, rewrite
from lipika.plans.base import SQL_SENTENCES, WS, query, sentences, sql_norm, sql_tokens, table


@query(f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5({sql_norm('text')}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def norm_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key's hash and the smallest row are all that is shuffled, and copies meet before the shuffle
    keyed = table(spark, sf_dir, "documents").select(F.md5(tx.plain_norm("text")).alias("key"), F.struct("doc_id", "lang", "source").alias("row"))
    return keyed.groupBy("key").agg(F.min("row").alias("row")).select("row.*")


@query(f"""SELECT conv_id, turn, CAST(n AS INT) AS n_tokens FROM (SELECT conv_id, turn, len({sql_tokens('text')}) AS n FROM conversations) WHERE n BETWEEN 3 AND 25""")
def token_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(q.length_ok("text")).select("conv_id", "turn", tx.token_count("text").alias("n_tokens"))


@query(r"""SELECT lang, count(*) AS n, round(avg(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 1.0)), 4) AS sfr FROM documents GROUP BY lang""")
def script_fidelity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", tx.script_fidelity("text", F.lit("en")).alias("sfr"))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("sfr"), 4).alias("sfr"))


@query(r"""SELECT source, CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS n_latin, CAST(sum(length(regexp_replace(text, '[^\x{00C0}-\x{00FF}]', '', 'g'))) AS BIGINT) AS n_accented,
  count(*) FILTER (regexp_matches(text, '[\x{00C0}-\x{00FF}]')) AS n_with_accent, count(*) FILTER (regexp_matches(text, '[A-Za-z]{2,}')) AS n_latin_word, CAST(sum(length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))) AS BIGINT) AS n_digits FROM documents GROUP BY source""")
def latin_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(
            F.sum(tx.latin_count("text")).cast("long").alias("n_latin"),
            F.sum(tx.block_count("text", 0xC0, 0xFF)).cast("long").alias("n_accented"),
            F.count_if(tx.has_block("text", 0xC0, 0xFF)).alias("n_with_accent"),
            F.count_if(tx.has_latin_word("text")).alias("n_latin_word"),
            F.sum(F.length(tx.digits_only("text"))).cast("long").alias("n_digits"),
        )
    )


_REASON = f"""CASE WHEN NOT len({sql_tokens('text')}) BETWEEN 3 AND 25 THEN 'length'
  WHEN NOT CASE entity_class WHEN 'digits' THEN true WHEN 'currency' THEN regexp_matches(text, '\\p{{Nd}}') OR regexp_matches(text, 'lakh|crore|rupees|₹|रुपये|రూపాయ|ரூபாய')
    WHEN 'addresses' THEN regexp_matches(text, '\\p{{Nd}}{{3,}}') WHEN 'brands' THEN regexp_matches(text, '[A-Za-z]{{2,}}') WHEN 'codemix' THEN regexp_matches(text, '[A-Za-z]{{2,}}') ELSE true END THEN 'entity_missing'
  ELSE 'ok' END"""


@query(f"WITH {SQL_SENTENCES} SELECT entity_class, {_REASON} AS reason, count(*) AS n FROM sentences GROUP BY ALL")
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(table(spark, sf_dir, "documents"))
    return rows.groupBy("entity_class", q.validation_reason("text", "lang", "entity_class").alias("reason")).agg(F.count("*").alias("n"))


# texts in the scripts that the driver's tables don't hold; the answers are worked out by hand from the rules (the danda
# is a Devanagari character, and without seeds any text may hold spelled digits)
_WRITTEN = [
    ("నా పేరు రవి 98", "te", "digits"),
    ("నా పేరు రవి అన్న", "te", "digits"),
    ("నా పేరు मेरा నా", "te", "proper_nouns"),
    ("నా పేరు OTP నా।", "te", "proper_nouns"),
    ("என் பெயர் ரவி ஆகும்", "ta", "codemix"),
    ("என் laptop வேலை செய்கிறது", "ta", "codemix"),
    ("मेरा पिन 560034 है", "hi", "addresses"),
    ("मेरा नाम दे दो", "hi", "currency"),
    ("only latin words here", "hi", "proper_nouns"),
    ("एक दो तीन", "hi", "digits"),
]


@query("""SELECT CAST(ord AS INT) AS ord, reason, issues FROM (VALUES (0, 'ok', 'no_entity_tokens_warn'), (1, 'ok', 'digits_no_digits,no_entity_tokens_warn'), (2, 'script_purity', 'foreign_script_devanagari'), (3, 'ok', 'foreign_script_devanagari'),
(4, 'entity_missing', 'codemix_not_mixed'), (5, 'ok', ''), (6, 'ok', 'no_entity_tokens_warn'), (7, 'entity_missing', 'no_entity_tokens_warn'), (8, 'ok', 'excess_latin_in_indic,missing_target_script'), (9, 'ok', 'no_entity_tokens_warn')) v(ord, reason, issues)""")
def script_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and audit with the rules of scripts."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_WRITTEN)], "ord int, text string, lang string, entity_class string")
    rows = rows.withColumn("entity_tokens", F.array().cast("array<struct<surface:string,start:int,end:int,type:string>>"))
    audited = q.audit(rows, tx.audit_key("text"))
    return audited.select("ord", q.validation_reason("text", "lang", "entity_class").alias("reason"), F.array_join(F.array_sort("issues.type"), ",").alias("issues"))


_APOLOGY = r"(?i)(^|[^A-Za-z0-9_\p{L}\p{N}])(I''m sorry|I cannot|I can''t|here are|here is|sure, here|of course|certainly)($|[^A-Za-z0-9_\p{L}\p{N}])"
_LEAK = r"""(?i)^(\s*[\[{"`]|output[: ]|[0-9]+[.)] |- |sample utterance)"""
_AUDIT = f"""{SQL_SENTENCES},
counted AS (SELECT *, len({sql_tokens('text')}) AS n_tok, row_number() OVER (PARTITION BY source, {sql_norm('text')}, len({sql_tokens('text')}) = 0 ORDER BY ord) AS place FROM sentences),
issues AS (
  SELECT *, CASE WHEN n_tok = 0 THEN ['empty_text'] ELSE list_filter([
    CASE WHEN n_tok < 3 THEN 'too_short' END, CASE WHEN n_tok > 25 THEN 'too_long' END, CASE WHEN regexp_matches(text, '{_APOLOGY}') THEN 'apology_leakage' END,
    CASE WHEN regexp_matches(text, '{_LEAK}') THEN 'format_leakage' END, CASE WHEN place > 1 THEN 'duplicate_within_file' END], lambda x: x IS NOT NULL) END AS types
  FROM counted),
each AS (SELECT source, ord, text, unnest(types) AS type FROM issues)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(table(spark, sf_dir, "documents"))
    return q.audit(rows, tx.plain_norm("text"), file=["source"], script_rules=False)


@query(f"WITH {_AUDIT} SELECT type, source, count(*) AS n FROM each GROUP BY type, source UNION ALL SELECT type, NULL, count(*) FROM each GROUP BY type")
def audit_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.issue_counts(_audited(spark, sf_dir), ["source"])


@query(f"WITH {_AUDIT} SELECT type, count(*) AS n FROM each GROUP BY type ORDER BY n DESC, type LIMIT 3")
def topk_issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_k(_audited(spark, sf_dir).select(F.explode("issues.type").alias("type")), "type", 3)


@query(f"WITH {_AUDIT} SELECT type, source, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY source, ord) AS n FROM each) WHERE n = 1")
def first_example_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.first_examples(_audited(spark, sf_dir), ["source", "ord"])


_CLEAN = f"""{SQL_SENTENCES},
reasons AS (
  SELECT *, CASE WHEN coalesce(lang, '') = '' OR coalesce(source, '') = '' THEN 'empty_metadata' WHEN len({sql_tokens('text')}) = 0 THEN 'empty_text' WHEN len({sql_tokens('text')}) < 3 THEN 'too_short'
    WHEN len({sql_tokens('text')}) > 25 THEN 'too_long' WHEN regexp_matches(text, '{_APOLOGY}') THEN 'apology_leakage' WHEN regexp_matches(text, '{_LEAK.replace("|sample utterance", "")}') THEN 'format_leakage' END AS reason
  FROM sentences),
cleaned AS (SELECT * EXCLUDE (reason), CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY source, {sql_norm('text')}, reason IS NULL ORDER BY ord) > 1 THEN 'duplicate' ELSE reason END AS reason FROM reasons)"""


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.clean(sentences(table(spark, sf_dir, "documents")), tx.plain_norm("text"), file=["source"], script_rules=False)


@query(f"WITH {_CLEAN}, r AS (SELECT source, coalesce(reason, 'kept') AS reason FROM cleaned) SELECT reason, source, count(*) AS n FROM r GROUP BY reason, source UNION ALL SELECT reason, NULL, count(*) FROM r GROUP BY reason")
def clean_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.reason_counts(_cleaned(spark, sf_dir), ["source"])


@query(f"""WITH {_CLEAN}, lost AS (SELECT *, max(reason IS NOT NULL) OVER (PARTITION BY source) AS lost FROM cleaned),
kept AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS no, first_value(lang) OVER (PARTITION BY source ORDER BY ord) AS l, first_value(entity_class) OVER (PARTITION BY source ORDER BY ord) AS c FROM lost WHERE reason IS NULL)
SELECT ord, CASE WHEN lost THEN l || '_' || c || '_' || lpad(CAST(no AS VARCHAR), 6, '0') ELSE id END AS id FROM kept""")
def clean_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.renumber(_cleaned(spark, sf_dir), file=["source"]).select("ord", "id")


@query(f"SELECT lang, md5({sql_norm('text')}) AS key, count(DISTINCT source) AS n_classes, count(*) AS n_rows FROM documents GROUP BY ALL HAVING count(DISTINCT source) > 1")
def cross_class_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.cross_class_duplicates(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), F.md5(tx.plain_norm("text")), ["lang"], "source", "doc_id").drop("instances")


# --- tagging ----------------------------------------------------------------------------------


def _span_sums(df: DataFrame, key: str, text: str, cls: str) -> DataFrame:
    spans = df.select(key, tagger.spans(text, cls).alias("s"))
    total = lambda f: F.aggregate(F.col(f"s.{f}"), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.where("size(s) > 0").select(key, F.size("s").cast("long").alias("n_spans"), total("start").alias("sum_start"), total("end").alias("sum_end"), F.col("s")[0]["surface"].alias("first_surface"))


def _sql_span_sums(source: str, key: str, text: str, pattern: str) -> str:
    return f"""WITH p AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {source}),
s AS (SELECT {key}, m, len(m) AS n, coalesce(list_sum(list_transform(range(1, len(m) + 1), lambda i: length(g[i]) * (len(m) - i + 1) + length(m[i]) * (len(m) - i))), 0) AS a, coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) AS l FROM p)
SELECT {key}, n AS n_spans, CAST(a AS BIGINT) AS sum_start, CAST(a + l AS BIGINT) AS sum_end, m[1] AS first_surface FROM s WHERE n > 0"""


@query(_sql_span_sums("customer", "c_custkey", "c_name", r"\p{Nd}+"))
def tag_digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_sums(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "digits")


@query(_sql_span_sums("documents", "doc_id", "text", r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"))
def tag_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_sums(table(spark, sf_dir, "documents"), "doc_id", "text", "currency")


@query(_sql_span_sums("documents", "doc_id", "text", f"[A-Z][A-Za-z0-9]+(?:{WS}[A-Z][A-Za-z0-9]+)*"))
def tag_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_sums(table(spark, sf_dir, "documents"), "doc_id", "text", "brands")


@query(_sql_span_sums("documents", "doc_id", "text", "[A-Za-z][A-Za-z0-9''-]*"))
def tag_codemix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_sums(table(spark, sf_dir, "documents"), "doc_id", "text", "codemix")


@query(_sql_span_sums("documents", "doc_id", "text", "[A-Z][A-Za-z]+"))
def tag_proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_sums(table(spark, sf_dir, "documents"), "doc_id", "text", "proper_nouns")


# a match between two boundaries is a whole run of word characters
_RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
_PINS = rf"len(list_filter({_RUNS}, lambda x: regexp_full_match(x, '\p{{Nd}}{{6}}')))"
_PLOTS = rf"len(list_filter({_RUNS}, lambda x: regexp_full_match(x, '\p{{Nd}}{{1,4}}[A-Za-z]?')))"


@query(f"SELECT doc_id, {_PINS} AS n_pins, {_PLOTS} AS n_plots FROM documents WHERE {_PINS} + {_PLOTS} > 0")
def tag_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "documents").select("doc_id", tagger.addresses("text").alias("s")).where("size(s) > 0")
    n = lambda k: F.size(F.filter("s", lambda x: x["type"] == k)).cast("long")
    return tags.select("doc_id", n("pincode").alias("n_pins"), n("house_or_plot").alias("n_plots"))


_DENSE = "list_filter([CASE WHEN regexp_matches(text, '\\p{Nd}') THEN 'digits' END, CASE WHEN regexp_matches(text, '\\p{Nd}') THEN 'currency' END, CASE WHEN regexp_matches(text, '[A-Z][A-Za-z0-9]+') THEN 'brands' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'codemix' END, CASE WHEN regexp_matches(text, '[A-Z][A-Za-z]+') THEN 'proper_nouns' END], lambda x: x IS NOT NULL)"


@query(f"WITH {SQL_SENTENCES} SELECT ({_DENSE})[1] AS assigned, len({_DENSE}) AS n_classes, count(*) AS n FROM sentences GROUP BY ALL")
def entity_dense_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(table(spark, sf_dir, "documents")).select(tagger.dense_classes("text", ["digits", "currency", "brands", "codemix", "proper_nouns"]).alias("c"))
    return rows.groupBy(F.try_element_at("c", F.lit(1)).alias("assigned"), F.size("c").cast("long").alias("n_classes")).agg(F.count("*").alias("n"))


# --- other scalars ----------------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, printf('%s_%06d', 'page', page_id) AS padded, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), nullif(regexp_extract(url, '\?(.*)$', 1), ''), 'none') AS first_part FROM pages""")
def path_and_id_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    part = tx.first_non_empty(F.regexp_extract("url", "#(.*)$", 1), F.regexp_extract("url", r"\?(.*)$", 1))
    return pages.select("page_id", tx.stem("url").alias("stem"), F.format_string("%s_%06d", F.lit("page"), "page_id").alias("padded"), F.coalesce(part, F.lit("none")).alias("first_part"))


@query(r"""SELECT c_custkey, array_to_string(list_transform(list_filter(string_split(c_phone, ''), lambda x: x <> '' AND x <> ' '), lambda x: CASE x WHEN '0' THEN 'शून्य' WHEN '1' THEN 'एक' WHEN '2' THEN 'दो' WHEN '3' THEN 'तीन' WHEN '4' THEN 'चार' WHEN '5' THEN 'पाँच' WHEN '6' THEN 'छह' WHEN '7' THEN 'सात' WHEN '8' THEN 'आठ' WHEN '9' THEN 'नौ' ELSE x END), ' ') AS spelled
FROM (SELECT c_custkey, c_name AS c_phone FROM customer)""")
def spell_digit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.spell_digits("c_name", F.lit("hi")).alias("spelled"))


@query(r"""SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) ELSE text END AS replaced FROM documents""")
def replace_first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.replace_first(F.col("text"), F.lit("the"), F.lit("THE")).alias("replaced"))


@query()
def rewrite_spelled_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    langs = F.element_at(F.array(*map(F.lit, ["te", "ta", "hi", "en"])), (F.col("ord") % 4 + 1).cast("int"))
    tagged = rows.withColumn("lang", langs).withColumn("entity_tokens", tagger.tag("text", F.lit("digits")))
    return changed_counts(rewrite(tagged))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def parse_jsonl_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_type", obj["k"].alias("k")).where("k is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' AND length(trim(text)) >= 10 AND length(text) * 0.06 BETWEEN 1.0 AND 25.0")
def conversational_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("scenario", F.when(F.col("role") == "system", "Read").otherwise(F.col("role"))).withColumn("duration", F.length("text") * 0.06).withColumn("audio", F.col("turn"))
    return q.conversational(rows).select("conv_id", "turn", "role")


