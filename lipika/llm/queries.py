"""The opN queries over a driver's table folder, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("text_h")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.rollup import token_rollup

    return token_rollup(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.quality import labels_beside, quality

    return quality(table(spark, sf_dir, "documents"), labels_beside(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.lmscore import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


# --- what SQL can say of the operators' results ------------------------------------------------


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lipika.llm.rollup import WORDS

    return op6_token_rollup(spark, sf_dir).where(F.col("tokenizer") == WORDS).drop("tokenizer")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_lmscore(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
# of 20 bits, four digits of five bits each
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '')"


def _crc32(c: str) -> str:
    """Bit by bit: -1 stands for a shift, other numbers are bytes."""
    bits = f"list_concat([4294967295::BIGINT], flatten(list_transform(string_split({c}, ''), lambda x: list_concat([CAST(ord(x) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT))))))"
    return f"xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


_PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
_PLACES = "list_concat(" + ", ".join(f"list_transform(list_filter(range(len(w)), lambda k: w[k + 1:k + {len(p.split())}] = {p.split()!r}), lambda k: {{'at': k, 'label': '{label}'}})" for p, label in _PHRASES) + ")"

SQL = {
    "op3_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
found AS (SELECT r, item_id, k, dw.n FROM dw JOIN iw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM found WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "warc_records": f"""WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS keeper, row_number() OVER (PARTITION BY h, n, page_id ORDER BY url NULLS FIRST) AS place FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN keeper IS NULL OR (keeper = page_id AND place = 1) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT (keeper IS NULL OR (keeper = page_id AND place = 1)) THEN keeper END AS refers_to FROM k""",
    "mix_sizes": f"SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM (SELECT doc_id, source, len({_SPACE}) AS size FROM documents)",
    "rollup_words": f"SELECT source, lang, count(*) AS documents, CAST(sum(len({_SPACE})) AS BIGINT) AS tokens FROM documents GROUP BY source, lang",
    "quality_counts": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SPACE} AS w FROM documents),
g AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2)),
t AS (SELECT r, k FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM t) GROUP BY r),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM d)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM l LEFT JOIN c USING (r)""",
    "license_phrases": f"""WITH d AS (SELECT doc_id, w, {_PLACES} AS p FROM (SELECT doc_id, {_ALNUM} AS w FROM documents))
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS base_labels FROM d""",
    "lm_base": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2, false) AS held_out, list_concat({_SPACE.replace("coalesce(text, '')", f"translate(coalesce(text, ''), {_AZ})")}, [' ']) AS w FROM documents),
t AS (SELECT r, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10(coalesce(c, 0) + 1)) AS s FROM t LEFT JOIN c USING (x) GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(s - n_tokens * log10(n + v + 1), 4) AS base_score FROM d JOIN s USING (r), n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_mixing, op3_decontamination, op4_neardup, op5_langid, op6_token_rollup, op7_quality, op8_sharding, op9_licenses, op10_lmscore)
    return {f.__name__: f for f in (*own, warc_records, mix_sizes, rollup_words, quality_counts, license_phrases, lm_base)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
