"""Registry of the driver's queries and their SQL, and the pieces of SQL that mirror the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions.text import plain_norm, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Spark ------------------------------------------------------------------------------------

#: Lines that a document has at most, for numbering them throughout.
LINES = 2**24
CLASSES = ["digits", "currency", "addresses", "brands", "codemix", "proper_nouns"]


def sentences(docs: DataFrame) -> DataFrame:
    """Every line of each document as an utterance: id, lang, source, entity_class (by doc_id and line), text, ord."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split(text("text"), "\n", -1)).alias("line", "text"))
    cls = F.element_at(F.array(*map(F.lit, CLASSES)), ((F.col("doc_id") + F.col("line")) % len(CLASSES) + 1).cast("int"))
    return lines.select(F.concat_ws("-", "doc_id", "line").alias("id"), "lang", "source", cls.alias("entity_class"), "text", (F.col("doc_id") * LINES + F.col("line")).alias("ord"))


def plain_tight(c: Column | str) -> Column:
    return F.replace(text(c), F.lit(" "), F.lit(""))


#: What the simulated transcriber never writes.
UNHEARD = "jJzZvV7,"


def spoken_pairs(docs: DataFrame) -> DataFrame:
    """Every line of each document as a reference; the hypothesis is the whole line as a transcriber writes it who misses UNHEARD."""
    return sentences(docs).withColumn("hypothesis", F.translate("text", UNHEARD, ""))


# --- DuckDB -----------------------------------------------------------------------------------

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}'), lambda x: x <> '')"


def sql_norm(t: str) -> str:
    return f"lower(trim(regexp_replace({t}, '{WS}', ' ', 'g')))"


SQL_SENTENCES = f"""sentences AS (
  SELECT doc_id || '-' || line AS id, lang, source, [{', '.join(repr(c) for c in CLASSES)}][(doc_id + line) % {len(CLASSES)} + 1] AS entity_class,
         lines[line + 1] AS text, doc_id * {LINES} + line AS ord
  FROM (SELECT *, unnest(range(len(lines))) AS line FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"""

SQL_PAIRS = f"""{SQL_SENTENCES},
pairs AS (SELECT *, translate(text, '{UNHEARD}', '') AS hypothesis FROM sentences)"""
