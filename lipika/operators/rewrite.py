"""Digit respelling: entity surfaces in a text become spelled digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.functions.lexicon import SPELLED_DIGITS
from lipika.functions.text import replace_first, spell_digits, text
from lipika.sources import sinks
from lipika.sources.scratch import spare

SPELLED_TYPES = ["pincode", "phone", "digit_run"]
#: Plot numbers are respelled from so many characters on.
PLOT_CHARS = 4


def should_rewrite(token: Column) -> Column:
    surface = F.trim(F.coalesce(token["surface"], F.lit("")))
    kind = F.coalesce(token["type"], F.lit(""))
    return (surface != "") & (kind.isin(SPELLED_TYPES) | ((kind == "house_or_plot") & (F.length(surface) >= PLOT_CHARS)))


def rewrite(df: DataFrame) -> DataFrame:
    """text respelled, text_original (null if unchanged), changed. Longest surfaces first; of each, the first occurrence.

    Rows of a language without spelling table pass through.
    """
    tokens = F.filter(F.coalesce("entity_tokens", F.array().cast("array<struct<surface:string,start:int,end:int,type:string>>")), should_rewrite)
    keyed = F.transform(tokens, lambda t, i: F.struct((-F.length(t["surface"])).alias("len"), i.alias("i"), t["surface"].alias("surface")))

    def step(acc: Column, t: Column) -> Column:
        spelled = spell_digits(t["surface"], F.col("lang"))
        use = (spelled != t["surface"]) & F.contains(acc["text"], t["surface"])
        return F.struct(F.when(use, replace_first(acc["text"], t["surface"], spelled)).otherwise(acc["text"]).alias("text"), (acc["changed"] | use).alias("changed"))

    done = F.aggregate(F.array_sort(keyed), F.struct(text("text").alias("text"), F.lit(False).alias("changed")), step)
    known = F.coalesce(F.col("lang").isin(list(SPELLED_DIGITS)), F.lit(False))
    (d,) = spare(df, "_done")
    out = df.withColumn(d, F.when(known, done).otherwise(F.struct(F.col("text").alias("text"), F.lit(False).alias("changed"))))
    return out.withColumn("text_original", F.when(F.col(f"{d}.changed"), F.col("text"))).withColumn("text", F.col(f"{d}.text")).withColumn("changed", F.col(f"{d}.changed")).drop(d)


def changed_counts(rewritten: DataFrame) -> DataFrame:
    """Rows and changed rows by language and in total (lang null)."""
    return rewritten.rollup("lang").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def preview(rewritten: DataFrame, order: str, k: int = 5) -> DataFrame:
    """First k changed rows of each language."""
    (n,) = spare(rewritten, "_n")
    return rewritten.where("changed").withColumn(n, F.row_number().over(Window.partitionBy("lang").orderBy(order))).where(F.col(n) <= k).drop(n)


def rewrite_corpus(df: DataFrame, path: str, listed: str, clip: str = "audio_path") -> DataFrame:
    """Replace the table at `path` by df respelled (df may be read from it; its first original stays beside it), write the
    clips of changed rows to `listed`, one path per line, and return the counts by language and in total."""
    sinks.swap(rewrite(df), path)
    done = df.sparkSession.read.parquet(path)
    sinks.write_paths(done.where("changed"), listed, clip)
    return changed_counts(done)
