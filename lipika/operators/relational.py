"""Joins, deduplication, samples and counts of the corpus tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.sources.scratch import spare


def keep_first(df: DataFrame, key: Column | list[str], order: str) -> DataFrame:
    """One row per key, the first by order."""
    k, n = spare(df, "_key", "_n")
    keys = key if isinstance(key, list) else [k]
    marked = df if isinstance(key, list) else df.withColumn(k, key)
    first = marked.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col(n) == 1)
    return first.select(*(F.col(f"`{c}`") for c in df.columns))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by order."""
    (n,) = spare(df, "_n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col(n) == 1).drop(n)


def join_hypotheses(gt: DataFrame, hyp: DataFrame, order: str = "ord") -> DataFrame:
    """Reference rows with their hypothesis (null: missing); on either side the last of equal ids wins."""
    right = keep_last(hyp, ["id"], order).select("id", "hypothesis")
    return keep_last(gt, ["id"], order).join(right, "id", "left")


def missing_hypotheses(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("hypothesis").isNull()).alias("missing_hypotheses"))


def attach_text(rows: DataFrame, texts: DataFrame, on: str = "id") -> DataFrame:
    """Text (and class general, no tokens) for rows that come without."""
    (t,) = spare(rows, "_text")
    right = texts.select(on, F.col("text").alias(t))
    missing = F.coalesce("text", F.lit("")) == ""
    out = rows.join(right, on, "left")
    cls = F.when(missing, "general").otherwise(F.col("entity_class")) if "entity_class" in rows.columns else F.lit("general")
    return out.withColumn("entity_class", cls).withColumn("text", F.when(missing, F.coalesce(t, F.lit(""))).otherwise(F.col("text"))).drop(t)


def unseen_speakers(rows: DataFrame, training: DataFrame, speaker: str = "speaker_id", source: str = "source", real: str = "real") -> DataFrame:
    """Rows whose speaker no real training row has; an empty speaker stays unless training has it too."""
    (s,) = spare(rows, "_s")
    used = training.where(F.col(source) == real).select(F.coalesce(F.col(speaker), F.lit("")).alias(s)).distinct()
    return rows.join(used, F.coalesce(F.col(speaker), F.lit("")) == F.col(s), "left_anti")


def held_out_system(rows: DataFrame, system: str, c: str = "synth_system") -> tuple[DataFrame, DataFrame]:
    """(hold-out, training): rows of one system and all others."""
    held = F.coalesce(F.col(c) == system, F.lit(False))
    return rows.where(held), rows.where(~held)


def without_leaks(rows: DataFrame, holdout: DataFrame, key) -> DataFrame:
    """Rows whose normalised text is in no hold-out; compared by 64-bit hash."""
    (h,) = spare(rows, "_h")
    bad = holdout.select(F.xxhash64(key("text")).alias(h)).distinct()
    return rows.withColumn(h, F.xxhash64(key("text"))).join(bad, h, "left_anti").drop(h)


def with_sibling(paths: DataFrame, ext: str, other: str) -> DataFrame:
    """Paths with extension `ext` whose stem also exists with extension `other`."""
    stem = lambda e: F.regexp_replace("path", rf"\.{e}$", "")
    (s,) = spare(paths, "_stem")
    right = paths.where(F.col("path").endswith(f".{other}")).select(stem(other).alias(s))
    return paths.where(F.col("path").endswith(f".{ext}")).withColumn(s, stem(ext)).join(right, s, "left_semi").drop(s)


def grid(*columns: DataFrame) -> DataFrame:
    """All combinations of small value lists."""
    out = columns[0]
    for c in columns[1:]:
        out = out.crossJoin(c)
    return out


# --- samples ----------------------------------------------------------------------------------


def draw(id_col: str | Column, seed: int) -> Column:
    """A reproducible pseudo-random order; the same in other SQL engines."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def stratified(df: DataFrame, by: str, k: int, id_col: str = "id", seed: int = 1337) -> DataFrame:
    """At most k rows of each class."""
    (n,) = spare(df, "_n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(by).orderBy(draw(id_col, seed), id_col))).where(F.col(n) <= k).drop(n)


def random_n(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    return df.orderBy(draw(id_col, seed), id_col).limit(n)


def balanced(df: DataFrame, by: str, n: int, classes: int, id_col: str = "id", seed: int = 1337) -> DataFrame:
    """n rows: n // classes of each class, then topped up from the rest."""
    share = n // classes
    # no class can give more than n, so few rows of each get as far as the ranking
    (m,) = spare(df, "_n")
    ranked = df.withColumn(m, F.row_number().over(Window.partitionBy(by).orderBy(draw(id_col, seed), id_col))).where(F.col(m) <= n)
    return ranked.orderBy(F.col(m) > share, draw(id_col, seed), id_col).limit(n).drop(m)


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def top_k(df: DataFrame, c: str, k: int) -> DataFrame:
    """Most frequent values; ties by value."""
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])
