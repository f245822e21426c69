"""Planning arithmetic: what to skip, how many calls and clips, what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skip_pairs(pairs: DataFrame, have: DataFrame, on: list[str], target: int, share: float = 0.7) -> DataFrame:
    """Pairs with existing rows and whether there are enough of them to skip."""
    return pairs.join(have.groupBy(*on).agg(F.count("*").alias("existing")), on, "left").withColumn("existing", F.coalesce("existing", F.lit(0))).withColumn("skip", F.col("existing") >= share * target)


def generation_cost(total: Column, batch: int = 50, tokens_in: int = 400, tokens_out: int = 800, price_in: float = 1.0, price_out: float = 5.0) -> tuple[Column, Column]:
    """(calls, cost) of generating rows in batches."""
    calls = F.ceil(total / batch).cast("long")
    return calls, calls * (tokens_in * price_in + tokens_out * price_out) / 1e6


def mix_clips(total: Column, share: Column, price: Column) -> tuple[Column, Column]:
    """(clips, cost) of one system's share; halves round to even."""
    clips = F.bround(total * share).cast("long")
    return clips, clips * price


def cost_warning(total_cost: Column, limit: float = 100.0) -> Column:
    return F.when(total_cost > limit, F.lit("over")).otherwise(F.lit("ok"))


def evaluation_cost(n: Column, per_hour: int = 200, price: float = 1.10) -> tuple[Column, Column]:
    """(cost, minutes) of scoring n rows."""
    return n / per_hour * price, F.greatest(F.lit(5).cast("long"), F.floor(n / 30))


def kept_summary(rows: DataFrame, by: list[str], kept: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("raw"), F.count_if(kept).alias("kept"))


def holdout_plan(rows: DataFrame, by: list[str], speaker: str, shard: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_distinct(speaker).alias("speakers"), F.count_distinct(shard).alias("shards"), F.count("*").alias("rows"))
