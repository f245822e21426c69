"""Sinks: JSON lines by language and class, append with resume, swap in place, predictions, scorecards, path lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, text as it is; one folder per value of `by`. Spark's commit makes the write all or nothing."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def append_new(df: DataFrame, path: str, keys: list[str], schema: str | None = None) -> int:
    """Append the rows whose keys the table at `path` doesn't have; returns how many it had."""
    spark = df.sparkSession
    fs, path_ = _fs(spark, path)
    if not fs.exists(path_(path)):
        df.write.parquet(path)
        return 0
    have = spark.read.parquet(path).select(*keys)
    new = df.join(have.distinct(), keys, "left_anti")
    n = have.count()
    new.write.mode("append").parquet(path)
    return n


def swap(df: DataFrame, path: str, backup: bool = True) -> None:
    """Replace the table that df may be read from: write beside it, keep the first original as backup, rename."""
    fs, path_ = _fs(df.sparkSession, path)
    mark = uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.orig"
    df.write.parquet(new)
    # what is replaced goes aside first, so that one of the two is always there
    first = backup and not fs.exists(path_(old))
    aside = old if first else f"{path}.old-{mark}"
    if fs.exists(path_(path)) and not fs.rename(path_(path), path_(aside)):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(path_(new), path_(path)):
        raise OSError(f"{path} can't be replaced; its last state is in {aside}")
    if not first:
        fs.delete(path_(aside), True)


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction rows by system, language and hold-out."""
    df.write.mode("append").partitionBy("system", "lang", "holdout").json(path)


def prediction_name(system: str, lang: str, holdout: str, n: int, beams: int = 1, penalty: float | None = None) -> str:
    return f"{system}_{lang}_{holdout}_n{n}" + (f"_b{beams}" if beams > 1 else "") + (f"_rp{penalty}" if penalty else "") + "_predictions.jsonl"


def scorecard_json(card: DataFrame) -> str:
    """A one-row scorecard as JSON text."""
    return card.select(F.to_json(F.struct("*"), {"pretty": "true"})).first()[0]


def write_paths(df: DataFrame, path: str, c: str = "audio_path") -> None:
    """One path per line."""
    df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).write.text(path)
