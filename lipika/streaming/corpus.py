"""The corpus pipeline on a stream of JSON lines: validate, tag, deduplicate within a watermark, append, score by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lipika.functions.tagger import tag
from lipika.functions.text import plain_norm
from lipika.operators.quality import validation_reason
from lipika.sources.corpus import UTTERANCE


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder; the arrival time stands for an event time."""
    return spark.readStream.schema(UTTERANCE).option("maxFilesPerTrigger", files_per_trigger).json(path).withColumn("arrived", F.current_timestamp())


def accept(rows: DataFrame) -> DataFrame:
    """Valid rows with their entity tokens; stateless, works on tables as well."""
    ok = rows.where(validation_reason("text", "lang", "entity_class") == "ok")
    return ok.withColumn("entity_tokens", tag("text", "entity_class"))


def deduplicate(rows: DataFrame, delay: str = "1 hour", key: Callable = plain_norm) -> DataFrame:
    """First row of each text within the watermark; state is bounded by the delay."""
    return rows.withColumn("key", key("text")).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["lang", "entity_class", "key"]).drop("key")


def write(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def score_batches(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """A scorecard per micro-batch, written once per batch number."""

    def one(batch: DataFrame, number: int) -> None:
        score(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
