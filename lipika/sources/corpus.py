"""Sources: JSON lines (strict, tolerant, capturing), text replies, TSV, Parquet shards, sidecars, templates, plans."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UTTERANCE = "id string, lang string, entity_class string, text string, entity_tokens array<struct<surface:string,start:int,end:int,type:string>>, source_template string, llm_run_id string"
MANIFEST = "audio_path string, text string, lang string, entity_class string, system string, voice string, entity_tokens array<struct<surface:string,start:int,end:int,type:string>>, duration_s double"
TRAINING = "audio_path string, text string, lang string, entity_class string, synth_system string, source string, speaker_id string, entity_tokens array<struct<surface:string,start:int,end:int,type:string>>, duration_s double"
HOLDOUT = "id string, lang string, entity_class string, text string, audio_path string, source string, entity_tokens array<struct<surface:string,start:int,end:int,type:string>>, speaker_id string, scenario string, task_name string, duration_s double, read_id string, gender string"


def with_order(df: DataFrame) -> DataFrame:
    """ord: file name, then place in the file; what is first or last in a table that had an order."""
    return df.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")))


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: a bad line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_captured(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Bad lines are kept, in `bad_json`, with every line's number (from 1, blank lines counted) in its file."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_json"}
    return lines.withColumn("_row", F.from_json("value", f"{schema}, bad_json string", options)).select("file", "line", "_row.*")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1), value of text files. Files are read in splits; a line's number is its place in its split plus
    the lines of the file's splits before."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = lines.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_split", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(splits, ["file", "_split"]).select("file", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def jsonl_from_replies(df: DataFrame, c: str = "content", schema: str = "text string") -> DataFrame:
    """Objects with a text from free-form replies: one per line, backticks stripped, fences and other lines skipped."""
    line = F.trim(F.regexp_replace(F.trim(F.col("_line")), "^`+|`+$", ""))
    rows = df.withColumn("_line", F.explode(F.split(F.coalesce(F.col(c), F.lit("")), "\n"))).withColumn("_line", line)
    rows = rows.where(F.col("_line").startswith("{")).withColumn("_obj", F.from_json("_line", schema))
    return rows.where(F.col("_obj.text").isNotNull()).select(*[x for x in df.columns if x != c], "_obj.*")


def tsv_headless(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, filename, transcript, normalized, gender from ragged TSV without header: four fields at least; gender is the last
    field of seven or more."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 4)
    return rows.select(*[f[i].alias(n) for i, n in enumerate(["id", "filename", "transcript", "normalized"])], F.when(F.size(f) >= 7, F.try_element_at(f, F.lit(-1))).otherwise("").alias("gender"))


def tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headered TSV rows with path and sentence."""
    df = spark.read.option("sep", "\t").option("header", True).option("maxCharsPerColumn", -1).csv(path)
    return df.where((F.coalesce("path", F.lit("")) != "") & (F.coalesce("sentence", F.lit("")) != ""))


def shards(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Parquet shards in name order, the first so many."""
    files = sorted(spark.read.parquet(path).inputFiles())
    return spark.read.parquet(*files[:first])


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and stem of files below root, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return found.withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))


def sidecar_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest from *.json files that have a .wav of the same name; broken JSON is skipped."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    meta = texts.select(F.regexp_replace(F.input_file_name(), r"\.[^./]*$", "").alias("_stem"), F.from_json("value", MANIFEST.removeprefix("audio_path string, ") + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    wavs = files(spark, root, "*.wav").select(F.col("path").alias("audio_path"), F.regexp_replace("stem", "^file:/+", "/").alias("_stem"))
    joined = meta.where("m is not null and m._bad is null").withColumn("_stem", F.regexp_replace("_stem", "^file:/+", "/")).join(wavs, "_stem")
    return joined.select(F.regexp_replace("audio_path", "^file:/+", "/").alias("audio_path"), "m.*").drop("_bad").orderBy("audio_path")


def templates(spark: SparkSession, class_file: str, lang_file: str) -> DataFrame:
    """Template lines of the class's file if it has any, else of the language's; blank lines and # comments are no templates."""

    def read(path: str, rank: int) -> DataFrame:
        try:
            lines = spark.read.text(path)
        except Exception as e:  # a file that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lines = spark.createDataFrame([], "value string")
        return lines.select(F.trim("value").alias("template"), F.lit(rank).alias("rank")).where((F.col("template") != "") & ~F.col("template").startswith("#"))

    both = read(class_file, 0).unionByName(read(lang_file, 1))
    best = both.agg(F.min("rank").alias("best"))
    return both.join(F.broadcast(best), F.col("rank") == F.col("best")).select("template")  # one row


def _plan_value(value: str) -> object:
    """JSON, an inline list of bare words, or a bare word."""
    try:
        return json.loads(value)
    except ValueError:
        pass
    if value.startswith("[") and value.endswith("]"):
        return [_plan_value(v.strip()) for v in value[1:-1].split(",") if v.strip()]
    return value.strip("'\"")


def plan(text: str | None, defaults: dict) -> dict:
    """Plan from JSON or `key: value` lines, over the defaults; a value may be a list, inline or as `- item` lines below its key."""
    out = dict(defaults)
    if not text:
        return out
    try:
        return out | json.loads(text)
    except ValueError:
        pass
    key = None
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if (m := re.match(r"\s*-\s+(.+)$", line)) and key:
            out[key] = [*(out[key] if fresh else []), _plan_value(m[1].strip())]
            fresh = True
        elif m := re.match(r"\s*([A-Za-z_]\w*)\s*:\s*(.*)$", line):
            key, fresh = (None if m[2] else m[1]), False
            if m[2]:
                out[m[1]] = _plan_value(m[2])
            else:
                out.setdefault(key, None)
    return out


def scorecards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and JSON text of scorecard files, for lookups by path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))


def lookup(card: Column | str, path: str) -> Column:
    """A number by dotted path, null if it isn't there."""
    return F.get_json_object(card, "$." + path).try_cast("double")


def alternates(df: DataFrame, name: str, *candidates: str) -> DataFrame:
    """First non-empty of the candidate columns that exist."""
    have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates if c in df.columns]
    return df.withColumn(name, F.coalesce(*have, F.lit("")) if have else F.lit(""))
