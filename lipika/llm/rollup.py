"""Token counts as delta-maintained rollups.

A batch is a set of signed changes: an insert adds a document and its tokens, a delete takes them away, a revision takes
the old count away and adds the new one (under the new source and language, if they changed). A batch is summed to one row
per (source, lang, tokenizer) in a data folder of its own, and committed by creating the marker of its name, which must not
exist, and which names the folder: of two that race, the second finds the marker there. Totals are the sums over the folders
that markers name. A compaction sums all batches into one folder and then creates one numbered manifest that names it and
the batches in it; they keep being known by name. What stops halfway leaves a folder that nothing names, or a marker or
manifest that was not finished: neither counts.

Defined results: null source and null lang are groups of their own; a null or empty text has 0 tokens and counts as a
document; very long texts are counted whole; repeated rows count as often as they occur; ties don't arise, as only sums are
kept; groups whose documents and tokens are both 0 are left out of the totals; an empty batch is committed without rows;
columns other than doc_id, text, lang and source are not read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import bounded_batches, drop_path, drop_scratch, materialize, scratch_path

BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS, BPE = "words-1", "byte_bpe_50k-1"
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"
KEYS = ["source", "lang", "tokenizer"]


def load_ranks(path: str = BPE_FILE) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _count(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("counts", pat_str=BPE_PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    return run


def count_tokens(docs: DataFrame, bpe_file: str | None = BPE_FILE) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: one row per document and tokenizer version (bpe_file None: words only)."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    if bpe_file is None:
        return base.select("doc_id", "source", "lang", F.lit(WORDS).alias("tokenizer"), words.alias("tokens"))
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(bpe_file))  # a fixed table
    both = base.select("doc_id", "source", "lang", words.alias("words"), "text").mapInArrow(_count(ranks), "doc_id long, source string, lang string, words long, tokens long")
    each = F.inline(F.array(F.struct(F.lit(WORDS).alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit(BPE).alias("tokenizer"), F.col("tokens"))))
    return both.select("doc_id", "source", "lang", each)


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).alias("documents"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from the counts before to the counts after, of the same documents."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """The committed batches under one folder: data folders, markers (batches) and manifests of compactions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("batches", "compactions"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _create(self, path: str, content: dict) -> bool:
        """Create a small file that must not exist; a line end shows that it is whole."""
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray((json.dumps(content) + "\n").encode()))
        out.close()
        return True

    def _read(self, path: str) -> dict | None:
        """A file's content; None if it is missing or was not finished."""
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def _names(self, folder: str) -> list[str]:
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))) if not n.startswith("."))

    def _manifest(self) -> tuple[int, dict]:
        """Number and content of the last whole manifest, and the number that comes next."""
        numbers = [int(n) for n in self._names("compactions")]
        for n in reversed(numbers):
            if (content := self._read(f"{self.root}/compactions/{n:08d}")) is not None:
                return numbers[-1] + 1, content
        return (numbers[-1] + 1 if numbers else 0), {"data": None, "batches": []}

    def _marker(self, batch: str) -> str:
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch names are made of letters, digits, - and _: {batch!r}")
        return f"{self.root}/batches/{batch}"

    def committed(self, batch: str) -> bool:
        return batch in self._manifest()[1]["batches"] or self._read(self._marker(batch)) is not None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed changes (source, lang, tokenizer, documents, tokens) once. False if the batch was there already."""
        marker = self._marker(batch)
        if self.committed(batch):
            return False
        data = f"data/{batch}-{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))
        summed.write.parquet(f"{self.root}/{data}")
        if self._fs.exists(self._path(marker)) and not self.committed(batch):
            self._fs.delete(self._path(marker), False)  # of an attempt that stopped between creating and writing it
        if self._create(marker, {"data": data}):
            return True
        drop_path(self.spark, f"{self.root}/{data}")
        return False

    def batches(self) -> list[str]:
        """Names of all committed batches."""
        folded = self._manifest()[1]["batches"]
        return sorted({*folded, *(b for b in self._names("batches") if self._read(self._marker(b)) is not None)})

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the next manifest, names of all batches, and the data folders that count."""
        number, manifest = self._manifest()
        names, folders = list(manifest["batches"]), [manifest["data"]] if manifest["data"] else []
        for b in self._names("batches"):
            if b not in manifest["batches"] and (marker := self._read(self._marker(b))) is not None:
                names.append(b)
                folders.append(marker["data"])
        return number, names, folders

    def _sums(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        return self._sums(self._state()[2])

    def compact(self) -> bool:
        """Fold all batches into one data folder; they stay known by name. False if another compaction came first."""
        number, names, folders = self._state()
        data = f"data/compacted-{uuid.uuid4().hex}"
        self._sums(folders).write.parquet(f"{self.root}/{data}")
        if self._create(f"{self.root}/compactions/{number:08d}", {"data": data, "batches": sorted(names)}):
            return True
        drop_path(self.spark, f"{self.root}/{data}")
        return False

    def vacuum(self) -> None:
        """Delete data folders that nothing names. For times without a reader or a commit."""
        used = set(self._state()[2])
        for name in self._names("data") if self._fs.exists(self._path(f"{self.root}/data")) else []:
            if f"data/{name}" not in used:
                drop_path(self.spark, f"{self.root}/data/{name}")


def token_rollup(docs: DataFrame, bpe_file: str | None = BPE_FILE) -> DataFrame:
    """The totals of docs after a history of signed batches that ends in exactly these documents.

    Documents are dealt into tenths by a hash of their id. A first load brings eight tenths, one of them under a wrong source
    and language with a wrong count, and another one twice; that copy is deleted, the wrong ones are revised, the batches are
    folded, and a batch with the last two tenths is sent twice.
    """
    spark = docs.sparkSession
    roll = Rollup(spark, scratch_path(spark, "rollup"))
    counted = materialize(count_tokens(docs, bpe_file), "counted")
    tenth = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    early, late, twice, wrong = (counted.where(c) for c in (tenth < 8, tenth >= 8, tenth == 0, tenth == 1))
    old = wrong.select("doc_id", F.col("lang").alias("source"), F.lit("unknown").alias("lang"), "tokenizer", (2 * F.col("tokens") + 1).alias("tokens"))
    roll.commit("load", inserts(early.where(tenth != 1)).unionByName(inserts(twice)).unionByName(inserts(old)))
    roll.commit("delete-copies", deletes(twice))
    roll.commit("revise", revisions(old, wrong))
    roll.compact()
    for _ in range(2):
        roll.commit("late", inserts(late))
    out = materialize(roll.totals(), "rollup-totals")
    drop_scratch(spark, counted)
    drop_path(spark, roll.root)
    return out
