"""Shared pieces of the training-data operators: scratch tables, batching, vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text handled at once by the vectorised passes; bounds a worker's memory.
CHUNK_BYTES = 2_000_000


#: Rows and bytes that go to a Python worker at once. Rows can be whole documents or pairs of shingle sets, so Spark's
#: default of 10,000 would make batches of over 100 MB.
BATCH_ROWS, BATCH_BYTES = 1000, 16_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES, unless they are lower."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, most)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset and all is one machine."""
    bounded_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lipika-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lipika/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared root."""
    path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_, True)


def drop_scratch(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        if files := df.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like these that are not among `columns`, however upper and lower case are written."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def part_number(file: str) -> int:
    """Number of the partition that wrote a Parquet file."""
    return int(file.split("-")[1])


def numbered(ordered: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table that is partitioned by range and sorted; read it back with `place`, each row's number in the whole order.

    The driver sees one count of each written file.
    """
    spark = ordered.sparkSession
    rows = materialize(ordered, name, **options).select("*", F.col("_metadata.file_name").alias("place_file"), F.col("_metadata.row_index").alias("place_at"))
    files = sorted(((r.place_file, r.n) for r in rows.groupBy("place_file").agg(F.count("*").alias("n")).collect()), key=lambda r: part_number(r[0]))
    bases = np.concatenate([[0], np.cumsum([n for _, n in files])]) if files else []
    base = spark.createDataFrame([(f, int(b)) for (f, _), b in zip(files, bases, strict=False)], "place_file string, place_base long")
    return rows.join(F.broadcast(base), "place_file").select(*ordered.columns, (F.col("place_base") + F.col("place_at")).alias("place"))


def hash_place(*cols: str) -> Column:
    """A reproducible place in [0, 1) for a row's values."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**52)) / F.lit(float(2**52))


#: A sample of k of n rows by smallest hash place looks only at places below SAMPLE_ROOM * k / n; of 400 or more, fewer
#: than k below that are as good as impossible.
SAMPLE_ROOM = 4.0


# --- text buffers -----------------------------------------------------------------------------


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets into them) of runs of rows of about `limit` bytes.

    Null texts are empty. No copy is made; a row longer than the limit is a run of its own.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their column holds about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _table(word: str) -> np.ndarray:
    """Per byte: 0 for separators, else the byte the word keeps.

    'alnum': words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; 'space': words [^\\x20\\x09-\\x0D]+ as they
    are; 'space_lower': the same after lower-casing A-Z.
    """
    t = np.arange(256, dtype=np.uint8)
    if word != "space":
        t[65:91] += 32
    if word == "alnum":
        b = np.arange(256)
        t[(b < 128) & ~((b >= 48) & (b <= 57)) & ~((b >= 65) & (b <= 90)) & ~((b >= 97) & (b <= 122))] = 0
    else:
        t[[9, 10, 11, 12, 13, 32]] = 0
    return t


#: NUL is a word byte under 'space'; it shares a code with no separator because the code of byte b is b, and 0 is moved to 1.
TABLES = {k: _table(k) for k in ("alnum", "space", "space_lower")}
IS_WORD = {k: t != 0 for k, t in TABLES.items()}
for _k in ("space", "space_lower"):
    IS_WORD[_k][0] = True
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_pow = np.ones(1, U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.concatenate([np.ones(1, U64), np.full(max(n, 4096) - 1, _MULT)]).cumprod(dtype=U64)
    return _pow


def word_bounds(data: np.ndarray, off: np.ndarray, word: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; rows (see `off`) separate words too."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IS_WORD[word][data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cut = off[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:] | ~inside[1:]
    return starts, np.flatnonzero(last & inside) + 1


def word_hashes(data: np.ndarray, off: np.ndarray, word: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the word counts' prefix sums by row (len(off) entries)."""
    starts, ends = word_bounds(data, off, word)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    out = np.empty(len(starts), U64)
    table = TABLES[word]
    k = 0
    while k < len(starts):  # long rows are hashed piece by piece
        e = max(k + 1, int(np.searchsorted(ends, starts[k] + 2 * CHUNK_BYTES, side="right")))
        s0, s1 = starts[k], ends[e - 1]
        length = ends[k:e] - starts[k:e]
        at = np.arange(s1 - s0, dtype=np.int64)
        at -= np.repeat(starts[k:e] - s0, np.diff(np.append(starts[k:e], s1)))
        with np.errstate(over="ignore"):
            value = BYTE_CODE[table[data[s0:s1]]]
            value[~IS_WORD[word][data[s0:s1]]] = 0
            value *= _powers(int(at.max()) + 1)[at]
            out[k:e] = mix64(np.add.reduceat(value, starts[k:e] - s0) + length.astype(U64) * _MULT)
        k = e
    return out, np.searchsorted(starts, off)


def rows_of(counts_prefix: np.ndarray) -> np.ndarray:
    """Row index of every word, from word_hashes' prefix sums."""
    return np.repeat(np.arange(len(counts_prefix) - 1), np.diff(counts_prefix))


def shingles(words: np.ndarray, prefix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle and its row; a row of fewer words, but not none, has one shingle of them all."""
    n = np.diff(prefix)
    row = rows_of(prefix)
    if not len(words):
        return np.zeros(0, U64), row
    left = prefix[1:][row] - np.arange(len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words), U64)
        for j in range(k):
            part = np.zeros(len(words), U64)
            part[: max(0, len(words) - j)] = words[j:]
            part[left <= j] = U64(0x51ED27)
            h = mix64(h * U64(6364136223846793005) + part + U64(j + 1))
    keep = (left >= k) | ((np.arange(len(words)) == prefix[:-1][row]) & (n[row] < k))
    return h[keep], row[keep]
