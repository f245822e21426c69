"""Sharding by minimax contiguous partition.

Atomic groups (documents of equal text) are laid out in one global order. The smallest capacity at which a greedy
left-to-right fill needs at most n shards is found by binary search, each probe checked greedily over the prefix sums of
the group sizes, and the order is cut there. Prefix sums stay in the shared folder; the driver holds one sum per block
of 65,536 groups and fetches the few blocks in which a probe can cut.

Defined results: null text is a group of its own kind (size 1, null crc); empty text is another group; a very long text is one
group, which sets the capacity if it is larger than an even share; repeated rows are separate rows of one group; groups are
ordered by their text's hash, and rows of a group by doc_id, so equal sizes need no rule; empty input gives an empty result;
columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.common import drop_scratch, materialize

BLOCK = 65_536


def smallest_capacity(total: int, largest: int, n_shards: int, floor_end) -> tuple[int, list[int]]:
    """The least capacity that n_shards greedy shards can hold, and the cuts (prefix sums) there.

    floor_end(x) is the largest prefix sum at most x. With capacity total/n + largest, every greedy shard but the last
    holds total/n or more, so the upper end is always feasible.
    """

    def cuts(capacity: int) -> list[int]:
        out, at = [], 0
        for _ in range(n_shards):
            at = floor_end(at + capacity)
            out.append(at)
        return out

    lo = max(-(-total // n_shards), largest)
    hi = lo + largest
    while lo < hi:
        mid = (lo + hi) // 2
        if cuts(mid)[-1] == total:
            hi = mid
        else:
            lo = mid + 1
    return lo, cuts(lo)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition sorted by key: running bytes and rows."""
    size = rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        s = np.cumsum(b.column(1).to_numpy(zero_copy_only=False)) + size
        r = np.cumsum(b.column(2).to_numpy(zero_copy_only=False)) + rows
        size, rows = int(s[-1]), int(r[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.int64()), pa.array(r, pa.int64()), b.column(1)], names=["key", "size_end", "rows_end", "size"])


class _Prefix:
    """Prefix sums over the ordered groups, fetched from their table block by block."""

    def __init__(self, groups: DataFrame):
        self.table = groups.select("key", "size_end", "rows_end", F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / BLOCK).alias("block"))
        sums = self.table.groupBy("file", "block").agg(F.max("size_end").alias("size_end"), F.max("rows_end").alias("rows_end")).collect()
        sums.sort(key=lambda r: (_part(r.file), r.block))
        self.blocks, self.ends, self.bases = [], [], []
        size = rows = 0
        for i, r in enumerate(sums):
            if i and r.file != sums[i - 1].file:
                size, rows = size + sums[i - 1].size_end, rows + sums[i - 1].rows_end
            self.blocks.append((r.file, r.block))
            self.bases.append((size, rows))
            self.ends.append(size + r.size_end)
        self.total = self.ends[-1] if self.ends else 0
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, list[str]]] = {}

    def block(self, i: int):
        if i not in self.cache:
            file, block = self.blocks[i]
            got = self.table.where((F.col("file") == file) & (F.col("block") == block)).select("key", "size_end", "rows_end").toPandas().sort_values("size_end")
            size, rows = self.bases[i]
            self.cache[i] = (got["size_end"].to_numpy() + size, got["rows_end"].to_numpy() + rows, got["key"].tolist())
        return self.cache[i]

    def floor_end(self, x: int) -> int:
        if x >= self.total:
            return self.total
        i = int(np.searchsorted(self.ends, x, side="right"))
        ends = self.block(i)[0]
        j = int(np.searchsorted(ends, x, side="right"))
        return int(ends[j - 1]) if j else (self.ends[i - 1] if i else 0)

    def at(self, end: int) -> tuple[str, int]:
        """Key and rows up to the group that ends at `end`."""
        i = int(np.searchsorted(self.ends, end, side="left"))
        ends, rows, keys = self.block(i)
        j = int(np.searchsorted(ends, end, side="left"))
        return keys[j], int(rows[j])


def _part(file: str) -> int:
    return int(file.split("-")[1])


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text")).alias("text_crc32"),
        F.coalesce(F.substring(F.sha2("text", 256), 1, 32), F.lit("")).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    # doc_id in the range key lets a large group span partitions
    ordered = materialize(rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id"), "shard-order")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    groups = groups.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_running, "key string, size_end long, rows_end long, size long")
    groups = materialize(groups, "shard-groups")
    largest = groups.agg(F.max("size")).first()[0]
    shard, start = F.lit(0), F.lit(0)
    if largest:
        prefix = _Prefix(groups)
        _, ends = smallest_capacity(prefix.total, largest, n_shards, prefix.floor_end)
        for k, end in enumerate(sorted({e for e in ends if 0 < e < prefix.total}), 1):
            key, n = prefix.at(end)
            shard = F.when(F.col("key") > key, k).otherwise(shard)
            start = F.when(F.col("key") > key, n).otherwise(start)
    drop_scratch(spark, rows, groups)
    placed = ordered.select("doc_id", "size", "text_crc32", "key", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = sorted(((r.file, r.n) for r in placed.groupBy("file").agg(F.count("*").alias("n")).collect()), key=lambda r: _part(r[0]))
    bases = np.concatenate([[0], np.cumsum([n for _, n in files])]) if files else []
    # one row per written file
    base = spark.createDataFrame([(f, int(b)) for (f, _), b in zip(files, bases, strict=False)], "file string, base long")
    return placed.join(F.broadcast(base), "file").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("base") + F.col("at") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

