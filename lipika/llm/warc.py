"""Deterministic sharded WARC 1.1 writer and reader.

Pages are sorted by page_id and payload digest and cut into ranges where running sums of their bytes, over the whole order,
fill a range (so reruns write the same files). Each range is rolled into files by compressed size, headers and digests are
regenerated from the payload, and a file is written under a temporary name, then renamed; the manifest names the files that
count. A later attempt of a task overwrites nothing: it writes its own temporary file and renames it onto the same name with
the same bytes.

Records are gzip members of their own. Of records with equal payloads of at least `min_bytes` bytes, the one with the
smallest page_id is a response, the others are revisits without payload that refer to it.

Defined results: null html is an empty payload; empty payloads equal each other; very long payloads are records like others;
of rows that repeat page_id and payload, the one with the smallest url is the response (null first; of equal rows, one of
them), and each has a record id of its own; a null page_id counts as larger than any other and is never referred to; a null
url becomes urn:page:<id>; characters that a header cannot hold are percent-encoded; empty input gives no file and an empty
result; columns other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import drop_path, drop_scratch, materialize, part_number, scratch_path

#: A file is closed once its compressed bytes reach this.
ROLL_BYTES = 8_000_000
#: Payload bytes meant for one range (a task's share); of larger corpora, a range holds more, so that MAX_RANGES are enough.
RANGE_BYTES, MAX_RANGES = 16_000_000, 100_000
#: What a record takes beside its payload.
RECORD_BYTES = 500
#: Stands for no page_id in the order.
LAST_ID = 2**63 - 1
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, shard int, part int, records long, first_id long, last_id long, bytes long, sha256 string"
ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string, offset long, intact boolean"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder (file, HDFS, S3, GCS or ABFS)."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, url: str | None, sha1: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{sha1}|{number}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: str, number: int, refers_to: tuple[int, str | None] | None) -> bytes:
    """One record; number: of rows that are equal, which one; refers_to: page_id and url of the response, if this is a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_record_id(page_id, url, sha1, number)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(page_id, url)}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(*refers_to, sha1, 0)}",
            f"WARC-Refers-To-Target-URI: {_target(*refers_to)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"WARC-Refers-To-Page: {refers_to[0]}",
        ]
    lines += [f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _target(page_id: int | None, url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._") if url else f"urn:page:{'' if page_id is None else page_id}"


class _Roller:
    """Writes one range's records to files of about ROLL_BYTES, each under a temporary name until it is whole."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.dir = filesystem(root)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None

    def add(self, page_id: int | None, member: bytes) -> list[tuple]:
        if self.out is None:
            self.name = f"{self.shard:06d}-{self.part:05d}.warc.gz"
            self.tmp = f"{self.dir}/_tmp-{self.name}-{uuid.uuid4().hex}"
            self.out, self.sha, self.size, self.n, self.first = self.fs.open_output_stream(self.tmp, compression=None), hashlib.sha256(), 0, 0, page_id
        self.out.write(member)
        self.sha.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id
        return self.close() if self.size >= self.roll else []

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.fs.move(self.tmp, f"{self.dir}/{self.name}")
        self.out, row = None, (self.name, self.shard, self.part, self.n, self.first, self.last, self.size, self.sha.hexdigest())
        self.part += 1
        return [row]


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (shard, page_id, payload, kind, url); a shard, and equal rows, are whole within a task.

        A row of kind 0 precedes the rows of a page and payload and names the payload's response, by page_id and url; payloads
        that none precedes are unlike all others.
        """
        roller, at, response, seen = None, object(), None, {}
        for b in batches:
            rows: list[tuple] = []
            for shard, page_id, kind, url, html, sha1, size, keeper in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if (page_id, sha1, size) != at:
                    at, response, seen = (page_id, sha1, size), None, {}
                if not kind:
                    response = (keeper, url)
                    continue
                if roller is None or roller.shard != shard:
                    rows += roller.close() if roller else []
                    roller = _Roller(root, shard, roll)
                revisit = response is not None and (page_id != response[0] or bool(seen))
                seen[url] = seen.get(url, -1) + 1
                sha1_32 = base64.b32encode(bytes.fromhex(sha1)).decode()
                rows += roller.add(page_id, _member(_record(page_id, url, (html or "").encode(), sha1_32, seen[url], response if revisit else None)))
            if rows:
                yield _manifest_batch(rows)
        if roller and (rows := roller.close()):
            yield _manifest_batch(rows)

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running bytes within a sorted partition."""
    full = 0
    for b in batches:
        if b.num_rows:
            ends = np.cumsum(b.column(2).to_numpy(zero_copy_only=False)) + full
            full = int(ends[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.int64())], names=["k1", "k2", "full"])


def _bounds(sums: DataFrame, target: int) -> tuple[np.ndarray, np.ndarray]:
    """The last keys of all ranges but the last: where `target` bytes are full in the order of all keys (k1, k2) of sums
    (k1, k2, bytes). A key, that is, a page_id and payload, stays whole. The driver sees one sum of each written file, and at
    most MAX_RANGES keys.
    """
    spark = sums.sparkSession
    keys = sums.groupBy("k1", "k2").agg(F.sum("bytes").alias("bytes"))
    ordered = materialize(keys.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_running, "k1 long, k2 long, full long"), "warc-order")
    places = ordered.select("k1", "k2", "full", F.col("_metadata.file_name").alias("file"))
    files = sorted(((r.file, r.full) for r in places.groupBy("file").agg(F.max("full").alias("full")).collect()), key=lambda r: part_number(r[0]))
    bases = np.concatenate([[0], np.cumsum([n for _, n in files])]).astype(np.int64)
    target = max(target, -(-int(bases[-1]) // MAX_RANGES), 1)
    base = spark.createDataFrame([(f, int(n)) for (f, _), n in zip(files, bases, strict=False)], "file string, base long")
    ranges = places.join(F.broadcast(base), "file").groupBy(F.floor((F.col("base") + F.col("full") - 1) / target).alias("range")).agg(F.max(F.struct("k1", "k2")).alias("last"))
    last = [(r.k1, r.k2) for r in ranges.orderBy("range").select("last.*").collect()][:-1]
    drop_scratch(spark, ordered)
    return np.array([k for k, _ in last], np.int64), np.array([k for _, k in last], np.int64)


def range_of(k1: np.ndarray, k2: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of bounds below each key."""
    lo, hi = (np.searchsorted(bounds[0], k1, side=s) for s in ("left", "right"))
    out = lo.copy()
    for at in np.unique(lo[hi > lo]):  # a page_id that is cut by its payloads
        some = np.flatnonzero((lo == at) & (hi > lo))
        out[some] += np.searchsorted(bounds[1][at : hi[some[0]]], k2[some], side="left")
    return out


def _shard(spark: SparkSession, bounds: tuple[np.ndarray, np.ndarray]) -> Column:
    if not len(bounds[0]):
        return F.lit(0)
    sent = spark.sparkContext.broadcast(bounds)  # MAX_RANGES keys at most

    @F.pandas_udf("int")
    def place(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(range_of(k1.to_numpy(), k2.to_numpy(), sent.value), dtype="int32")

    return place("k1", "k2")


def write_warc(pages: DataFrame, root: str, min_bytes: int = 0, roll: int = ROLL_BYTES, target: int = RANGE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) under root; returns the committed manifest."""
    spark = pages.sparkSession
    filesystem(root)[0].create_dir(filesystem(root)[1], recursive=True)
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    src = src.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")))).withColumn("bytes", size)
    # the order: by page_id, those without last, then by payload
    src = src.withColumn("k1", F.coalesce("page_id", F.lit(LAST_ID))).withColumn("k2", F.xxhash64("sha1", F.col("page_id").isNull()))
    # the digests of all pages, without the pages
    sums = materialize(src.drop("html"), "warc-digests")
    bounds = _bounds(sums.select("k1", "k2", (F.col("bytes") + RECORD_BYTES).alias("bytes")), target)
    # written down, so that the join is of two plain shuffles and a large group of copies can be split
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    same = sums.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null")
    same = materialize(same.select("sha1", "bytes", F.col("first.page_id").alias("keeper"), F.col("first.url").alias("keeper_url")), "warc-copies")
    # the payloads are shuffled once: what they need to know of their copies comes as rows that sort before them
    shard, none = _shard(spark, bounds).alias("shard"), F.lit(None).cast("string")
    copies = sums.join(same, ["sha1", "bytes"]).select("k1", "k2", "page_id", F.lit(0).alias("kind"), F.col("keeper_url").alias("url"), none.alias("html"), "sha1", "bytes", "keeper").distinct()
    rows = copies.unionByName(src.withColumn("kind", F.lit(1)).withColumn("keeper", F.lit(None).cast("long")))
    rows = rows.select(shard, "page_id", "kind", "url", "html", "sha1", "bytes", "keeper", "k1", "k2").repartitionById(len(bounds[0]) + 1, "shard").sortWithinPartitions("shard", "k1", "k2", "sha1", "kind", "url")
    manifest = commit(rows.mapInArrow(_writer(root, roll), MANIFEST), root)
    drop_scratch(spark, sums, same)
    return manifest


def commit(listed: DataFrame, root: str) -> DataFrame:
    """Run the write, then publish the manifest: written beside, moved last. Files it does not name do not count."""
    spark = listed.sparkSession
    path = f"{root}/_manifest"
    listed.write.parquet(path)  # Spark's own commit: _SUCCESS comes after every task's file
    return spark.read.schema(MANIFEST).parquet(path)


def parse(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset of the gzip member, headers, block) of every record of a .warc.gz stream, one member in memory at a time."""
    held, offset = b"", 0
    while True:
        z = zlib.decompressobj(31)
        parts: list[bytes] = []
        used = 0
        while not z.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    if used:
                        raise ValueError("truncated WARC member")
                    return
            parts.append(z.decompress(held))
            used += len(held) - len(z.unused_data)
            held = z.unused_data
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at {offset}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield offset, headers, rest[: int(headers["Content-Length"])]
        offset += used


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        names = [x.split()[0] for x in ENTRY.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, h, block in parse(stream):
                        number = lambda k: int(h[k]) if h.get(k) else None  # noqa: E731, B023
                        payload = block.partition(b"\r\n\r\n")[2]
                        revisit = h["WARC-Type"] == "revisit"
                        sha1, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                        intact = h["WARC-Block-Digest"] == f"sha1:{digest(block)}" and (revisit or digest(payload) == sha1)
                        if not revisit:
                            size, sha1 = len(payload), digest(payload)
                        rows.append((number("WARC-Page-ID"), size, sha1, h["WARC-Type"], number("WARC-Refers-To-Page"), h["WARC-Target-URI"], None if revisit else payload, name, offset, intact))
                        held += len(payload)
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every record of the files that the manifest names; digests are checked (intact)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    files = manifest.select("file").distinct()
    return files.mapInArrow(_reader(root), ENTRY)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as WARC files in the shared folder and read them back; the files are dropped when all is read."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write_warc(pages, root, min_bytes)
    back = read_warc(spark, root)
    out = materialize(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "offset", "intact"), "warc-read")
    drop_path(spark, root)
    return out
