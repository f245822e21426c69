"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: each of its rows is a segment of about a quarter of a million tokens that holds, for
every term of its documents, the ascending list of positions (delta coded). Building it reads the corpus once and
shuffles nothing.

The benchmark is read once and dealt into blocks of at most BLOCK_BYTES of word hashes, each of which is sent to the executors.
For a block, the terms' frequencies in the whole index are summed first: a window with a term that the corpus lacks is
dropped, and every other window is filed under its rarest term. A segment then looks at the windows filed under its own
terms only: the postings of the rarest term are shifted to the phrase's start, and those stay that the offset-adjusted
postings of the other terms, rarer ones first, also hold. Proximity queries use the same postings. With more than one block,
hits meet again by document.

Words are compared by 64-bit hashes, a window by those of all its words.

Defined results: null, empty and wordless texts have no words and no hits; very long texts are read whole; a benchmark item
without words has no window; an item whose id is null marks words but is not listed; repeated item ids count once; repeated
documents are separate rows; terms of equal frequency are taken in the window's order, which changes no result; an empty
benchmark leaves every document clean, and empty documents give an empty result; columns other than doc_id, item_id and text
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.common import U64, drop_scratch, fresh, materialize, mix64, rows_of, scratch_path, text_chunks, word_hashes

WINDOW = 10
#: Bytes of word hashes that are sent to the executors at once. With places and windows they grow about fourfold.
BLOCK_BYTES = 32_000_000
#: Words of one piece of a benchmark item; pieces overlap, so that no window is lost.
PIECE_WORDS = 1_000_000
#: Positions that a segment follows at once.
FOLLOW = 2_000_000
INDEX_SCHEMA = "terms binary, starts binary, deltas binary, doc_ids array<long>, doc_hashes array<long>, doc_starts binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "h"))
        for i, j, data, off in text_chunks(batch):
            words, prefix = word_hashes(data, off, "alnum")
            # documents are one position apart, so no phrase runs across two
            at = np.arange(len(words), dtype=np.int64) + rows_of(prefix)
            order = np.argsort(words, kind="stable")
            terms, first = np.unique(words[order], return_index=True)
            pos = at[order]
            deltas = np.diff(pos, prepend=0)
            deltas[first] = pos[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([np.append(first, len(words)).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([deltas.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())),
                    pa.array([hashes[i:j].to_pylist()], pa.list_(pa.int64())),
                    pa.array([(prefix + np.arange(len(prefix))).astype(np.int64).tobytes()], pa.binary()),
                ],
                names=["terms", "starts", "deltas", "doc_ids", "doc_hashes", "doc_starts"],
            )


def build_index(docs: DataFrame) -> DataFrame:
    """Write the positional index of docs (doc_id, text) to the shared folder; one row per segment."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(_segments, INDEX_SCHEMA), "positional-index", compression="zstd")


class Windows:
    """The different windows of one benchmark block that the corpus may hold, filed under their rarest terms.

    words: the items' words, piece after piece; place and length: where a window begins in them; order: its words' offsets,
    rarest first, -1 beyond its length; pair_window, pair_item: whose windows they are, sorted by window.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, item: np.ndarray, window: int, terms: np.ndarray, count: np.ndarray):
        frequency = count[np.searchsorted(terms, words)] if len(terms) else np.zeros(len(words), np.int64)
        n = np.diff(np.append(0, ends))
        piece = np.repeat(np.arange(len(n)), n)
        left = ends[piece] - np.arange(len(words))
        length = np.minimum(window, n)
        place = np.flatnonzero(left >= length[piece])
        length, owner = length[piece[place]], item[piece[place]]
        freq = np.full((len(place), window), np.iinfo(np.int64).max)
        key = length.astype(U64)
        with np.errstate(over="ignore"):
            for j in range(window):
                in_ = length > j
                freq[in_, j] = frequency[place[in_] + j]
                key[in_] = mix64(key[in_] * U64(0x9E3779B97F4A7C15) + words[place[in_] + j])
        alive = np.flatnonzero(freq.min(axis=1, initial=1) > 0) if len(place) else np.zeros(0, np.int64)
        place, length, owner, freq, key = place[alive], length[alive], owner[alive], freq[alive], key[alive]
        _, one, of = np.unique(key, return_index=True, return_inverse=True)
        of = of.ravel()
        for j in range(window):  # equal keys of different windows: these stay by themselves
            in_ = length > j
            odd = in_ & (words[place * in_ + j * in_] != words[place[one[of]] * in_ + j * in_])
            if odd.any():
                bad = np.flatnonzero(odd)
                of[bad] = len(one) + np.arange(len(bad))
                one = np.append(one, bad)
        order = np.argsort(freq[one], axis=1, kind="stable")
        order[np.arange(window)[None, :] >= length[one][:, None]] = -1
        rare = words[place[one] + order[:, 0]] if len(one) else np.zeros(0, U64)
        by = np.argsort(rare, kind="stable")
        self.words, self.place, self.length, self.order = words, place[one][by], length[one][by], order[by].astype(np.int8)
        self.rare_terms, starts = np.unique(rare[by], return_index=True)
        self.rare_starts = np.append(starts, len(by))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        pairs = np.unique(np.stack([rank[of], owner], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.pair_window, self.pair_item = pairs[:, 0], pairs[:, 1]


class Segment:
    """One row of the index, ready for search."""

    def __init__(self, terms: bytes, starts: bytes, deltas: bytes, doc_starts: bytes):
        self.terms = np.frombuffer(terms, U64)
        self.starts = np.frombuffer(starts, np.int32).astype(np.int64)
        self.count = np.diff(self.starts)
        deltas_ = np.frombuffer(deltas, np.int32).astype(np.int64)
        run = np.cumsum(deltas_)
        base = run[self.starts[:-1]] - deltas_[self.starts[:-1]] if len(deltas_) else np.zeros(0, np.int64)
        self.pos = run - np.repeat(base, self.count)
        self.key = (np.repeat(np.arange(len(self.terms)), self.count) << 36) | self.pos
        self.doc_starts = np.frombuffer(doc_starts, np.int64)

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each term and the length of its postings (0 if absent)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.count[at], 0)

    def has(self, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        key = (term << 36) | pos
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (pos >= 0)

    def phrases(self, block: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of every occurrence of a block's windows."""
        at, n = self.lookup(block.rare_terms)
        here = np.flatnonzero(n)
        lo, hi = block.rare_starts[here], block.rare_starts[here + 1]
        size = np.repeat(n[here], hi - lo)
        w = np.repeat(lo, hi - lo) + np.arange(len(size)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        first = np.repeat(self.starts[at[here]], hi - lo)
        found_w, found_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        share = np.cumsum(size) // FOLLOW
        for k in np.unique(share):  # the windows of the segment's terms, so many postings at a time
            some = np.flatnonzero(share == k)
            v = np.repeat(w[some], size[some])
            within = np.arange(len(v)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            start = self.pos[np.repeat(first[some], size[some]) + within] - block.order[v, 0]
            for j in range(1, block.order.shape[1]):
                o = block.order[v, j]
                more = np.flatnonzero(o >= 0)  # shorter windows are through
                if not len(more):
                    break
                term, there = self.lookup(block.words[block.place[v[more]] + o[more]])
                keep = np.ones(len(v), bool)
                keep[more] = (there > 0) & self.has(term, start[more] + o[more])
                v, start = v[keep], start[keep]
            found_w.append(v)
            found_start.append(start)
        return np.concatenate(found_w), np.concatenate(found_start)

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Starts of the places where all terms occur within `span` positions of one document, rarest term's postings first."""
        at, n = self.lookup(terms)
        if not (n > 0).all():
            return np.zeros(0, np.int64)
        order = np.argsort(n, kind="stable")
        lists = [self.pos[self.starts[at[o]] : self.starts[at[o]] + n[o]] for o in order]
        found = []
        for p in lists[0]:
            doc = np.searchsorted(self.doc_starts, p, side="right") - 1
            lo, hi = max(self.doc_starts[doc], p - span + 1), min(self.doc_starts[doc + 1] - 1, p + span)
            others = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists[1:]]
            if any(not len(x) for x in others):
                continue
            for s in sorted({p, *(y for x in others for y in x if y <= p)}):
                if all(((x >= s) & (x < s + span)).any() for x in others) and s <= p < s + span:
                    found.append(int(s))
        return np.unique(np.array(found, np.int64))


def words_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), "alnum")[0]


HITS_SCHEMA = "doc_id long, h long, n_words long, spans binary, items array<string>, segment long, row long"


def _search(bench):
    """Search every segment for the windows of one benchmark block (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names = bench.value
        for batch in batches:
            for r in range(batch.num_rows):
                terms, starts, deltas, doc_ids, doc_hashes, doc_starts, segment = (batch.column(c)[r] for c in range(7))
                seg = Segment(terms.as_py(), starts.as_py(), deltas.as_py(), doc_starts.as_py())
                ds = seg.doc_starts
                n_docs = len(ds) - 1
                w, start = seg.phrases(block)
                doc = np.searchsorted(ds, start, side="right") - 1
                hit = np.unique(np.stack([doc, w], axis=1), axis=0)
                lo = np.searchsorted(block.pair_window, hit[:, 1], side="left")
                n = np.searchsorted(block.pair_window, hit[:, 1], side="right") - lo
                item_doc = np.repeat(hit[:, 0], n)
                item_no = block.pair_item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                spans: list[bytes] = [b""] * n_docs
                items: list[list[str]] = [[] for _ in range(n_docs)]
                if len(w):
                    d, b, e = doc, start - ds[doc], start - ds[doc] + block.length[w]
                    order = np.lexsort((b, d))
                    d, b, e = d[order], b[order], e[order]
                    cut = np.flatnonzero(np.diff(d)) + 1
                    for x in np.split(np.arange(len(d)), cut):
                        spans[d[x[0]]] = merge(np.stack([b[x], e[x]], axis=1)).tobytes()
                    for k, i in sorted(set(zip(item_doc.tolist(), item_no.tolist(), strict=True))):
                        if names[i] is not None:
                            items[k].append(names[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids.as_py(), pa.int64()),
                        pa.array(doc_hashes.as_py(), pa.int64()),
                        pa.array(np.diff(ds) - 1, pa.int64()),
                        pa.array(spans, pa.binary()),
                        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                        pa.array([segment.as_py()] * n_docs, pa.int64()),
                        pa.array(np.arange(n_docs), pa.int64()),
                    ],
                    names=["doc_id", "h", "n_words", "spans", "items", "segment", "row"],
                )

    return run


def merge(spans: np.ndarray) -> np.ndarray:
    """Union of [begin, end) rows, ascending."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1).astype(np.int64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words and item digests from spans and items; spans of several blocks are merged."""
    for b in batches:
        hit, digest = [], []
        for spans in b.column("spans"):
            raw = np.concatenate([np.frombuffer(x, np.int64) for x in spans.as_py()] or [np.zeros(0, np.int64)]).reshape(-1, 2)
            hit.append(int(np.diff(merge(raw), axis=1).sum()) if len(raw) else 0)
        names = [sorted(set(x)) for x in b.column("items").to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _item_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                words = words_of(text.as_py())
                for k in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[k : k + PIECE_WORDS + window - 1]
                    if len(piece):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([piece.tobytes()], pa.binary())], names=["item_id", "words"])

    return run


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list]:
    """The items' words (item_id, words), block by block; the benchmark is read once."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    words = materialize(bench.mapInArrow(_item_words(window), "item_id string, words binary"), "benchmark-words")
    size = words.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    if blocks == 1:
        yield words.collect()
        drop_scratch(spark, words)
        return
    path = scratch_path(spark, "benchmark-blocks")
    words.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    drop_scratch(spark, words)
    dealt = spark.read.schema("item_id string, words binary, block int").parquet(path)
    for k in range(blocks):
        yield dealt.where(F.col("block") == k).select("item_id", "words").collect()


def _term_counts(bench):
    """Occurrences of a block's terms (a broadcast, ascending) in the segments that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = bench.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for raw, starts in zip(batch.column(0), batch.column(1), strict=True):
                own, n = np.frombuffer(raw.as_buffer(), U64), np.diff(np.frombuffer(starts.as_buffer(), np.int32))
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                if len(own):
                    total += np.where(own[at] == terms, n[at], 0)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(total[here], pa.int64())], names=["term", "n"])

    return run


def search_phrases(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of the index: doc_id, h, n_words, spans (hit word spans, by benchmark block), items (ids found)."""
    context = index.sparkSession.sparkContext
    index = index.withColumn("segment", F.monotonically_increasing_id())
    found = []
    for rows in _blocks(benchmark, window):
        words = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r.words, U64) for r in rows)])
        ends = np.cumsum([len(r.words) // 8 for r in rows]).astype(np.int64)
        names = sorted({r.item_id for r in rows if r.item_id is not None}) + [None]
        number = {name: k for k, name in enumerate(names)}
        terms = np.unique(words)
        # no more rows than the block has terms
        sums = index.select("terms", "starts").mapInArrow(_term_counts(context.broadcast(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        count = np.zeros(len(terms), np.int64)
        count[sums["term"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
        block = Windows(words, ends, np.array([number[r.item_id] for r in rows], np.int64), window, terms, count)
        hits = index.mapInArrow(_search(context.broadcast((block, names))), HITS_SCHEMA)
        found.append(hits if not found else hits.where(F.octet_length("spans") > 0))
    if len(found) == 1:
        return found[0].select("doc_id", "h", "n_words", F.array("spans").alias("spans"), "items")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("segment", "row", "doc_id", "h", "n_words").agg(F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items")).drop("segment", "row")


def search_near(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """Proximity matches: doc_id and the word position where a place begins in which all words occur within `span` words."""
    query = np.concatenate([words_of(t) for t in terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                terms_, starts, deltas, doc_ids, _, doc_starts = (batch.column(c)[r].as_py() for c in range(6))
                seg = Segment(terms_, starts, deltas, doc_starts)
                at = seg.near(query, span)
                doc = np.searchsorted(seg.doc_starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(at - seg.doc_starts[doc], pa.int64())], names=["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text)."""
    index = build_index(docs)
    hits = search_phrases(index, benchmark, window)
    out = materialize(hits.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"), "contamination")
    drop_scratch(docs.sparkSession, index)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit, columns unchanged. Rows are told apart by doc_id and text, so one with another text stays."""
    index = build_index(docs)
    doc, h, own = fresh(docs.columns, "bad_id", "bad_h", "text_h")
    found = search_phrases(index, benchmark, window).where(F.exists("spans", lambda s: F.octet_length(s) > 0))
    bad = materialize(found.select(F.col("doc_id").alias(doc), F.col("h").alias(h)).distinct(), "contaminated")
    drop_scratch(docs.sparkSession, index)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(h))
    return docs.withColumn(own, F.xxhash64("text")).join(bad, same, "left_anti").drop(own)
