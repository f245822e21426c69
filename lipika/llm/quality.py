"""Quality rules by line sequence labelling.

A linear-chain conditional random field over the lines of a document marks each as content or boilerplate; Viterbi
decoding gives the best sequence, and the share of words in content lines decides whether the document stays. The field is
trained here, by gradient ascent on the conditional likelihood, on a bounded sample of documents (the SAMPLE_DOCS with the
smallest id hashes, of texts up to SAMPLE_BYTES). Its labels say nothing of the features: the lines of a document that people
labelled as good are content, those of one labelled as bad are boilerplate. Without labelled documents, the base rules' verdict
on whole documents labels their lines. Everything else reads every whole text.

Defined results: a null or empty text has no words and fails the base rules; very long texts are judged whole; a document
without lines that hold words has content share 0; repeated rows are scored alike, and learned from once; labels that
contradict each other count as the better one; of equally probable sequences the one with boilerplate is taken; an empty table
gives an empty result; columns other than doc_id and text are not read, and kept_documents returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import SAMPLE_ROOM, U64, bounded_batches, drop_scratch, hash_place, materialize, mix64, rows_of, text_chunks, word_bounds, word_hashes

#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 32_768
#: Share of words in content lines from which a document stays.
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5
SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture and legal lines that one feature looks for, in lower case.
FURNITURE = [b"all rights reserved", b"licensed under", b"license", b"copyright", b"cookie", b"privacy policy", b"terms of use", b"subscribe", b"sign in", b"log in", b"click here", b"read more", b"share this", b"javascript"]
STEPS, RATE, L2 = 150, 0.2, 1e-3


class Lines:
    """Per-line counts of a run of texts, vectorised over bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        self.n_rows = n
        # every row has a line that starts at its first byte; a line may be empty
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([off[:-1], breaks + 1])
        row = np.concatenate([np.arange(n), np.searchsorted(off, breaks, side="right") - 1])
        order = np.lexsort((starts, row))
        self.start, self.row = starts[order], row[order]
        self.end = np.append(self.start[1:], off[-1] if n else 0)
        last = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        self.end = np.where(last, off[self.row + 1] if n else 0, self.end - 1)
        self.first, self.last = np.append(True, last[:-1]) if len(last) else last, last
        ws, we = word_bounds(data, off, "space")
        self.words_start, self.words_end = ws, we
        self.words = np.searchsorted(ws, self.end) - np.searchsorted(ws, self.start)
        char = (data & 0xC0) != 0x80
        upper = (data >= 65) & (data <= 90)
        lower = (data >= 97) & (data <= 122)
        digit = (data >= 48) & (data <= 57)
        symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
        shout = data == 33
        stop = (data == 46) | (data == 44) | (data == 59)
        high = (data >= 0xC3)
        self.chars, self.upper, self.lower, self.digits, self.symbols, self.shouts, self.stops, self.high = (self._sum(x) for x in (char, upper, lower, digit, symbol, shout, stop, high))
        self.pipes = self._sum(data == 124)

    def _sum(self, flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return total[self.end] - total[self.start]


FEATURES = ["bias", "no_words", "words_1_2", "words_3_5", "words_6_20", "words_21", "symbols_some", "symbols_many", "shouts", "upper", "digits_many", "few_letters", "pipes", "repeats_some", "repeats_many", "seen_before", "furniture", "ends_stop", "first", "last", "long_words", "stops"]


def line_features(data: np.ndarray, lines: Lines, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 features of every line, and whether it equals an earlier line of its row (lines with words only)."""
    n = lines.words
    w = np.maximum(n, 1)
    letters = lines.upper + lines.lower + lines.high
    # words that equal one of the three before them in the line
    same = np.zeros(len(words), bool)
    owner = np.repeat(np.arange(len(n)), n)
    for k in (1, 2, 3):
        if len(words) > k:
            same[k:] |= (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
    repeats = np.bincount(owner[same], minlength=len(n))
    seen: set[bytes] = set()
    dup = np.zeros(len(n), bool)
    furniture = np.zeros(len(n), bool)
    raw = data.tobytes()
    low = raw.lower()
    at_row = -1
    for i, (r, s, e, k) in enumerate(zip(lines.row.tolist(), lines.start.tolist(), lines.end.tolist(), n.tolist(), strict=True)):
        if r != at_row:
            seen, at_row = set(), r
        if k:
            line = raw[s:e]
            if line in seen:
                dup[i] = True
            else:
                seen.add(line)
            if k <= 25:
                text = low[s:e]
                furniture[i] = any(x in text for x in FURNITURE)
    stop = np.zeros(len(n), bool)
    full = lines.end > lines.start
    stop[full] = np.isin(data[lines.end[full] - 1], np.frombuffer(b".!?\"'", np.uint8)) if len(data) else False
    x = np.stack(
        [
            np.ones(len(n), bool),
            n == 0,
            (n >= 1) & (n <= 2),
            (n >= 3) & (n <= 5),
            (n >= 6) & (n <= 20),
            n >= 21,
            lines.symbols * 20 > w,
            lines.symbols * 3 > w,
            lines.shouts * 4 > w,
            (lines.upper * 2 > letters) & (n >= 3),
            lines.digits * 4 > lines.chars,
            (letters * 2 < lines.chars) & (n > 0),
            lines.pipes > 2,
            repeats * 10 > w * 2,
            repeats * 10 > w * 5,
            dup,
            furniture,
            stop,
            lines.first,
            lines.last,
            lines.chars > 15 * w,
            lines.stops * 40 > w,
        ],
        axis=1,
    )
    return x, dup


# --- the field --------------------------------------------------------------------------------


def _padded(row_start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step through chains laid end to end: (chains alive, their line at this step)."""
    length = np.diff(row_start)
    order = np.argsort(-length, kind="stable")
    length_sorted = length[order]
    t = 0
    while True:
        alive = int(np.searchsorted(-length_sorted, -t, side="left"))
        if not alive:
            return
        yield order[:alive], row_start[:-1][order[:alive]] + t
        t += 1


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(x: np.ndarray, y: np.ndarray, row_start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and transitions (2, 2) that maximise the regularised conditional likelihood."""
    xf = x.astype(float)
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moment = [np.zeros_like(w), np.zeros_like(trans), np.zeros_like(w), np.zeros_like(trans)]
    chains = list(_padded(row_start))
    inner = np.ones(len(x), bool)
    inner[row_start[:-1][np.diff(row_start) > 0]] = False
    into = np.flatnonzero(inner)
    gold_w = xf.T @ np.eye(2)[y]
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (y[into - 1], y[into]), 1)
    for step in range(1, steps + 1):
        s = xf @ w
        fwd, bwd = s.copy(), np.zeros_like(s)
        for k, (_, at) in enumerate(chains):
            if k:
                fwd[at] = s[at] + _lse(fwd[at - 1][:, :, None] + trans[None], 1)
        for k in range(len(chains) - 1, 0, -1):
            at = chains[k][1]
            bwd[at - 1] = _lse(trans[None] + (s[at] + bwd[at])[:, None, :], 2)
        z = _lse(fwd + bwd, 1)
        node = np.exp(fwd + bwd - z[:, None])
        edge = np.exp(fwd[into - 1][:, :, None] + trans[None] + (s[into] + bwd[into])[:, None, :] - z[into][:, None, None]).sum(axis=0)
        grads = [(gold_w - xf.T @ node) / len(x) - L2 * w, (gold_t - edge) / len(x) - L2 * trans]
        for i, (p, g) in enumerate(zip((w, trans), grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            moment[i + 2] = 0.999 * moment[i + 2] + 0.001 * g * g
            p += RATE * (moment[i] / (1 - 0.9**step)) / (np.sqrt(moment[i + 2] / (1 - 0.999**step)) + 1e-8)
    return w, trans


def viterbi(x: np.ndarray, row_start: np.ndarray, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The most probable label of every line, chains side by side."""
    s = x.astype(float) @ w
    best, back = s.copy(), np.zeros(s.shape, np.int8)
    chains = list(_padded(row_start))
    for k, (_, at) in enumerate(chains):
        if k:
            cand = best[at - 1][:, :, None] + trans[None]
            back[at] = cand.argmax(axis=1)
            best[at] = s[at] + cand.max(axis=1)
    y = np.zeros(len(x), np.int64)
    ends = row_start[1:][np.diff(row_start) > 0] - 1
    y[ends] = best[ends].argmax(axis=1)
    for k in range(len(chains) - 1, 0, -1):
        at = chains[k][1]
        y[at - 1] = back[at, y[at]]
    return y


# --- documents --------------------------------------------------------------------------------


def _repeat_words(words: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Per row: words inside three-word windows that occur twice or more in the row."""
    row = rows_of(prefix)
    left = prefix[1:][row] - np.arange(len(words))
    at = np.flatnonzero(left >= 3)
    hit = np.zeros(len(words), bool)
    if len(at):
        with np.errstate(over="ignore"):
            h = mix64(mix64(mix64(words[at] + row[at].astype(U64) * U64(0x9E3779B97F4A7C15)) + words[at + 1]) + words[at + 2])
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            k = at[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
            for j in range(3):
                hit[k + j] = True
    return np.bincount(row[hit], minlength=len(prefix) - 1)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def _by_row(lines: Lines, value: np.ndarray) -> np.ndarray:
    return np.bincount(lines.row, weights=value, minlength=lines.n_rows).astype(np.int64)


def _fails(n: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """The base rules, from words and repeated words."""
    return (n < MIN_WORDS) | (100 * repeat > 100 * MAX_REPEAT_SHARE * n)


def _judge(ids: pa.Array, i: int, j: int, data: np.ndarray, off: np.ndarray, model) -> list:
    """The columns of SCHEMA for rows i to j of a batch."""
    words, prefix = word_hashes(data, off, "space")
    lines = Lines(data, off)
    x, dup = line_features(data, lines, words)
    n = np.diff(prefix)
    y = viterbi(x, np.searchsorted(lines.row, np.arange(lines.n_rows + 1)), *model)
    total = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = np.append(0, np.cumsum(total[lines.words_end] - total[lines.words_start]))
    repeat = _repeat_words(words, prefix)
    share = _by_row(lines, lines.words * y) / np.maximum(n, 1)
    failed = _fails(n, repeat)
    has = lines.words > 0
    return [ids[i:j], n, chars[prefix[1:]] - chars[prefix[:-1]], _by_row(lines, lines.symbols), _by_row(lines, dup), repeat, failed, ~failed & (share >= MIN_CONTENT), share, _by_row(lines, has), _by_row(lines, has & (y == 1))]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for i, j, data, off in text_chunks(batch, limit=1_000_000):
                cols = _judge(batch.column(0), i, j, data, off, model)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return run


def _keep(model, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_judge(batch.column(text), i, j, data, off, model)[7] for i, j, data, off in text_chunks(batch, limit=1_000_000)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return run


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' lines as bits of their features, and whether the base rules fail the document."""
    for batch in batches:
        bits, failed = [], []
        for i, j, data, off in text_chunks(batch, limit=1_000_000):
            words, prefix = word_hashes(data, off, "space")
            lines = Lines(data, off)
            x, _ = line_features(data, lines, words)
            packed = (x.astype(np.uint32) << np.arange(x.shape[1], dtype=np.uint32)).sum(axis=1).astype(np.uint32)
            cut = np.searchsorted(lines.row, np.arange(j - i + 1))
            bits += [packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            failed += _fails(np.diff(prefix), _repeat_words(words, prefix)).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), pa.array(failed, pa.bool_())], names=["good", "bits", "failed"])


def _sample(docs: DataFrame, of: DataFrame) -> list:
    """Examples of at most SAMPLE_DOCS documents of those that `of` (doc_id, good) names."""
    n = of.count()
    place = hash_place("doc_id")
    ids = of.where(place < SAMPLE_ROOM * SAMPLE_DOCS / max(n, 1)).orderBy(place, "doc_id").limit(SAMPLE_DOCS)
    ids = materialize(ids, "quality-sample")
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("text")).join(F.broadcast(ids), "doc_id")
    # a doc_id that repeats brings one text
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("h", "text", "good")).alias("row")).select("row.good", "row.text")
    rows = texts.mapInArrow(_examples, "good boolean, bits binary, failed boolean").collect()
    drop_scratch(docs.sparkSession, ids)
    return sorted(rows, key=lambda r: (r.bits, r.good is None, r.good, r.failed))


def fit(docs: DataFrame, labels: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Train the field on documents that labels (doc_id, quality 0 or 1) cover; without any, on the base rules' verdicts."""
    bounded_batches(docs.sparkSession)
    rows = []
    if labels is not None:
        good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
        rows = _sample(docs, good)
    if not rows:
        rows = _sample(docs, docs.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(None).cast("boolean")))
    n = np.array([len(r.bits) // 4 for r in rows], np.int64)
    if not n.sum():
        return np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint32)
    x = (bits[:, None] >> np.arange(len(FEATURES), dtype=np.uint32) & 1).astype(bool)
    y = np.repeat([int(not r.failed if r.good is None else r.good) for r in rows], n)
    return train(x, y, np.append(0, np.cumsum(n)))


def labels_beside(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels table of a table folder, if it has one."""
    path = f"{sf_dir}/labels.parquet"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there) else None


def quality(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Counts, base rules and the field's verdict of every row of docs (doc_id, text)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_score(fit(docs, labels)), SCHEMA)


def kept_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, all columns unchanged; decided row by row, without a shuffle."""
    return docs.mapInArrow(_keep(fit(docs, labels), docs.columns.index("text")), docs.schema)
