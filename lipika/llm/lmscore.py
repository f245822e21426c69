"""Subword lattice likelihood of documents.

The pieces of an existing subword vocabulary have unigram scores. Every segmentation of a word into pieces counts: a
forward recursion in log space sums their probabilities, and a document's score is the sum over its words plus the end.
The stored scores are merge ranks, not probabilities; they are read as Zipf-Mandelbrot weights and re-weighted once by the
pieces' expected counts in the training documents' words (all of them). The vocabulary itself stays as it is. Word
frequencies and the rate at which texts end come from the training documents too; they also give the add-one base score.

Layout: one pass turns the corpus into blocks of about BLOCK_BYTES (the block's different words, and its documents as word
numbers). Each different word is counted and scored once over the whole corpus, joined back to the blocks it occurs in,
and each block is summed up by document, with partitions as many as blocks. No word table is sent whole to any executor or to the
driver. A word longer than LONG_WORD bytes goes through the joins as its digest; the recursions hold a few numbers for
each of its bytes.

Defined results: null and empty texts have the end as their only token; very long texts and words are scored whole; a null
doc_id is never held out; repeated rows are counted and scored as often as they occur; ties don't arise, as only sums are
kept; bytes outside the vocabulary fall back to single bytes; an empty table gives an empty result; columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.common import bounded_batches, drop_scratch, gathered, materialize, numbered, text_chunks, word_bounds, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 10_000_000
#: Rows of words that one partition of the join with the word table is meant for.
JOIN_ROWS = 1_000_000
#: Longer words (in bytes) are known by their digest, behind a blank, which no word has.
LONG_WORD = 1024
#: Zipf-Mandelbrot's shift.
SHIFT = 2.7
#: The mark that starts a word in the vocabulary.
START = "▁".encode()


def load_pieces(path: str = VOCABULARY) -> dict[bytes, float]:
    """Natural-log probability of every piece's bytes; single bytes are always there."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: list[tuple[bytes, float]] = []
    n = sp.get_piece_size()
    for i in range(n):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        if sp.is_byte(i):
            ranks.append((bytes([int(sp.id_to_piece(i)[3:5], 16)]), float(n)))
        else:
            ranks.append((sp.id_to_piece(i).encode(), -sp.get_score(i)))
    return normalise(ranks, n)


def normalise(ranks: list[tuple[bytes, float]], last: int) -> dict[bytes, float]:
    weight: dict[bytes, float] = {}
    for piece, rank in [*ranks, *((bytes([b]), float(last)) for b in range(256))]:
        weight[piece] = weight.get(piece, 0.0) + 1 / (rank + SHIFT)
    total = sum(weight.values())
    return {k: math.log(v / total) for k, v in weight.items()}


def prefix_table(pieces: dict[bytes, float]) -> dict[bytes, float | None]:
    """The pieces, and None for byte strings that only begin one."""
    table: dict[bytes, float | None] = {}
    for p in pieces:
        for k in range(1, len(p)):
            table.setdefault(p[:k], None)
    return table | pieces


def _log_sum(t: list[float]) -> float:
    top = max(t)
    return top if len(t) == 1 else top + math.log(sum([math.exp(x - top) for x in t]))


def log_marginal(word: bytes, table: dict[bytes, float | None]) -> float:
    """Log of the summed probability of all segmentations, by forward recursion. Held at a time: the sums that pieces reach."""
    ahead: dict[int, list[float]] = {0: [0.0]}
    n = len(word)
    for i in range(n):
        a = _log_sum(ahead.pop(i))
        for j in range(i + 1, n + 1):
            piece = word[i:j]
            if piece not in table:
                break
            p = table[piece]
            if p is not None:
                ahead.setdefault(j, []).append(a + p)
    return _log_sum(ahead[n]) if n else 0.0


#: Longer words have their expected counts summed in log space, as products of probabilities leave the range.
EXPECT_BYTES = 40
SMOOTHING = 0.1


def expected_counts(words: Iterator[tuple[bytes, int]], table: dict[bytes, float | None]) -> dict[bytes, float]:
    """Expected occurrences of every piece over all segmentations of the counted words (forward-backward)."""
    prob = {k: None if v is None else math.exp(v) for k, v in table.items()}
    out: dict[bytes, float] = {}
    for word, c in words:
        if len(word) > EXPECT_BYTES:
            _expect_long(word, c, table, out)
            continue
        n = len(word)
        fwd = [1.0] + [0.0] * n
        arcs = []
        for i in range(n):
            a = fwd[i]
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in prob:
                    break
                p = prob[piece]
                if p is not None:
                    fwd[j] += a * p
                    arcs.append((i, j, p, piece))
        bwd = [0.0] * n + [1.0]
        scale = c / fwd[n]
        for i, j, p, piece in reversed(arcs):
            x = p * bwd[j]
            bwd[i] += x
            out[piece] = out.get(piece, 0.0) + fwd[i] * x * scale
    return out


def _expect_long(word: bytes, c: int, table: dict[bytes, float | None], out: dict[bytes, float]) -> None:
    n = len(word)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    ahead: dict[int, list[float]] = {0: [0.0]}
    for i in range(n + 1):
        fwd[i] = a = _log_sum(ahead.pop(i))
        for j in range(i + 1, n + 1):
            piece = word[i:j]
            if piece not in table:
                break
            p = table[piece]
            if p is not None:
                ahead.setdefault(j, []).append(a + p)
    for i in range(n - 1, -1, -1):
        arcs = []
        for j in range(i + 1, n + 1):
            piece = word[i:j]
            if piece not in table:
                break
            p = table[piece]
            if p is not None:
                arcs.append((piece, p + bwd[j]))
        bwd[i] = _log_sum([x for _, x in arcs])
        for piece, x in arcs:
            out[piece] = out.get(piece, 0.0) + c * math.exp(fwd[i] + x - fwd[n])


def reweigh(pieces: dict[bytes, float], expected: dict[bytes, float]) -> dict[bytes, float]:
    total = sum(expected.values()) + SMOOTHING * len(pieces)
    return {k: math.log((expected.get(k, 0.0) + SMOOTHING) / total) for k in pieces}


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCKS = "words array<string>, longs array<string>, train array<long>, tokens binary, n_words array<long>, doc_ids array<long>, held array<boolean>"


def pack(number: np.ndarray) -> bytes:
    """32-bit numbers by byte planes."""
    return np.ascontiguousarray(number.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, "text", BLOCK_BYTES):
        ids, held_all = batch.column(0), batch.column(2)
        for i, j, data, off in text_chunks(batch, limit=2 * BLOCK_BYTES):
            h, prefix = word_hashes(data, off, "space_lower")
            starts, ends = word_bounds(data, off, "space_lower")
            low = data.tobytes().translate(_LOWER)
            _, first, number = np.unique(h, return_index=True, return_inverse=True)
            # frequent words get small numbers, which pack well
            order = np.argsort(-np.bincount(number, minlength=len(first)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number, first = rank[number], first[order]
            held = held_all[i:j].to_numpy(zero_copy_only=False).astype(bool)
            n = np.diff(prefix)
            train = np.bincount(number[np.repeat(~held, n)], minlength=len(first))
            words, longs = [], []
            for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
                if e - s > LONG_WORD:
                    longs.append(low[s:e].decode())
                    words.append(" " + hashlib.sha256(low[s:e]).hexdigest())
                else:
                    words.append(low[s:e].decode())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words], pa.list_(pa.string())),
                    pa.array([longs], pa.list_(pa.string())),
                    pa.array([train.astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([pack(number)], pa.binary()),
                    pa.array([n.astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                ],
                names=[c.split()[0] for c in BLOCKS.split(", ")],
            )


def _expect(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(pieces.value)
        rows = ((START + w.encode(), c) for b in batches for w, c in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True))
        got = expected_counts(rows, table)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.float64())], names=["piece", "n"])

    return run


def _lattice(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(pieces.value)
        for b in batches:
            score = [log_marginal(START + w.encode(), table) for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["word", "c", "logp"])

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_up(train_docs: int, train_tokens: int, train_words: int):
    """Documents of a block from the block and its words' statistics."""
    p_end = (train_docs + 1) / (train_tokens + 2)
    go_on, stop = math.log10(1 - p_end) if p_end < 1 else 0.0, math.log10(p_end)
    norm = math.log10(train_tokens + train_words + 1)

    def summed(c: np.ndarray, logp: np.ndarray, tokens, n_words, doc_ids, held) -> pa.RecordBatch:
        number = unpack(tokens.as_buffer())
        n = np.array(n_words.as_py(), np.int64)
        prefix = np.append(0, np.cumsum(n))

        def total(value: np.ndarray) -> np.ndarray:
            s = np.zeros(len(n))
            full = np.flatnonzero(n)
            if len(full):
                s[full] = np.add.reduceat(value[number], prefix[:-1][full])
            return s

        base = total(np.log10(c + 1.0)) + math.log10(train_docs + 1) - (n + 1) * norm
        known = total((c > 0).astype(float)).round().astype(np.int64) + (train_docs > 0)
        score = total(logp / math.log(10)) + n * go_on + stop
        columns = [pa.array(doc_ids.as_py(), pa.int64()), pa.array(held.as_py(), pa.bool_()), n + 1, known, np.full(len(n), train_tokens, np.int64), base, score]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block and the statistics of its words, in any order."""
        order = np.argsort(right.column("pos").to_numpy())
        c, logp = (right.column(x).to_numpy()[order].astype(float) for x in ("c", "logp"))
        out = [summed(c, logp, *(left.column(x)[k] for x in ("tokens", "n_words", "doc_ids", "held"))) for k in range(left.num_rows)]
        return pa.Table.from_batches(out)

    return run


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    blocks = numbered(src.mapInArrow(_encode, BLOCKS), "lm-blocks", compression="zstd").withColumnRenamed("place", "block")
    n_blocks, n_rows, train_docs = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    rows = blocks.select("block", F.expr("posexplode(arrays_zip(words, train))")).select("block", "pos", "col.words", "col.train").toDF("block", "pos", "word", "train")
    if (parts := n_rows // JOIN_ROWS) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(parts, "word")
    counts = materialize(rows.groupBy("word").agg(F.sum("train").alias("c")), "lm-counts")
    # long words stand beside the table under their digests
    longs = blocks.select(F.explode("longs").alias("spelled")).select(F.concat(F.lit(" "), F.sha2("spelled", 256)).alias("word"), "spelled").dropDuplicates(["word"])
    spelled = counts.where(~F.startswith("word", F.lit(" "))).select("word", "c", F.col("word").alias("spelled")).unionByName(counts.where(F.startswith("word", F.lit(" "))).join(longs, "word"))
    # the vocabulary is a fixed table, and so are its weights
    pieces = load_pieces(vocabulary)
    expected = spelled.where("c > 0").mapInArrow(_expect(spark.sparkContext.broadcast(pieces)), "piece binary, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    pieces = reweigh(pieces, {bytes(r["piece"]): r["n"] for r in sorted(expected, key=lambda r: bytes(r["piece"]))})
    scored = materialize(spelled.mapInArrow(_lattice(spark.sparkContext.broadcast(pieces)), "word string, c long, logp double"), "lm-words")
    words, tokens = scored.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    sums = _sum_up(train_docs, tokens + train_docs, words + (train_docs > 0))
    # as many partitions as leave each with a block or two, however many blocks there are
    stats = rows.join(scored, "word").select("block", "pos", "c", "logp").repartition(2 * max(1, n_blocks), "block")
    whole = blocks.select("block", "tokens", "n_words", "doc_ids", "held").repartition(2 * max(1, n_blocks), "block")
    out = materialize(whole.groupBy("block").cogroup(stats.groupBy("block")).applyInArrow(sums, SCHEMA), "lm-scores")
    drop_scratch(spark, blocks, counts, scored)
    return out
