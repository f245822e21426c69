"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 4 characters (code points) of the lower-cased text, in 2^18 slots. Document frequencies
cover all training documents. The weights are learned by follow-the-regularised-leader (proximal, per coordinate) with
elastic-net penalties on at most SAMPLE_PER_LANG documents of each language (smallest id hashes first); a part of that sample
is set aside to calibrate a temperature. Every whole text is then predicted.

Defined results: 'und' with score 0 if the text is null, empty, has no letter, or nothing could be learned; very long texts
are counted whole, piece by piece; rows with null lang are predicted but not learned from; a null doc_id is never learned
from and not held out; repeated rows get the same prediction, and count once in the sample; of equal scores the language that
sorts first is predicted; one learned language is predicted with score 1; an empty table gives an empty result; columns other
than doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lipika.llm.common import SAMPLE_ROOM, bounded_batches, drop_scratch, hash_place, materialize

ORDERS = (1, 2, 3, 4)
BITS = 18
DIM = 1 << BITS
#: Characters that are counted at once; of a longer text, pieces of so many.
STEP = 400_000
FOLDS = 5
#: Bound of the training sample.
SAMPLE_PER_LANG = 400
CALIBRATION_SHARE = 0.2
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 2e-4, 1e-4



def _slots(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Order less one and the slots of all grams of that order in a run of code points, by where they start."""
    h = np.zeros(len(chars), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            h = h[: len(chars) - k] * np.uint32(0x01000193) + chars[k:] + np.uint32(1)
            if k + 1 in ORDERS:
                g = h * np.uint32(0x9E3779B1)
                yield k, (g ^ (g >> np.uint32(15))) & np.uint32(DIM - 1)
            if len(h) < 2:
                return


def _code_points(text: str) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where((chars >= 9) & (chars <= 13), np.uint32(32), chars)


def counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, in order, the slots of its grams, ascending, and how often they occur."""
    held: list[str] = []
    size = 0
    for t in texts:
        low = t.lower()
        if size + len(low) > STEP:
            yield from _together(held)
            held, size = [], 0
        if len(low) > STEP:
            yield _piece_by_piece(low)
        else:
            held.append(low)
            size += len(low)
    yield from _together(held)


def _together(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = np.array([len(t) for t in texts], np.int64)
    if not n.sum():
        yield from ((np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in texts)
        return
    chars, ends = _code_points("".join(texts)), np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    left = ends[row] - np.arange(len(chars))
    keys = []
    for k, slots in _slots(chars):
        inside = left[: len(slots)] > k
        keys.append((row[: len(slots)][inside] << BITS) | slots[inside])
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    cut = np.searchsorted(key, np.arange(len(n) + 1) << BITS)
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        yield key[i:j] & (DIM - 1), count[i:j]


def _piece_by_piece(text: str) -> tuple[np.ndarray, np.ndarray]:
    total, lap = np.zeros(DIM, np.int64), max(ORDERS) - 1
    for i in range(0, len(text), STEP):
        for k, slots in _slots(_code_points(text[i : i + STEP + lap])):
            total += np.bincount(slots[: STEP if i + STEP < len(text) else len(slots)], minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for at, _ in counts(_texts(batch)):
            df[at] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()) for at, n in counts(_texts(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in got], pa.binary()), pa.array([n for _, n in got], pa.binary())], names=["lang", "at", "n"])


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector on the features `at` (sublinear term frequency)."""
    v = (1 + np.log(n)) * idf[at]
    return v / (np.sqrt((v * v).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIM, classes). Each step's weights come in closed form from the accumulated gradients: zero where L1 outweighs them."""
    z, sq = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(sq[at])) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, y = rows[i]
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(sq[at] + g * g) - np.sqrt(sq[at])) / ALPHA
            z[at] += g - sigma * w
            sq[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood (golden section over its logarithm).

    Targets are smoothed by one case in n + 2, so that a sample without an error doesn't call for certainty.
    """
    slack = 1 / (len(y) + 2)
    target = np.full(logits.shape, slack / max(1, logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - slack

    def loss(t: float) -> float:
        return float(-(target * np.log(softmax(logits / np.exp(t)) + 1e-300)).sum(axis=1).mean())

    a, b = np.log(0.02), np.log(20.0)
    ratio = (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(training: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """Languages, idf, weights and temperature from training rows (doc_id, text, lang), or None if there are none."""
    spark = training.sparkSession
    # DIM sums, whatever the corpus
    sums = training.select("text").mapInArrow(_document_frequency, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    feature, n = sums["feature"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)
    df = np.zeros(DIM)
    df[feature[feature >= 0]] = n[feature >= 0]
    n_docs = int(n[feature < 0].sum())
    if not n_docs:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    # few rows of each language get as far as the ranking, however many there are; equal rows count once
    keyed = training.withColumn("h", F.xxhash64("text"))
    sizes = materialize(training.groupBy("lang").agg(F.count("*").alias("n")), "lang-sizes")
    near = keyed.select("doc_id", "lang", "h", hash_place("doc_id").alias("place")).join(sizes, "lang").where(F.col("place") < SAMPLE_ROOM * SAMPLE_PER_LANG / F.col("n")).drop("n").distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "h"))
    ids = materialize(near.withColumn("no", order).where(F.col("no") <= SAMPLE_PER_LANG).select("doc_id", "lang", "h"), "lang-sample")
    # SAMPLE_PER_LANG texts of each language, as gram counts
    chosen = keyed.join(ids, ["doc_id", "lang", "h"], "left_semi").dropDuplicates(["doc_id", "lang", "h"])
    sample = chosen.select("lang", "text").mapInArrow(_sparse, "lang string, at binary, n binary").collect()
    drop_scratch(spark, sizes, ids)
    sample.sort(key=lambda r: (r.lang, r.at, r.n))
    langs = sorted({r.lang for r in sample})
    rows = []
    for r in sample:
        at = np.frombuffer(r["at"], np.int32)
        rows.append((at, weigh(at, np.frombuffer(r["n"], np.int32), idf), langs.index(r.lang)))
    pick = np.random.default_rng(5).random(len(rows)) < CALIBRATION_SHARE
    w = ftrl([r for r, p in zip(rows, pick, strict=True) if not p] or rows, len(langs))
    aside = [r for r, p in zip(rows, pick, strict=True) if p] or rows
    t = temperature(np.stack([v @ w[at] for at, v, _ in aside]), np.array([y for _, _, y in aside]))
    return langs, idf, w, t


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, w, t = model.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for k, (at, n) in enumerate(counts(_texts(batch))):
                if letters[k]:
                    p = softmax(weigh(at, n, idf) @ w[at] / t)
                    best = int(p.argmax())
                    pred[k], score[k] = langs[best], p[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    training = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    model = fit(training)
    if model is None:
        return docs.select("doc_id", held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter.alias("letter"), held.alias("held_out"))
    return src.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
