"""MinHash near-duplicates by ProbMinHash.

Every document is a set of five-word shingles weighted by their counts. Each shingle is a Poisson process of rate equal to
its weight; its arrivals fall on random registers, and a shingle stops once its next arrival is later than every
register's earliest one. The shingle that is first in a register is the register's value, and two documents agree in a
register with the probability Jaccard of their weighted shingles. Registers are cut into bands; documents that agree in a
whole band are candidates; a candidate pair is a link if its exact probability Jaccard (or its plain Jaccard) reaches the
threshold. Texts with a repeated shingle have a second signature and bands of it, in which every shingle weighs one: these
find what is alike by plain Jaccard alone. Without repeats both signatures are the same. Classes are the connected
components of the links.

Skew: exact copies (equal word sequences) are folded into one row, that of the smallest doc_id, before anything else. In a
bucket, each member is paired with the bucket's leader, not with all others; bands have different leaders. In buckets that
still hold several classes, the members of all classes but the largest are compared block by block with those of other
classes: first with the likeliest few, by signature, then with all that the signatures leave possible. The largest class of
a bucket is dealt out once, however large it is, and only what may be a link leaves a block.

Defined results: a null text is a class of its own; a text without words equals only identical texts; a text of fewer
than five words has one shingle; very long texts are read whole; repeated rows get the same class; rows that repeat a doc_id
with another text are rows of their own; class_id and copy_of are smallest doc_ids, null where no member has one; of equal
doc_ids the text with the smaller hash stands for the class; empty input gives an empty result; columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.llm.common import U64, drop_scratch, fresh, materialize, mix64, rows_of, shingles, text_chunks, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 24, 5
#: Orders of ids by which bands choose their leaders.
LEADERS = [0, 0x2AAAAAAAAAAAAAAA, 0x1CE4E5B9133111EB]
#: A pair of threshold similarity agrees in fewer registers with a chance of about 1 in 30,000.
SIGNATURE_SLACK = 4.0


def weighted_shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, weight) of every different shingle, sorted by row and shingle; word hashes and their prefix sums."""
    words, prefix = word_hashes(data, off, "alnum")
    sh, row = shingles(words, prefix, k)
    key = np.sort((row.astype(U64) << U64(48)) | (sh >> U64(16)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(48)).astype(np.int64), key & U64(2**48 - 1), weight, words, prefix


def prob_minhash(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """ProbMinHash registers (n_rows, m): the item whose Poisson process arrives first in each register."""
    first = np.full(n_rows * m, np.inf)
    value = np.zeros(n_rows * m, np.uint32)
    at, arrival, t = np.arange(len(row)), np.zeros(len(row)), 0
    with np.errstate(over="ignore"):
        while len(at):
            t += 1
            bits = mix64(item[at] * U64(0x9E3779B97F4A7C15) + U64(t) * U64(0xD1B54A32D192ED03))
            arrival = arrival - np.log(((bits >> U64(11)).astype(float) + 0.5) * 2.0**-53) / weight[at]
            register = ((mix64(bits) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64) + row[at] * m
            np.minimum.at(first, register, arrival)
            won = first[register] == arrival
            value[register[won]] = mix64(item[at[won]]).astype(np.uint32)
            latest = first.reshape(n_rows, m).max(axis=1)
            keep = arrival < latest[row[at]]
            at, arrival = at[keep], arrival[keep]
    return value.reshape(n_rows, m)


def fingerprints(words: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every row's word sequence."""
    n = len(prefix) - 1
    out = []
    place = (np.arange(len(words)) - np.repeat(prefix[:-1], np.diff(prefix))).astype(U64)
    row = rows_of(prefix)
    with np.errstate(over="ignore"):
        for c in (U64(0x8CB92BA72F3D8DD7), U64(0xABC98388FB8FAC03)):
            h = np.zeros(n, U64)
            full = np.flatnonzero(np.diff(prefix))
            if len(full):
                h[full] = np.add.reduceat(mix64(words * c + mix64(place + c)), prefix[:-1][full])
            out.append(mix64(h + np.bincount(row, minlength=n).astype(U64) * c).view(np.int64))
    return out[0], out[1]


def _bands(sig: np.ndarray) -> np.ndarray:
    """Hash of each band of signatures (n, BANDS)."""
    with np.errstate(over="ignore"):
        band = np.zeros((len(sig), BANDS), U64)
        for r in range(BAND_ROWS):
            band = mix64(band * U64(31) + sig[:, r::BAND_ROWS][:, :BANDS].astype(U64) + U64(r + 1))
    return band


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = BANDS * BAND_ROWS
    for batch in batches:
        ids, hashes, texts = (batch.column(c) for c in range(3))
        for i, j, data, off in text_chunks(batch, limit=1_000_000):
            row, item, weight, words, prefix = weighted_shingles(data, off)
            f0, f1 = fingerprints(words, prefix)
            f0, f1, n = f0.copy(), f1.copy(), np.diff(prefix)
            null = texts[i:j].is_null().to_numpy(zero_copy_only=False)
            for x in np.flatnonzero((n == 0) & ~null):  # wordless: by the text itself
                raw = hashlib.blake2b(data[off[x] : off[x + 1]].tobytes(), digest_size=16).digest()
                f0[x], f1[x] = np.frombuffer(raw, np.int64)
            full = np.flatnonzero(n)
            dense = np.cumsum(n > 0) - 1
            sig = prob_minhash(dense[row], item, weight, len(full), m)
            band = _bands(sig)
            # texts with a repeated shingle: the bands of both signatures, those of the second only where they differ
            heavy = np.unique(dense[row[weight > 1]])
            among = np.full(len(full), -1)
            among[heavy] = np.arange(len(heavy))
            of = among[dense[row]]
            plain = prob_minhash(of[of >= 0], item[of >= 0], np.ones((of >= 0).sum()), len(heavy), m)
            plain_band = _bands(plain)
            each = [band[k] for k in range(len(full))]
            skip = [np.zeros(BANDS, bool)] * len(full)
            for k, x in enumerate(heavy.tolist()):
                each[x] = np.concatenate([band[x], plain_band[k]])
                skip[x] = np.append(skip[x], plain_band[k] == band[x])
            sizes = np.zeros(j - i, np.int64)
            sizes[full] = [len(x) for x in each]
            buckets = pa.array(np.concatenate([np.zeros(0, U64), *each]).view(np.int64), pa.int64(), mask=np.concatenate([np.zeros(0, bool), *skip]))
            regs, plain_regs = [None] * (j - i), [None] * (j - i)
            for k, x in enumerate(full):
                regs[x] = sig[k].tobytes()
            for k, x in enumerate(full[heavy]):
                plain_regs[x] = plain[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    ids[i:j],
                    hashes[i:j],
                    pa.array(f0, mask=null),
                    pa.array(f1, mask=null),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), buckets),
                    pa.array(regs, pa.binary()),
                    pa.array(plain_regs, pa.binary()),
                ],
                names=["doc_id", "h", "f0", "f1", "bands", "signature", "plain"],
            )


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted items, weights): the sum over common items d of
    1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    items = np.union1d(a, b)
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[np.searchsorted(items, a)], y[np.searchsorted(items, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.append(0, np.cumsum(y))  # y of the first k
    above = np.append(np.cumsum(x[::-1])[::-1], 0)  # x from k on
    k = np.searchsorted(ratio, ratio, side="right")
    both = (x > 0) & (y > 0)
    return float((1 / (above[k[both]] / x[both] + below[k[both]] / y[both])).sum())


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of probability Jaccard and plain Jaccard."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    plain = common / max(1, len(a) + len(b) - common)
    # without a common shingle both are zero, without weights over one they are equal
    if not common or (wa.max() == 1 and wb.max() == 1):
        return plain
    return max(plain, probability_jaccard(a, wa, b, wb))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in text_chunks(batch):
            row, item, weight, _, _ = weighted_shingles(data, off)
            at = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([item[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([weight[x:y].astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["id", "items", "weights"],
            )


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                raw = [b.column(c)[k].as_buffer() for c in range(2, 6)]
                a, wa, c, wc = (np.frombuffer(x, t) for x, t in zip(raw, (U64, np.int32, U64, np.int32), strict=True))
                s = similarity(a, wa, c, wc)
                if s >= threshold:
                    keep.append((k, s))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in keep], pa.int64())), b.column(1).take(pa.array([k for k, _ in keep], pa.int64())), pa.array([s for _, s in keep], pa.float64())], names=["a", "b", "similarity"])

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingles and weights of the rows of docs (doc_id, h, text) that ids (id, copy_of, h) name."""
    named = ids.select("id", "copy_of", F.col("h").alias("of_h")).hint("shuffle_hash")
    texts = docs.join(named, F.col("doc_id").eqNullSafe(F.col("copy_of")) & (F.col("h") == F.col("of_h"))).select("id", "text")
    return materialize(texts.mapInArrow(_shingle_sets, "id long, items binary, weights binary").dropDuplicates(["id"]), "shingles")


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Links among the candidate pairs (a < b)."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"), F.col("weights").alias("wa"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"), F.col("weights").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "wa", "ib", "wb").mapInArrow(_verify(threshold), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): smallest id of each connected component, for the ids of edges (a, b).

    Labels spread to neighbours and then jump to their label's label; each round is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        now = materialize(step.join(jump, "new").select("id", "old", F.least("new", "far").alias("label")), "labels")
        changed = now.where("label <> old").limit(1).count()
        drop_scratch(labels.sparkSession, labels)
        labels = now.select("id", "label")
        if not changed:
            drop_scratch(labels.sparkSession, both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, label) with more links (a, b). Only classes that a link joins are walked through again."""
    far = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.select("a", "b").join(far("a"), "a", "left").join(far("b"), "b", "left")
    ends = materialize(ends.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")), "link-ends")
    moved = components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    every = labels.unionByName(ends.select(F.col("a").alias("id"), F.col("x").alias("label"))).unionByName(ends.select(F.col("b").alias("id"), F.col("y").alias("label"))).distinct()
    out = materialize(every.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    drop_scratch(labels.sparkSession, ends, moved, labels)
    return out


SIGNED = "doc_id long, h long, f0 long, f1 long, bands array<long>, signature binary, plain binary"


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A table with doc_id, h (hash of the text), class_id, copy_of and class_h (hash of the class's first text) of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    # rows are told apart by numbers of their own, as doc_ids may repeat or be missing
    signed = materialize(src.mapInArrow(_sign, SIGNED).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # written down, so that the join is of two plain shuffles and a large group of copies can be split
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")).alias("first")
    kept = materialize(signed.where("f0 is not null").groupBy("f0", "f1").agg(first).select("f0", "f1", F.col("first.doc_id").alias("copy_of"), F.col("first.h").alias("first_h"), F.col("first.row").alias("id")), "copies")
    member = materialize(signed.select("doc_id", "h", "f0", "f1").join(kept, ["f0", "f1"], "left").select("doc_id", "h", "id", "copy_of", "first_h"), "members")
    # representatives only, and of these only buckets with two or more
    sig = signed.where("f0 is not null and size(bands) > 0").join(kept.select(F.col("id").alias("row")), "row", "left_semi")
    rows = sig.select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "bucket")).where("bucket is not null")
    # both signatures of a text share their buckets with either of another; the second one's count only in buckets that stay open
    rows = rows.withColumn("second", F.col("band") >= BANDS).withColumn("band", F.col("band") % BANDS)
    mask = F.element_at(F.array(*[F.lit(x) for x in LEADERS]), (F.col("band") % len(LEADERS)) + 1)
    rows = materialize(rows.select("id", "second", "band", F.xxhash64("band", "bucket").alias("bucket"), mask.alias("mask")), "bands")
    leaders = rows.groupBy("bucket", "mask").agg(F.min(F.expr("if(second, null, id ^ mask)")).alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    shared = materialize(rows.join(leaders.select("bucket", (F.expr("m ^ mask")).alias("leader")), "bucket").select("bucket", "band", "id", "second", "leader"), "buckets")
    pairs = materialize(shared.where("not second and id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "pairs")
    ids = materialize(shared.select("id").distinct(), "bucket-ids")
    sets = shingle_sets(src, kept.select("id", "copy_of", F.col("first_h").alias("h")).join(ids, "id", "left_semi"))
    links = materialize(verified(sets, pairs, threshold), "links")
    labels = components(links)
    # buckets that still hold several classes: members are compared with those of other classes, the likeliest first
    spent = [signed, rows, shared, pairs, ids, sets, links]
    signatures = signed.select(F.col("row").alias("id"), "signature", "plain").join(ids, "id", "left_semi")
    for exact in (False, True):
        placed = materialize(open_members(shared, labels), "open-buckets")
        spent.append(placed)
        if not placed.limit(1).count():
            break
        placed = placed.join(signatures, "id")
        if exact:
            placed = placed.join(sets.mapInArrow(_small_sets, "id long, small binary, heavy binary"), "id")
        more = materialize(cross_pairs(placed, threshold, exact).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        found = materialize(verified(sets, more, threshold), "more-links")
        spent += [more, found]
        if found.limit(1).count():
            labels = merged(labels, found)
    heads = labels.join(kept.select("id", "copy_of", "first_h"), "id").groupBy("label").agg(F.min(F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "first_h")).alias("head"))
    of = materialize(labels.join(heads, "label").select("id", F.col("head.copy_of").alias("class_id"), F.col("head.first_h").alias("class_h")), "class-heads")
    out = member.join(of, "id", "left").select("doc_id", "h", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.coalesce("class_id", "copy_of")).alias("class_id"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.coalesce("class_h", "first_h", "h").alias("class_h"))
    out = materialize(out, "classes")
    drop_scratch(docs.sparkSession, *spent, kept, member, labels, of)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copy_of (smallest doc_id with the same words) of every row of docs (doc_id, text)."""
    return classify(docs, threshold).select("doc_id", "class_id", "copy_of")


def open_members(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, band, id, label, the label's members in the bucket (mates) and whether it is the bucket's largest one, of
    buckets with two labels or more."""
    placed = shared.join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("label")).distinct()
    counts = placed.groupBy("bucket", "label").agg(F.count("*").alias("mates"))
    several = counts.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("mates", "label")).alias("top")).where("lo <> hi")
    several = several.select("bucket", F.col("top.label").alias("top"))
    # written down, so that a large class of a bucket can be split
    classes = materialize(counts.join(several, "bucket").select("bucket", "label", "mates", (F.col("label") == F.col("top")).alias("largest")), "open-classes")
    return placed.join(classes, ["bucket", "label"])


def _small_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles cut to 32 bits, and the weights if any is over 1."""
    for b in batches:
        small = [(np.frombuffer(x.as_buffer(), U64) >> U64(16)).astype(np.uint32).tobytes() for x in b.column(1)]
        heavy = [w.as_py() if (np.frombuffer(w.as_buffer(), np.int32) > 1).any() else b"" for w in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary()), pa.array(heavy, pa.binary())], names=["id", "small", "heavy"])


#: Members of one block of an open bucket; blocks of a bucket meet two by two in tasks of their own.
OPEN_BLOCK = 512
#: And the most bytes of their shingles.
OPEN_BYTES = 4_000_000
#: Shingles that are looked up at once.
LOOKUP = 250_000
#: Partners that a member is given in a block when signatures alone are looked at.
LIKELIEST = 8
#: What cutting shingles to 32 bits can take from a similarity.
SMALL_SLACK = 0.01


def cross_pairs(placed: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """Pairs of different labels within a bucket that may be links.

    placed: bucket, band, id, label, mates, largest, signature, plain[, small, heavy]. The largest class of a bucket, and the
    rest, are dealt into blocks of about OPEN_BLOCK members. A task compares one block of the rest with one block of the
    largest class, or two blocks of the rest, and only the pairs found leave it. Members of the smaller class look for
    partners in the larger one: first by signature, each for its LIKELIEST; when `exact`, all whose signatures, of either
    kind, agree about as often as threshold pairs do are compared shingle by shingle, a pair only in the first band it shares.
    """

    def blocks(which: Column) -> Column:
        need = F.count_if(which) / OPEN_BLOCK
        if exact:
            need = F.greatest(need, F.coalesce(F.sum(F.when(which, F.octet_length("small"))), F.lit(0)) / OPEN_BYTES)
        return F.ceil(need).cast("int")

    sizes = placed.groupBy("bucket").agg(blocks(F.col("largest")).alias("n_largest"), blocks(~F.col("largest")).alias("n_rest"))
    own = F.when(F.col("largest"), F.col("n_largest")).otherwise(F.col("n_rest"))
    dealt = placed.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), own).cast("int"))
    at = F.col("block")

    def meet(n: str, largest: bool, x, y) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda o: F.struct(F.lit(largest).alias("across"), x(o).alias("x"), y(o).alias("y")))

    rest = F.concat(meet("n_rest", False, lambda o: F.least(at, o), lambda o: F.greatest(at, o)), meet("n_largest", True, lambda o: at, lambda o: o))
    task = F.when(F.col("largest"), meet("n_rest", True, lambda o: o, lambda o: at)).otherwise(rest)
    dealt = dealt.withColumn("task", F.explode(task)).select("*", "task.*").drop("task", "n_rest", "n_largest")
    m = BANDS * BAND_ROWS
    least = threshold * m - SIGNATURE_SLACK * (threshold * (1 - threshold) * m) ** 0.5

    def compare(t: pa.Table) -> pa.Table:
        ids, labels, mates, block = (t.column(c).to_numpy() for c in ("id", "label", "mates", "block"))
        across, x, y, band = (t.column(c)[0].as_py() for c in ("across", "x", "y", "band"))
        largest = t.column("largest").to_numpy(zero_copy_only=False)
        sig = np.stack([np.frombuffer(s.as_buffer(), np.uint32) for s in t.column("signature")])
        # a text without repeated shingles has one signature for both
        own = [s.as_buffer() for s in t.column("plain")]
        repeats = np.array([p is not None for p in own])
        plain = sig.copy() if repeats.any() else sig
        for i in np.flatnonzero(repeats):
            plain[i] = np.frombuffer(own[i], np.uint32)
        sets = _Sets(t) if exact else None
        a, b = [], []
        blocks = [np.flatnonzero(~largest), np.flatnonzero(largest)] if across else [np.flatnonzero(block == x), np.flatnonzero(block == y)]
        for left, right in [blocks] if across or x == y else [blocks, blocks[::-1]]:
            for i in left:
                k = right[(labels[right] != labels[i]) & ((mates[right] > mates[i]) | ((mates[right] == mates[i]) & (labels[right] > labels[i])))]
                agree = (sig[k] == sig[i]).sum(axis=1)
                if repeats[i] or repeats[k].any():
                    agree = np.maximum(agree, (plain[k] == plain[i]).sum(axis=1))
                keep = agree >= least
                k, agree = k[keep], agree[keep]
                if sets is None:
                    k = k[np.lexsort((ids[k], -agree))[:LIKELIEST]]
                else:
                    pairs = itertools.product((sig, plain), repeat=2) if repeats[i] or repeats[k].any() else [(sig, sig)]
                    shared = np.logical_or.reduce([(u[k] == v[i]).reshape(len(k), BANDS, BAND_ROWS).all(axis=2) for u, v in pairs])
                    k = k[shared.argmax(axis=1) == band]
                    k = k[sets.similarities(i, k) >= threshold - SMALL_SLACK]
                a += np.minimum(ids[k], ids[i]).tolist()
                b += np.maximum(ids[k], ids[i]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "across", "x", "y").applyInArrow(compare, "a long, b long").distinct()


class _Sets:
    """The shingle sets of a task's rows, one after the other."""

    def __init__(self, t: pa.Table):
        each = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("small")]
        self.n = np.array([len(x) for x in each], np.int64)
        self.start = np.append(0, np.cumsum(self.n))
        self.items = np.concatenate(each)
        self.heavy = [np.frombuffer(x.as_buffer(), np.int32) for x in t.column("heavy")]

    def of(self, i: int) -> np.ndarray:
        return self.items[self.start[i] : self.start[i + 1]]

    def weights(self, i: int) -> np.ndarray:
        return self.heavy[i] if len(self.heavy[i]) else np.ones(self.n[i])

    def similarities(self, i: int, k: np.ndarray) -> np.ndarray:
        share = np.cumsum(self.n[k]) // LOOKUP
        return np.concatenate([np.zeros(0), *(self._some(i, k[share == s]) for s in np.unique(share))])

    def _some(self, i: int, k: np.ndarray) -> np.ndarray:
        own = self.of(i)
        at = np.repeat(self.start[k], self.n[k]) + np.arange(self.n[k].sum()) - np.repeat(np.cumsum(self.n[k]) - self.n[k], self.n[k])
        items = self.items[at]
        found = own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items
        common = np.bincount(np.repeat(np.arange(len(k)), self.n[k])[found], minlength=len(k))
        out = common / (self.n[k] + len(own) - common)
        for x in np.flatnonzero(common):
            j = k[x]
            if len(self.heavy[i]) or len(self.heavy[j]):
                out[x] = max(out[x], probability_jaccard(own, self.weights(i), self.of(j), self.weights(j)))
        return out


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: one of each class, that of the smallest doc_id; columns unchanged.

    Rows are told apart by doc_id and text: of a class whose members all lack a doc_id, one row stays too. Of rows with null
    text, those that repeat a doc_id count as one; those without doc_id all stay.
    """
    classes = classify(docs, threshold)
    doc, h, there, alone = fresh(docs.columns, "gone_id", "gone_h", "text_h", "alone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(there) == F.col(h))
    marked = docs.withColumn(there, F.xxhash64("text"))
    # the few that go are joined, not the many that stay; by shuffle at any size, as their number has no bound
    gone = classes.where("not (doc_id <=> class_id) or h <> class_h").select(F.col("doc_id").alias(doc), F.col("h").alias(h)).distinct()
    kept = marked.join(gone.hint("shuffle_hash"), same, "left_anti")
    heads = classes.where("doc_id <=> class_id and h = class_h")
    twice = materialize(heads.groupBy(F.col("doc_id").alias(doc), F.col("h").alias(h)).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if twice.limit(1).count():
        # repeated rows: one of them stays
        again = kept.join(twice.hint("shuffle_hash"), same, "left_semi").withColumn(alone, F.when(F.col("doc_id").isNull() & F.col("text").isNull(), F.monotonically_increasing_id()))
        kept = kept.join(twice.hint("shuffle_hash"), same, "left_anti").unionByName(again.dropDuplicates(["doc_id", there, alone]).drop(alone))
    return kept.drop(there)
