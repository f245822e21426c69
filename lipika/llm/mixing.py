"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more a balanced sample in which
each document has inclusion probability r - floor(r). The flight moves the vector of probabilities along the null space
of the two balancing constraints (token total, document count), three documents of one size class at a time, until at
most two fractional ones are left of each class in each block; the left-overs of all blocks fly again, level by level,
and the last few of a source are landed with the smallest token error. Blocks hold about 16,384 rows whatever the source, so a hot source is cut
into many blocks.

The table of sources stays a table: sources are numbered in their global order, and the sharing out goes round by round
over sums of that table, so the driver holds two numbers, however many sources there are.

Defined results: null and empty text have size 0 and are taken like any other document (its words are 0); very long texts are
counted whole; a source of size 0 has target 0 and takes nothing; rows of equal source, doc_id and text are sampled together
and share the copies as evenly as whole rows allow; null source is a source of its own, ordered last; empty input gives an
empty result; other columns are not read, and mixed_documents returns them whatever their names. The draw depends on the
rows' values and the seed alone, so reruns agree; equal ranks are ordered by doc_id and size.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.llm.common import drop_scratch, fresh, materialize, numbered

BLOCK_ROWS = 16_384
#: Fractions that a block leaves at most: two in each size class.
LEFT_ROWS = 64
LANDING_BEAM = 256
MAX_REPEAT = 3
#: Weights of sources in their order, repeating.
WEIGHTS = 3
#: Equal rows that one row is spread to at a time.
SPREAD = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def _exact(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def source_plan(units: DataFrame) -> DataFrame:
    """source, source_no, source_size, target, whole, part of every source of units (source, size, n).

    A source's target is its share by weight, at most MAX_REPEAT times its size; what a capped source leaves is shared again
    by weight among the others until none is above its cap. A share that is over a cap stays over it as shares grow, so each
    round caps all sources over theirs and shares the rest anew. whole + part is target / source_size.
    """
    spark = units.sparkSession
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    by = F.col("source").asc_nulls_last()
    plan = numbered(sizes.repartitionByRange(by).sortWithinPartitions(by), "mix-sources").withColumn("weight", F.col("place") % WEIGHTS + 1)
    size, weight = F.col("source_size").cast("decimal(19,0)"), F.col("weight").cast("decimal(1,0)")
    over = F.lit(False)
    share = None
    while True:
        # what is left for the sources under their caps, and their weights
        r = plan.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("source_size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        left, weights = (r.total or 0) - MAX_REPEAT * (r.capped or 0), r.weights or 0
        if (left, weights) == share or not weights:
            break
        share = left, weights
        over = _exact(left) * weight > _exact(MAX_REPEAT * weights) * size
    want, base = _exact(left) * weight, _exact(max(weights, 1)) * size  # a share's ratio to its source is want / base
    whole = sum((F.when((F.col("source_size") > 0) & (want >= base * k), 1).otherwise(0) for k in range(1, MAX_REPEAT + 1)), F.lit(0))
    part = F.when(F.col("source_size") > 0, (want - base * whole).cast("double") / base.cast("double")).otherwise(0.0)
    out = plan.select(
        "source",
        F.col("place").cast("int").alias("source_no"),
        "source_size",
        F.when(over, (F.col("source_size") * MAX_REPEAT).cast("double")).otherwise(want.cast("double") / max(weights, 1)).alias("target"),
        F.when(over, F.when(F.col("source_size") > 0, MAX_REPEAT).otherwise(0)).otherwise(whole).cast("int").alias("whole"),
        F.when(over, 0.0).otherwise(part).alias("part"),
    )
    done = materialize(out, "mix-plan")
    drop_scratch(spark, plan)
    return done


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Cube sampling of one block, size class by size class (powers of two).

    A class leaves at most two fractions. Within a class sizes are alike, so no large document lingers among small
    ones, and the fractions left over have sizes from small to large, with which the landing can meet the totals.
    """
    p = p.astype(float).copy()
    p[p < 1e-9], p[p > 1 - 1e-9] = 0, 1
    left: list[int] = []
    stratum = np.log2(size.astype(float) + 1).astype(int)
    for s in np.unique(stratum)[::-1]:
        left += _fly_class(p, size, np.flatnonzero((stratum == s) & (p > 0) & (p < 1)).tolist(), rng)
    if land and left:
        _land(p, size, sorted(left, key=lambda i: -size[i]))
    return p


def _fly_class(p: np.ndarray, size: np.ndarray, queue: list[int], rng: np.random.Generator) -> list[int]:
    draws = rng.random(len(queue) + 2)
    active: list[int] = []
    k = step = 0
    while True:
        while len(active) < 3 and k < len(queue):
            active.append(queue[k])
            k += 1
        if len(active) < 3:
            return active
        a, b, c = active
        sa, sb, sc = float(size[a]), float(size[b]), float(size[c])
        # the null space of the token row and the document row, for three documents
        u = (sb - sc, sc - sa, sa - sb) if sa != sb or sb != sc else (1.0, -1.0, 0.0)
        at = (p[a], p[b], p[c])
        up = min((1 - x) / v if v > 0 else -x / v for x, v in zip(at, u, strict=True) if v)
        down = min(x / v if v > 0 else (x - 1) / v for x, v in zip(at, u, strict=True) if v)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        new = [x + move * v for x, v in zip(at, u, strict=True)]
        ends = [i for i, x in enumerate(new) if x < 1e-9 or x > 1 - 1e-9] or [int(np.argmin([min(x, 1 - x) for x in new]))]
        for i, x in enumerate(new):
            p[active[i]] = round(x) if i in ends else x
        active = [x for i, x in enumerate(active) if i not in ends]


def _land(p: np.ndarray, size: np.ndarray, left: list[int]) -> None:
    """Settle the last fractions, largest first: the choice of least token error, then least document error (beam search)."""
    beam: list[tuple[float, float, tuple[int, ...]]] = [(0.0, 0.0, ())]
    for i in left:
        beam = [(tokens + (x - p[i]) * float(size[i]), docs + x - p[i], (*chosen, x)) for tokens, docs, chosen in beam for x in (0, 1)]
        beam = sorted(beam, key=lambda t: (abs(t[0]), abs(t[1]), t[2]))[:LANDING_BEAM]
    for i, x in zip(left, beam[0][2], strict=True):
        p[i] = x


def _fly(units: DataFrame, blocks: int, seed: int, land: bool) -> DataFrame:
    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("rank", "doc_id", "size")])
        rng = np.random.default_rng([seed, blocks, t.column("block")[0].as_py(), t.column("rank")[0].as_py() & (2**63 - 1), t.column("source_no")[0].as_py()])
        p = flight(t.column("p").to_numpy(), t.column("size").to_numpy(), rng, land)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    units = units.withColumn("block", F.pmod(F.col("rank"), F.lit(blocks)))
    return units.groupBy("source_no", "block").applyInArrow(one, units.schema)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and text_h (hash of the text) of every row of docs (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    units = materialize(docs.groupBy("source", "doc_id", F.xxhash64("text").alias("text_h"), size.alias("size")).agg(F.count("*").alias("n")), "mix-units")
    plan = source_plan(units)
    spent = [units, plan]
    units = units.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    # of n equal rows, some are certain; one fraction is left to the flight
    units = units.select("*", F.floor(F.col("n") * F.col("part") + 1e-9).alias("sure"), F.xxhash64("doc_id", "text_h", F.lit(seed)).alias("rank")).withColumn("p", F.greatest(F.lit(0.0), F.col("n") * F.col("part") - F.col("sure")))
    blocks = max(1, units.count() // BLOCK_ROWS)
    settled: list[DataFrame] = []
    kept = units.columns
    while True:
        flown = materialize(_fly(units.select(kept), blocks, seed, blocks == 1), "mix-flight").select(kept)
        spent.append(flown)
        if blocks == 1:
            settled.append(flown)
            break
        fixed = (F.col("p") == 0) | (F.col("p") == 1)
        settled.append(flown.where(fixed))
        units = flown.where(~fixed)
        blocks = blocks * LEFT_ROWS // BLOCK_ROWS or 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    # a row for each of the n rows, spread in two steps, as n has no bound
    out = out.withColumn("extra", F.col("sure") + F.round("p").cast("long")).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPREAD))))
    out = out.withColumn("no", F.explode(F.sequence(F.col("lot") * SPREAD + 1, F.least(F.col("n"), (F.col("lot") + 1) * SPREAD))))
    copies = F.col("whole") + F.when(F.col("no") <= F.col("extra"), 1).otherwise(0)
    out = materialize(out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "text_h"), "mix")
    drop_scratch(docs.sparkSession, *spent)
    return out


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, columns unchanged."""
    doc, source, h, copies, n, own, no, each = fresh(docs.columns, "mix_id", "mix_source", "mix_h", "mix_copies", "mix_n", "text_h", "mix_no", "mix_each")
    taken = materialize(mix(docs, seed).groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("text_h").alias(h)).agg(F.sum("copies").alias(copies), F.count("*").alias(n)), "mix-taken")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(h))
    joined = docs.withColumn(own, F.xxhash64("text")).join(taken.where(F.col(copies) > 0).hint("shuffle_hash"), same)
    whole = joined.where(F.col(n) == 1).withColumn(no, F.lit(1))
    if taken.where(F.col(n) > 1).limit(1).count():  # equal rows are numbered
        several = joined.where(F.col(n) > 1).withColumn(no, F.row_number().over(Window.partitionBy(doc, source, h).orderBy(own)))
        whole = whole.unionByName(several)
    times = F.floor(F.col(copies) / F.col(n)) + F.when(F.col(no) <= F.col(copies) % F.col(n), 1).otherwise(0)
    times = times.cast("int")
    return whole.where(times > 0).withColumn(each, F.explode(F.sequence(F.lit(1), times))).drop(doc, source, h, copies, n, own, no, each)
