"""Entity-hit rate, script fidelity, error rates, scorecards and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.functions.distance import char_edits, strip, word_edits, words
from lipika.functions.hits import hit, hypothesis
from lipika.functions.text import match_norm, once, script_fidelity, text, tight


def ratio(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if zero is None else F.coalesce(r, F.lit(zero))


def score_tokens(pairs: DataFrame, norm=match_norm, tight_form=tight, amount_as_currency: bool = False, norms: str | None = None) -> DataFrame:
    """Rows (…, lang, hypothesis, entity_tokens) with `hits`: one boolean for each token.

    The hypothesis is normalised once per row; surfaces once per token, in one pass over the row's array. norms: a column that
    has token_norms already, for references that meet several hypotheses.
    """
    tokens = F.coalesce("entity_tokens", F.array().cast("array<struct<surface:string,start:int,end:int,type:string>>"))
    surface = lambda t: F.coalesce(t["surface"], F.lit(""))
    norms = F.col(norms) if norms else token_norms(norm)

    def hits(made: Column) -> Column:
        return F.zip_with(tokens, made["norms"], lambda t, n: hit(F.coalesce(t["type"], F.lit("")), surface(t), n, made["hyp"], F.col("lang"), amount_as_currency))

    hyp = hypothesis(norm(F.col("hypothesis")), tight_form(F.col("hypothesis")), text("hypothesis"))
    return pairs.withColumn("hits", once(F.struct(hyp.alias("hyp"), norms.alias("norms")), hits))


def token_norms(norm=match_norm) -> Column:
    """Normal forms of entity_tokens' surfaces."""
    surfaces = F.transform(F.coalesce(F.col("entity_tokens.surface"), F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")))
    return norm_each(surfaces) if norm is match_norm else F.transform(surfaces, norm)


def norm_each(surfaces: Column) -> Column:
    """match_norm of the strings of an array."""
    from lipika.functions.text import _py_match

    def each(s):
        return s.map(lambda row: [_py_match(x) for x in row])

    return F.pandas_udf(each, "array<string>")(surfaces)


def row_scores(scored: DataFrame) -> DataFrame:
    """n_tokens, n_hits and by_type (map of hits and total) of each row."""
    n = F.coalesce(F.size("entity_tokens"), F.lit(0))
    kinds = F.array_distinct(F.transform(F.coalesce("entity_tokens", F.array()), lambda t: t["type"]))
    pairs = F.arrays_zip(F.col("entity_tokens.type").alias("type"), F.col("hits").alias("hit"))
    by_type = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.struct(F.size(F.filter(pairs, lambda p: (p["type"] == k) & p["hit"])).alias("hits"), F.size(F.filter(pairs, lambda p: p["type"] == k)).alias("total")))))
    return scored.withColumn("n_tokens", F.greatest(n, F.lit(0))).withColumn("n_hits", F.size(F.filter("hits", lambda h: h))).withColumn("by_type", by_type)


def row_scores_only(scored: DataFrame) -> DataFrame:
    """row_scores without the map by type."""
    return scored.withColumn("n_tokens", F.size("hits")).withColumn("n_hits", F.size(F.filter("hits", lambda h: h)))


def ehr_sets(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Micro EHR overall and by each key, in one pass; rows without tokens keep their key alive."""
    sums = [F.count("*").alias("n_rows"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.sum("n_hits").cast("long").alias("n_hits")]
    if not keys:
        return scores.agg(*sums).select(F.lit("overall").alias("grouping"), F.lit("").alias("key"), "*", F.round(ratio(F.col("n_hits"), F.col("n_tokens")), 4).alias("ehr"))
    sets = scores.groupingSets([[], *[[k] for k in keys]], *keys).agg(*sums, F.grouping_id().alias("level"))
    full = 2 ** len(keys) - 1
    name, value = F.lit("overall"), F.lit("")
    for i, k in enumerate(keys):
        here = F.col("level") == full - 2 ** (len(keys) - 1 - i)
        name, value = F.when(here, k).otherwise(name), F.when(here, F.col(k)).otherwise(value)
    return sets.select(name.alias("grouping"), value.alias("key"), "n_rows", "n_tokens", "n_hits", F.round(ratio(F.col("n_hits"), F.col("n_tokens")), 4).alias("ehr"))


def ehr_by_type(scored: DataFrame) -> DataFrame:
    each = scored.select(F.inline(F.arrays_zip(F.col("entity_tokens.type").alias("type"), F.col("hits").alias("hit"))))
    return each.groupBy("type").agg(F.count("*").alias("n_tokens"), F.count_if("hit").alias("n_hits")).withColumn("ehr", F.round(ratio(F.col("n_hits"), F.col("n_tokens")), 4))


def ehr_macro(by_class: DataFrame) -> DataFrame:
    """Mean EHR over classes that have tokens."""
    return by_class.where("n_tokens > 0").agg(F.avg(ratio(F.col("n_hits"), F.col("n_tokens"))).alias("ehr_macro"))


def edits(pairs: DataFrame, ref: str = "text", hyp: str = "hypothesis") -> DataFrame:
    """Word and character edits and reference lengths of each row."""
    return (
        pairs.withColumn("word_edits", word_edits(ref, hyp))
        .withColumn("ref_words", F.size(words(ref)))
        .withColumn("char_edits", char_edits(ref, hyp))
        .withColumn("ref_chars", F.length(strip(ref)))
    )


def scorecard(pairs: DataFrame, by: list[str], ehr: bool = True) -> DataFrame:
    """n, ehr, hits, tokens, mean SFR, WER, CER, blank hypotheses by group, from (lang, text, hypothesis[, entity_tokens])."""
    df = edits(pairs).withColumn("sfr", script_fidelity("hypothesis", "lang"))
    aggs = [F.count("*").alias("n")]
    if ehr:
        df = row_scores(score_tokens(df))
        aggs += [F.sum("n_hits").cast("long").alias("n_hits"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.round(ratio(F.sum("n_hits"), F.sum("n_tokens")), 4).alias("ehr")]
    aggs += [
        F.round(F.avg("sfr"), 4).alias("sfr_mean"),
        F.round(ratio(F.sum("word_edits"), F.sum("ref_words"), None), 4).alias("wer"),
        F.round(ratio(F.sum("char_edits"), F.sum("ref_chars"), None), 4).alias("cer"),
        F.count_if(F.trim(text("hypothesis")) == "").alias("n_empty_hyp"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def long_form(predictions: DataFrame, systems: dict[str, str]) -> DataFrame:
    """One row per system from one column per system ({system: column})."""
    ids = [c for c in predictions.columns if c not in systems.values()]
    renamed = predictions.select(*ids, *[F.col(c).alias(s) for s, c in systems.items()])
    return renamed.unpivot(ids, list(systems), "system", "hypothesis")


def wer_delta(cards: DataFrame, adapter: str, base: str, on: list[str], ceiling: float = 0.02) -> DataFrame:
    """WER of one system less another's on the same hold-outs, and whether it stays under the ceiling."""
    a = cards.where(F.col("system") == adapter).select(*on, F.col("wer").alias("wer_adapter"))
    b = cards.where(F.col("system") == base).select(*on, F.col("wer").alias("wer_base"))
    return a.join(b, on).withColumn("delta", F.round(F.col("wer_adapter") - F.col("wer_base"), 4)).withColumn("within", F.col("delta") <= ceiling)


def matched_rows(pairs: DataFrame, adapter: str, base: str) -> DataFrame:
    """Rows of both systems whose ids both have."""
    both = pairs.where(F.col("system").isin(adapter, base)).groupBy("id").agg(F.count_distinct("system").alias("_n")).where("_n = 2").select("id")
    return pairs.join(both, "id", "left_semi")


def sfr_trigger(cards: DataFrame, system: str, below: float = 0.85, holdouts: int = 2) -> DataFrame:
    """Languages in which a system's mean SFR is low on enough hold-outs."""
    return cards.where(F.col("system") == system).groupBy("lang").agg(F.count_if(F.col("sfr_mean") < below).alias("n_low"), F.count("*").alias("n_holdouts")).withColumn("adapter", F.col("n_low") >= holdouts)


def win_criteria(cards: DataFrame, system: str, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """{name: (column, '>=' or '<=', bound)} as booleans over a system's scorecards."""
    out = cards.where(F.col("system") == system)
    for name, (c, op, bound) in rules.items():
        out = out.withColumn(name, F.coalesce(F.col(c) >= bound if op == ">=" else F.col(c) <= bound, F.lit(False)))
    return out.withColumn("wins", F.forall(F.array(*[F.col(n) for n in rules]), lambda x: x))


def bootstrap_ci(rows: DataFrame, id_col: str, hits: str, total: str, by: list[str] | None = None, replicas: int = 1000, seed: int = 1337, level: float = 0.95) -> DataFrame:
    """Percentile interval of Σhits/Σtotal: Poisson(1) weights by hash of (id, replica), so no row is moved or drawn twice.

    Partial sums of all replicas are made where the rows are; what is shuffled is a row per replica and task.
    """
    by = by or []
    u = (F.pmod(F.xxhash64(F.col(id_col), F.col("replica"), F.lit(seed)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    # inverse of the Poisson(1) distribution function
    cuts, p, c = [], 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        cuts.append(c)
        p /= k
        c += p
    weight = sum((F.when(u > x, 1).otherwise(0) for x in cuts), F.lit(0))
    each = rows.select(*by, id_col, hits, total, F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica")).withColumn("_w", weight)
    sums = each.groupBy(*by, "replica").agg(F.sum(F.col("_w") * F.col(hits)).alias("h"), F.sum(F.col("_w") * F.col(total)).alias("t"))
    tail = (1 - level) / 2
    rate = ratio(F.col("h"), F.col("t"))
    return sums.groupBy(*by).agg(F.expr(f"percentile(h / nullif(t, 0), array({tail}, {1 - tail}))").alias("ci"), F.avg(rate).alias("mean")).select(*by, F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), "mean")


def duration_cost(df: DataFrame, by: list[str], seconds: str = "duration_s", per_minute: float = 0.0043) -> DataFrame:
    """Total minutes and their price."""
    minutes = F.coalesce(F.sum(seconds), F.lit(0.0)) / 60
    return df.groupBy(*by).agg(minutes.alias("minutes")).withColumn("cost", F.col("minutes") * per_minute)


def cer_filter(pairs: DataFrame, most: float = 0.5, ref: str = "text", hyp: str = "hypothesis") -> DataFrame:
    """Rows whose own character error rate is at most `most`; rows without reference characters go."""
    return pairs.where(F.coalesce(F.try_divide(char_edits(ref, hyp), F.length(strip(ref))) <= most, F.lit(False)))
