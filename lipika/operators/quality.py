"""Row validation, multi-label audit and first-match cleaning. The three have rule sets of their own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.functions import lexicon as lx
from lipika.functions.text import block_count, col, has_block, has_latin_word, latin_count, text, token_count
from lipika.sources.scratch import spare, written

MIN_TOKENS, MAX_TOKENS = 3, 25
LATIN_CAP, BRAND_LATIN_CAP = 8, 30
W = r"[A-Za-z0-9_\p{L}\p{N}]"
#: Refusals are searched anywhere; formatting only where the text begins.
APOLOGY = rf"(?iu)(?<!{W})(?:{'|'.join(map(re.escape, lx.APOLOGY_WORDS))})(?!{W})"
AUDIT_LEAK = rf"(?iu)^(?:{'|'.join([*lx.LEAK_STARTS, lx.LEAK_PHRASE])})"
CLEAN_LEAK = rf"(?iu)^(?:{'|'.join(lx.LEAK_STARTS)})"


def _own_block(c: Column, lang: Column) -> Column:
    out = F.lit(False)
    for code in lx.LANGS:
        out = F.when(lang == code, has_block(c, *lx.SCRIPT_RANGES[code][0])).otherwise(out)
    return out


def _spelled(c: Column, lang: Column) -> Column:
    out = F.lit(False)
    for code, words in lx.SPELLED_DIGITS.items():
        out = F.when(lang == code, c.rlike("|".join(map(re.escape, words)))).otherwise(out)
    return out


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


# --- validation -------------------------------------------------------------------------------


def length_ok(c: Column | str, low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> Column:
    return token_count(c).between(low, high)


def script_pure(c: Column | str, lang: Column | str) -> Column:
    """No letter, mark or Indic-range character outside the language's block; ASCII, joiners, punctuation, symbols and
    separators pass. True for an unknown language."""
    out = F.lit(True)
    for code in lx.LANGS:
        lo, hi = lx.SCRIPT_RANGES[code][0]
        other = rf"[[\p{{L}}\p{{M}}\x{{0900}}-\x{{0DFF}}]&&[^\x{{{lo:04X}}}-\x{{{hi:04X}}}]&&[^\x00-\x7F]&&[^\p{{P}}\p{{S}}\p{{Z}}\x{{200C}}\x{{200D}}\x{{00A0}}]]"
        out = F.when(col(lang) == code, ~text(c).rlike(other)).otherwise(out)
    return out


def entity_present(c: Column | str, entity_class: Column | str, seeds: list[str] | None = None) -> Column:
    """A cheap sign of an entity by class. `seeds` are surfaces; an empty surface is in any text."""
    t, cls = text(c), col(entity_class)
    seeded = F.exists(F.array(*map(F.lit, seeds)), lambda s: F.contains(t, s)) if seeds else F.lit(False)
    digits = t.rlike(r"\p{Nd}{2,}") | (F.exists(F.array(*map(F.lit, seeds)), lambda s: (s != "") & F.contains(t, s)) if seeds else F.lit(True))
    return (
        F.when(cls == "digits", digits)
        .when(cls == "currency", has_digit(t) | t.rlike("|".join(map(re.escape, lx.CURRENCY_MARKERS))))
        .when(cls == "addresses", t.rlike(r"\p{Nd}{3,}"))
        .when(cls == "brands", has_latin_word(t) | seeded)
        .when(cls == "codemix", has_latin_word(t))
        .otherwise(True)
    )


def validation_reason(c: Column | str, lang: Column | str, entity_class: Column | str, seeds: list[str] | None = None) -> Column:
    """First failing check, or ok."""
    return F.when(~length_ok(c), "length").when(~script_pure(c, lang), "script_purity").when(~entity_present(c, entity_class, seeds), "entity_missing").otherwise("ok")


def conversational(df: DataFrame) -> DataFrame:
    """Usable conversational rows: not read speech, 10 characters or more, 1 to 25 seconds, audio there."""
    return df.where((F.coalesce("scenario", F.lit("")) != "Read") & (F.length(F.trim(text("text"))) >= 10) & F.col("duration").between(1.0, 25.0) & F.col("audio").isNotNull())


def usable_text(df: DataFrame, c: str = "text") -> DataFrame:
    return df.where(text(c) != "")


def _place(file: list[str], key: str, out: str, order: str) -> Column:
    """Place among the rows of one file and key; rows that are `out` of the count are dealt by their order, for balance."""
    apart = F.when(F.col(out), F.pmod(F.xxhash64(order), F.lit(4096)))
    return F.row_number().over(Window.partitionBy(*file, key, out, apart).orderBy(order))


# --- audit ------------------------------------------------------------------------------------

ISSUE = "struct<type:string,n_tokens:int,n_chars:int,text:string,has_indic:boolean,has_latin:boolean>"


def _issue(when: Column, kind: Column | str, **fields: Column) -> Column:
    names = {"n_tokens": "int", "n_chars": "int", "text": "string", "has_indic": "boolean", "has_latin": "boolean"}
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(kind.alias("type"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]))


def audit(df: DataFrame, key: Column, order: str = "ord", file: list[str] | None = None, script_rules: bool = True) -> DataFrame:
    """Rows with their issues (array), every rule that applies. A row without tokens has only empty_text.

    key: the duplicate key; order: position in the file; file: columns that name a file (lang, entity_class).
    script_rules: off for languages without a block of their own.
    """
    file = file or ["lang", "entity_class"]
    t, lang, cls = text("text"), F.col("lang"), F.col("entity_class")
    n = token_count(t)
    short = F.substr(t, F.lit(1), F.lit(80))
    latin = latin_count(t)
    rules = [
        _issue(n < MIN_TOKENS, "too_short", n_tokens=n, text=t),
        _issue(n > MAX_TOKENS, "too_long", n_tokens=n, text=short),
        _issue(t.rlike(APOLOGY), "apology_leakage", text=short),
        _issue(t.rlike(AUDIT_LEAK), "format_leakage", text=short),
    ]
    if script_rules:
        foreign, count = F.lit(None).cast("string"), F.lit(0)
        for code in lx.LANGS:
            for name, lo, hi in reversed(lx.FOREIGN_BLOCKS[code]):
                here = (lang == code) & has_block(t, lo, hi)
                foreign = F.when(here, f"foreign_script_{name}").otherwise(foreign)
                count = F.when(here, block_count(t, lo, hi)).otherwise(count)
        own, any_latin = _own_block(t, lang), latin > 0
        rules += [
            _issue(foreign.isNotNull(), foreign, n_chars=count, text=short),
            _issue((cls != "codemix") & (latin > LATIN_CAP), "excess_latin_in_indic", n_chars=latin, text=short),
            _issue((cls == "codemix") & ~(own & any_latin), "codemix_not_mixed", has_indic=own, has_latin=any_latin, text=short),
            _issue((cls != "codemix") & ~own, "missing_target_script", text=short),
            _issue((cls == "digits") & ~(has_digit(t) | _spelled(t, lang)), "digits_no_digits", text=short),
        ]
    if "entity_tokens" in df.columns:
        rules.append(_issue(cls.isin("digits", "currency", "addresses", "brands") & (F.coalesce(F.size("entity_tokens"), F.lit(0)) <= 0), "no_entity_tokens_warn", text=short))
    # rows without tokens don't enter the duplicate check
    k, empty, place = spare(df, "_key", "_empty", "_place")
    counted = df.withColumn(k, F.sha2(key, 256)).withColumn(empty, n == 0)
    rules.append(_issue(F.col(place) > 1, "duplicate_within_file", text=F.substr(t, F.lit(1), F.lit(60))))
    issues = F.when(n == 0, F.array(_issue(F.lit(True), "empty_text"))).otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return counted.withColumn(place, _place(file, k, empty, order)).withColumn("issues", issues).drop(k, empty, place)


def issue_counts(audited: DataFrame, by: list[str]) -> DataFrame:
    """Issues by file and type, with totals by type (file columns null)."""
    each = audited.select(*by, F.explode("issues.type").alias("type"))
    return each.rollup("type", *by).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where(F.col("level").isin(0, 2 ** len(by) - 1)).drop("level")


def first_examples(audited: DataFrame, order: list[str]) -> DataFrame:
    """Of each issue type, its first row."""
    each = audited.select(F.struct(*order, "text").alias("row"), F.explode("issues.type").alias("type"))
    return each.groupBy("type").agg(F.min("row").alias("row")).select("row.*", "type")


def cross_class_duplicates(df: DataFrame, key: Column, group: list[str], cls: str, order: str, keep: int = 5) -> DataFrame:
    """Texts that occur in two or more classes of a group: number of classes and rows, first instances.

    Counts are made by class and then by text, and only the first `keep` rows of a text in each task are ranked, so a text
    that many rows hold (the empty one) is not sorted by one task.
    """
    each = df.select(*group, key.alias("key"), F.col(cls).alias("class"), F.struct(order, cls).alias("row"), F.col(order).alias("at"))
    by = [*group, "key"]
    counts = each.groupBy(*by, "class").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("class").alias("n_classes"), F.sum("n").alias("n_rows")).where("n_classes > 1")
    ranked = each.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("nth") <= keep)
    first = ranked.groupBy(*by).agg(F.sort_array(F.collect_list("row")).alias("instances"))
    c, f = counts.alias("c"), first.alias("f")
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"f.{x}")) for x in by]
    return c.join(f, same).select("c.*", "f.instances")


# --- cleaning ---------------------------------------------------------------------------------


def clean_reason(script_rules: bool = True) -> Column:
    """First reason to drop a row (id, lang, entity_class, text), or null. Duplicates are looked at afterwards."""
    t, lang, cls = text("text"), F.col("lang"), F.col("entity_class")
    n = token_count(t)
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    latin = latin_count(t)
    out = (
        F.when(missing("id") | missing("lang") | missing("entity_class"), "empty_metadata")
        .when(n == 0, "empty_text")
        .when(n < MIN_TOKENS, "too_short")
        .when(n > MAX_TOKENS, "too_long")
        .when(t.rlike(APOLOGY), "apology_leakage")
        .when(t.rlike(CLEAN_LEAK), "format_leakage")
    )
    if not script_rules:
        return out
    foreign = F.lit(False)
    for code in lx.LANGS:
        for _, lo, hi in lx.FOREIGN_BLOCKS[code]:
            foreign = foreign | ((lang == code) & has_block(t, lo, hi))
    return (
        out.when(~lang.isin(lx.LANGS), "unknown_lang")
        .when(foreign, "foreign_indic_script")
        .when((cls != "codemix") & (latin > F.when(cls == "brands", BRAND_LATIN_CAP).otherwise(LATIN_CAP)), "excess_latin_in_indic")
        .when((cls != "codemix") & ~_own_block(t, lang), "missing_target_script")
        .when((cls == "codemix") & (latin == 0), "codemix_no_latin")
        .when((cls == "digits") & ~(has_digit(t) | _spelled(t, lang)), "digits_no_digits")
    )


def clean(df: DataFrame, key: Column, order: str = "ord", file: list[str] | None = None, script_rules: bool = True) -> DataFrame:
    """Rows with their drop reason (null: kept); later copies among the rows that passed are 'duplicate'."""
    file = file or ["lang", "entity_class"]
    k, out, place = spare(df, "_key", "_out", "_place")
    marked = df.withColumn("reason", clean_reason(script_rules)).withColumn(k, F.sha2(key, 256)).withColumn(out, F.col("reason").isNotNull())
    marked = marked.withColumn(place, _place(file, k, out, order))
    return marked.withColumn("reason", F.when(~F.col(out) & (F.col(place) > 1), "duplicate").otherwise(F.col("reason"))).drop(k, out, place)


def renumber(cleaned: DataFrame, order: str = "ord", file: list[str] | None = None) -> DataFrame:
    """Kept rows; where a file lost rows, ids run from 000000 in file order.

    Rows are written in order, kept ones first, so a file of any size is dealt over many tasks: a row's number is its place in
    the part it was written to plus the file's kept rows in earlier parts.
    """
    file = file or ["lang", "entity_class"]
    names = [c for c in cleaned.columns if c != "reason"]
    keys = [f"f{i}" for i in range(len(file))]
    rows = cleaned.select(F.struct(*names).alias("row"), F.col("reason").isNotNull().alias("out"), F.col(order).alias("at"), *(F.col(f).alias(k) for f, k in zip(file, keys, strict=True)))
    by = [*keys, "out", "at"]
    rows = written(rows.repartitionByRange(*by).sortWithinPartitions(*by), "renumber")
    part = F.split("_metadata.file_name", "-")[1].cast("int")
    rows = rows.select("*", part.alias("part"), F.col("_metadata.row_index").alias("place"))
    # language and class of the first row that was kept
    first = F.min(F.when(~F.col("out"), F.struct("at", F.col("row.lang").alias("lang"), F.col("row.entity_class").alias("entity_class"))))
    files = rows.groupBy(*keys).agg(F.max("out").alias("lost"), first.alias("first"))
    kept = rows.where(~F.col("out"))
    parts = kept.groupBy(*keys, "part").agg(F.min("place").alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "part", (before - F.col("from")).alias("shift"))

    def same(a: DataFrame, b: DataFrame, *more: str) -> Column:
        out = F.lit(True)
        for c in (*keys, *more):
            out = out & a[c].eqNullSafe(b[c])
        return out

    f, p = files.alias("f"), parts.alias("p")
    shifts = p.join(f, same(parts, files)).select(*(F.col(f"p.{c}") for c in (*keys, "part", "shift")), "lost", "first")
    joined = kept.join(shifts, same(kept, shifts, "part"))
    new = F.format_string("%s_%s_%06d", "first.lang", "first.entity_class", F.col("place") + F.col("shift"))
    ids = F.when(F.col("lost"), new).otherwise(F.col("row.id").cast("string"))
    return joined.select(*(ids.alias("id") if c == "id" else F.col("row").getField(c).alias(c) for c in names))


def reason_counts(cleaned: DataFrame, by: list[str]) -> DataFrame:
    """Rows before and after, and by reason, per file and in total."""
    reason = F.coalesce("reason", F.lit("kept"))
    return cleaned.withColumn("reason", reason).rollup("reason", *by).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where(F.col("level").isin(0, 2 ** len(by) - 1)).drop("level")


