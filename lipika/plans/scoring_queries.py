"""Queries on scoring, scorecards, joins, samples and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import hits as h
from lipika.functions import tagger
from lipika.functions.text import once, plain_norm, script_fidelity
from lipika.operators import metrics as m
from lipika.operators import planning as pl
from lipika.operators import relational as rel
from lipika.plans.base import SQL_PAIRS, SQL_SENTENCES, plain_tight, query, sentences, spoken_pairs, sql_norm, table


def tagged_pairs(spark: SparkSession, sf_dir: str, cls: str = "codemix") -> DataFrame:
    """Spoken pairs whose references are tagged; a token is a surface and its type, without offsets."""
    kind, pattern = tagger.PATTERNS[cls]
    surfaces = tagger.surfaces("text", pattern)
    tokens = F.transform(surfaces, lambda s: F.struct(s.alias("surface"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(kind).alias("type")))
    return spoken_pairs(table(spark, sf_dir, "documents")).withColumn("entity_tokens", tokens)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.row_scores_only(m.score_tokens(tagged_pairs(spark, sf_dir), norm=plain_norm, tight_form=plain_tight))


_LOAN = "[A-Za-z][A-Za-z0-9''-]*"
_SCORES = f"""{SQL_PAIRS},
found AS (SELECT *, regexp_extract_all(text, '{_LOAN}') AS m, {sql_norm('hypothesis')} AS norm FROM pairs),
scores AS (SELECT *, len(m) AS n_tokens, len(list_filter(m, lambda s: contains(norm, lower(s)))) AS n_hits FROM found)"""
_EHR = "coalesce(round(CAST(sum(n_hits) AS DOUBLE) / nullif(sum(n_tokens), 0), 4), 0.0)"


@query(f"WITH {_SCORES} SELECT count(*) AS n_rows, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_hits) AS BIGINT) AS n_hits, {_EHR} AS ehr FROM scores")
def ehr_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ehr_sets(_scored(spark, sf_dir), []).drop("grouping", "key")


@query(f"""WITH {_SCORES} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS grouping,
  CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE '' END AS key, count(*) AS n_rows, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_hits) AS BIGINT) AS n_hits, {_EHR} AS ehr
FROM scores GROUP BY GROUPING SETS ((), (lang), (source))""")
def ehr_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ehr_sets(_scored(spark, sf_dir), ["lang", "source"])


@query(f"WITH {_SCORES}, sums AS (SELECT source, sum(n_tokens) AS t, sum(n_hits) AS h FROM scores GROUP BY source) SELECT round(avg(CAST(h AS DOUBLE) / t), 4) AS ehr_macro FROM sums WHERE t > 0")
def ehr_macro_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _scored(spark, sf_dir).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_hits").alias("n_hits"))
    return m.ehr_macro(by).select(F.round("ehr_macro", 4).alias("ehr_macro"))


def _hit_counts(spark: SparkSession, sf_dir: str, cls: str, rule: h.Rule) -> DataFrame:
    pairs = tagged_pairs(spark, sf_dir, cls)
    hyp = h.hypothesis(plain_norm("hypothesis"), plain_tight("hypothesis"), F.col("hypothesis"))
    hits = once(hyp, lambda y: F.size(F.filter("entity_tokens", lambda t: rule(t["surface"], F.lower(t["surface"]), y, F.col("lang"))))).cast("long")
    rows = pairs.select("lang", F.size("entity_tokens").cast("long").alias("n"), hits.alias("h"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.sum("h").alias("n_hits"))


def _sql_hits(pattern: str, test: str) -> str:
    return f"""WITH {SQL_PAIRS}, s AS (SELECT lang, regexp_extract_all(text, '{pattern}') AS m, replace(hypothesis, ' ', '') AS tight, {sql_norm('hypothesis')} AS norm FROM pairs)
SELECT lang, CAST(sum(len(m)) AS BIGINT) AS n_tokens, CAST(sum(len(list_filter(m, lambda s: {test}))) AS BIGINT) AS n_hits FROM s GROUP BY lang"""


@query(_sql_hits(r"\p{Nd}+", "contains(tight, s)"))
def hit_digit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_counts(spark, sf_dir, "digits", h.digit_run)


@query(_sql_hits(r"\p{Nd}+", "length(s) = 6 AND contains(tight, s)"))
def hit_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_counts(spark, sf_dir, "digits", h.pincode)


@query(_sql_hits(r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?", "contains(norm, lower(s))"))
def hit_house_or_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_counts(spark, sf_dir, "currency", h.substring)


@query(_sql_hits("[A-Z][A-Za-z]+", "list_contains(regexp_split_to_array(norm, ' '), lower(s))"))
def hit_proper_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_counts(spark, sf_dir, "proper_nouns", h.proper_noun)


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_brand IN ('Brand#1', 'Brand#2'))) AS n_hits FROM part GROUP BY p_brand""")
def hit_brand_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two brands have an alias; a third of the rows name the brand itself, a third its alias form, a third nothing
    aliases = {"brand#1": "brand#1", "first brand": "brand#1", "brand#2": "brand#2", "second brand": "brand#2"}
    spoken = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("buy "), F.lower("p_brand"), F.lit(" now"))).when((F.col("p_partkey") % 3 == 1) & (F.col("p_brand") == "Brand#1"), "the first brand").when((F.col("p_partkey") % 3 == 1) & (F.col("p_brand") == "Brand#2"), "the second brand").otherwise("nothing")
    hyp = h.hypothesis(spoken, spoken, spoken)
    hit = h.brand_of(aliases)(F.col("p_brand"), F.lower("p_brand"), hyp, F.lit("en"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hits"))


@query("""WITH t AS (SELECT o_orderpriority, floor(o_totalprice / 1000) AS g, floor(o_totalprice / 1000) + o_orderkey % 4 AS x, o_orderkey % 2 AS lakh FROM orders)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (CASE WHEN g = 0 THEN x < 0.5 ELSE abs(x * CASE WHEN lakh = 1 THEN 100000 ELSE 1000 END - g * CASE WHEN lakh = 1 THEN 100000 ELSE 1000 END) / (g * CASE WHEN lakh = 1 THEN 100000 ELSE 1000 END) <= 0.005 END) AS n_hits FROM t GROUP BY o_orderpriority""")
def hit_currency_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("o_orderkey") % 2 == 1, " lakh rupees").otherwise(" thousand rupees")
    n = F.floor(F.col("o_totalprice") / 1000).cast("long")
    said = lambda c: F.concat(c.cast("string"), unit)
    hyp = said(n + F.col("o_orderkey") % 4)
    hit = h.currency_amount(said(n), said(n), h.hypothesis(hyp, hyp, hyp), F.lit("en"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hits"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 0 AS j FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT w.user_id, e.n, w.j + 1 FROM walk w, LATERAL (SELECT min(n) AS n FROM e WHERE e.user_id = w.user_id AND e.n > w.n AND e.event_type = ['view', 'click', 'signup', 'purchase'][w.j + 1]) e WHERE w.j < 4 AND e.n IS NOT NULL)
SELECT user_id, CAST(max(j) AS INT) AS matched FROM walk GROUP BY user_id""")
def spelled_digit_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.array(*map(F.lit, ["view", "click", "signup", "purchase"]))
    seq = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return seq.select("user_id", h.in_order(want, F.col("s.event_type")).alias("matched"))


# --- error rates and scorecards ---------------------------------------------------------------


@query("""WITH w AS (SELECT list(DISTINCT x ORDER BY x) AS v FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part)),
p AS (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS r, lead(string_split(p_name, ' ')) OVER (ORDER BY p_partkey) AS h FROM part),
c AS (SELECT p_brand, len(r) AS n, array_to_string(list_transform(r, lambda x: chr(CAST(65 + list_position(w.v, x) AS INT))), '') AS a, array_to_string(list_transform(h, lambda x: chr(CAST(65 + list_position(w.v, x) AS INT))), '') AS b FROM p, w WHERE h IS NOT NULL)
SELECT p_brand, count(*) AS n, CAST(sum(levenshtein(a, b)) AS BIGINT) AS word_edits, CAST(sum(n) AS BIGINT) AS ref_words, round(CAST(sum(levenshtein(a, b)) AS DOUBLE) / sum(n), 4) AS wer FROM c GROUP BY p_brand""")
def wer_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("hypothesis"))
    rows = m.edits(part.withColumnRenamed("p_name", "text").join(nxt, "p_partkey"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("word_edits").cast("long").alias("word_edits"), F.sum("ref_words").cast("long").alias("ref_words"), F.round(m.ratio(F.sum("word_edits"), F.sum("ref_words")), 4).alias("wer"))


# the built-in distance of the other engine counts bytes: the table's characters are coded as characters of one byte each
SQL_TURN_CODES = r"""c AS (SELECT conv_id, turn, role, trim(text) AS t FROM conversations),
v AS (SELECT list(x ORDER BY x) AS v FROM (SELECT DISTINCT unnest(string_split(t, '')) AS x FROM c)),
p AS (SELECT a.conv_id, a.turn, a.role, a.t AS r, b.t AS h FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
coded AS (SELECT *, array_to_string(list_transform(string_split(r, ''), lambda x: chr(CAST(list_position(v.v, x) AS INT))), '') AS a,
  array_to_string(list_transform(string_split(h, ''), lambda x: chr(CAST(list_position(v.v, x) AS INT))), '') AS b FROM p, v)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a reference, the next one as its hypothesis."""
    rows = table(spark, sf_dir, "conversations")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return rows.join(nxt, ["conv_id", "turn"])


@query(f"""WITH {SQL_TURN_CODES}
SELECT role, count(*) AS n, CAST(sum(levenshtein(a, b)) AS BIGINT) AS char_edits, CAST(sum(length(r)) AS BIGINT) AS ref_chars, round(CAST(sum(levenshtein(a, b)) AS DOUBLE) / sum(length(r)), 4) AS cer FROM coded GROUP BY role""")
def cer_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).select("role", m.char_edits("text", "hypothesis").alias("e"), F.length(m.strip("text")).alias("l"))
    return pairs.groupBy("role").agg(F.count("*").alias("n"), F.sum("e").cast("long").alias("char_edits"), F.sum("l").cast("long").alias("ref_chars"), F.round(m.ratio(F.sum("e"), F.sum("l")), 4).alias("cer"))


# texts in the scripts that the driver's tables don't hold; the answers are worked out by hand from the rules
_SPOKEN = [
    ("te", "నా ఫోన్ 98765", "నా ఫోన్ ౯౮ 98765", "digit_run", "98765"),
    ("te", "స్విగ్గి నుండి ఆర్డర్", "Swiggy నుండి ఆర్డర్", "brand", "స్విగ్గి"),
    ("hi", "पिन 560034 है", "पिन 560035 है", "pincode", "560034"),
    ("hi", "दो लाख रुपये", "200000 रुपये", "currency_amount", "दो लाख"),
    ("ta", "ஒன்று இரண்டு", "ஒன்று மூன்று இரண்டு", "spelled_digit", "ஒன்று இரண்டு"),
    ("ta", "பெயர் ரவி", "", "proper_noun", "ரவி"),
]


@query("""SELECT lang, CAST(n AS BIGINT) AS n, CAST(h AS BIGINT) AS n_hits, CAST(t AS BIGINT) AS n_tokens, CAST(ehr AS DOUBLE) AS ehr, CAST(sfr AS DOUBLE) AS sfr_mean, CAST(wer AS DOUBLE) AS wer, CAST(e AS BIGINT) AS n_empty_hyp
FROM (VALUES ('te', 2, 2, 2, 1.0, 0.75, 0.3333, 0), ('hi', 2, 1, 2, 0.5, 1.0, 0.5, 0), ('ta', 2, 1, 2, 0.5, 1.0, 0.75, 1)) v(lang, n, h, t, ehr, sfr, wer, e)""")
def scorecard_indic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scorecard on the full normal forms."""
    rows = spark.createDataFrame(_SPOKEN, "lang string, text string, hypothesis string, kind string, surface string")
    token = F.struct("surface", F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("kind").alias("type"))
    return m.scorecard(rows.withColumn("entity_tokens", F.array(token)), ["lang"]).drop("cer")


LATE = "^[^ ]* ?"


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems' hypotheses for each spoken pair, in long form, scored row by row: one starts a word late, one is silent at times."""
    wide = tagged_pairs(spark, sf_dir).withColumn("sys_late", F.regexp_replace("hypothesis", LATE, "")).withColumn("sys_blank", F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("hypothesis"))).withColumnRenamed("hypothesis", "sys_same")
    # what the reference gives is made before its rows are tripled
    long = m.long_form(wide.withColumn("norms", m.token_norms(plain_norm)).drop("text"), {"late": "sys_late", "blank": "sys_blank", "same": "sys_same"})
    scored = m.score_tokens(long, norm=plain_norm, tight_form=plain_tight, norms="norms")
    return m.row_scores_only(scored).withColumn("sfr", script_fidelity("hypothesis", F.lit("en")))


_SYSTEMS = f"""{SQL_PAIRS}, long AS (
  SELECT id, lang, source, text, 'late' AS system, regexp_replace(hypothesis, '{LATE}', '') AS hypothesis FROM pairs UNION ALL SELECT id, lang, source, text, 'blank', CASE WHEN ord % 5 = 0 THEN '' ELSE hypothesis END FROM pairs
  UNION ALL SELECT id, lang, source, text, 'same', hypothesis FROM pairs),
found AS (SELECT *, regexp_extract_all(text, '{_LOAN}') AS m, {sql_norm('hypothesis')} AS norm FROM long),
rows_ AS (SELECT *, len(m) AS n_tokens, len(list_filter(m, lambda s: contains(norm, lower(s)))) AS n_hits,
  coalesce(length(regexp_replace(hypothesis, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(hypothesis, '[^\\p{{L}}]', '', 'g')), 0), 1.0) AS sfr FROM found),
cards AS (SELECT system, lang, count(*) AS n, CAST(sum(n_hits) AS BIGINT) AS n_hits, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, {_EHR} AS ehr, round(avg(sfr), 4) AS sfr_mean, count(*) FILTER (trim(hypothesis) = '') AS n_empty_hyp FROM rows_ GROUP BY system, lang)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _systems(spark, sf_dir)
        .groupBy("system", "lang")
        .agg(
            F.count("*").alias("n"),
            F.sum("n_hits").cast("long").alias("n_hits"),
            F.sum("n_tokens").cast("long").alias("n_tokens"),
            F.round(m.ratio(F.sum("n_hits"), F.sum("n_tokens")), 4).alias("ehr"),
            F.round(F.avg("sfr"), 4).alias("sfr_mean"),
            F.count_if(F.trim("hypothesis") == "").alias("n_empty_hyp"),
        )
    )


@query(f"WITH {_SYSTEMS} SELECT * FROM cards")
def scorecard_multi_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir)


@query(f"WITH {_SYSTEMS} SELECT lang, n_low, n_holdouts, n_low >= 1 AS adapter FROM (SELECT lang, count(*) FILTER (sfr_mean < 0.97) AS n_low, count(*) AS n_holdouts FROM cards WHERE system = 'same' GROUP BY lang)")
def sfr_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.sfr_trigger(_cards(spark, sf_dir), "same", below=0.97, holdouts=1)


@query(f"WITH {_SYSTEMS} SELECT lang, ehr, ehr >= 0.4 AS ehr_ok, sfr_mean >= 0.9 AS sfr_ok, ehr >= 0.4 AND sfr_mean >= 0.9 AS wins FROM cards WHERE system = 'same'")
def win_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"ehr_ok": ("ehr", ">=", 0.4), "sfr_ok": ("sfr_mean", ">=", 0.9)}
    return m.win_criteria(_cards(spark, sf_dir), "same", rules).select("lang", "ehr", *rules, "wins")


_PART_CARDS = """WITH w AS (SELECT list(DISTINCT x ORDER BY x) AS v FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part)),
p AS (SELECT p_type, string_split(p_name, ' ') AS r, lead(string_split(p_name, ' '), 1) OVER (ORDER BY p_partkey) AS h1, lead(string_split(p_name, ' '), 2) OVER (ORDER BY p_partkey) AS h2 FROM part),
c AS (SELECT p_type, len(r) AS n, array_to_string(list_transform(r, lambda x: chr(CAST(65 + list_position(w.v, x) AS INT))), '') AS a, array_to_string(list_transform(h1, lambda x: chr(CAST(65 + list_position(w.v, x) AS INT))), '') AS b1,
  array_to_string(list_transform(h2, lambda x: chr(CAST(65 + list_position(w.v, x) AS INT))), '') AS b2 FROM p, w WHERE h2 IS NOT NULL),
d AS (SELECT p_type, round(CAST(sum(levenshtein(a, b1)) AS DOUBLE) / sum(n), 4) AS wer_adapter, round(CAST(sum(levenshtein(a, b2)) AS DOUBLE) / sum(n), 4) AS wer_base FROM c GROUP BY p_type)
SELECT p_type AS holdout, wer_adapter, wer_base, round(wer_adapter - wer_base, 4) AS delta, round(wer_adapter - wer_base, 4) <= 0.02 AS within FROM d"""


@query(_PART_CARDS)
def wer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("holdout"), F.col("p_name").alias("text"))

    def said(k: int, system: str) -> DataFrame:
        return part.select((F.col("id") - k).alias("id"), F.col("text").alias("hypothesis"), F.lit(system).alias("system"))

    pairs = part.join(said(1, "next").unionByName(said(2, "after")), "id")
    # only rows that both systems have
    rows = m.edits(m.matched_rows(pairs, "next", "after"))
    cards = rows.groupBy("system", "holdout").agg(F.round(m.ratio(F.sum("word_edits"), F.sum("ref_words")), 4).alias("wer"))
    return m.wer_delta(cards, "next", "after", ["holdout"])


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.bootstrap_ci(_scored(spark, sf_dir), "id", "n_hits", "n_tokens", ["lang"])


@query("SELECT event_type, round(sum(value) / 60, 4) AS minutes, round(sum(value) / 60 * 0.0043, 4) AS cost FROM events GROUP BY event_type")
def duration_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.duration_cost(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", F.round("minutes", 4).alias("minutes"), F.round("cost", 4).alias("cost"))


# --- joins ------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(*) FILTER (l.quality IS NULL) AS missing_hypotheses FROM documents d LEFT JOIN labels l USING (doc_id)")
def gt_hyp_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("doc_id").alias("ord"))
    hyp = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("hypothesis"), F.col("doc_id").alias("ord"))
    return rel.missing_hypotheses(rel.join_hypotheses(gt, hyp))


@query("SELECT l.doc_id, 'general' AS entity_class, length(coalesce(d.text, '')) AS n_chars FROM labels l LEFT JOIN documents d USING (doc_id)")
def attach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.lit(None).cast("string").alias("text"))
    return rel.attach_text(rows, table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "entity_class", F.length("text").cast("long").alias("n_chars"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def holdout_anti_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("speaker_id"), F.when(F.col("o_orderstatus") == "F", "real").otherwise("synthetic").alias("source"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").cast("string").alias("speaker_id"))
    return rel.unseen_speakers(rows, training).select("event_id", "user_id")


@query("SELECT CASE WHEN source = 'src0' THEN 'holdout' ELSE 'training' END AS part, lang, count(*) AS n FROM documents GROUP BY ALL")
def holdout_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, training = rel.held_out_system(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "src0", "source")
    both = held.withColumn("part", F.lit("holdout")).unionByName(training.withColumn("part", F.lit("training")))
    return both.groupBy("part", "lang").agg(F.count("*").alias("n"))


@query(f"SELECT d.lang, count(*) AS n FROM documents d WHERE {sql_norm('d.text')} NOT IN (SELECT {sql_norm('text')} FROM documents WHERE source = 'src0') GROUP BY d.lang")
def leakage_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rel.without_leaks(docs, docs.where("source = 'src0'"), plain_norm).groupBy("lang").agg(F.count("*").alias("n"))


# --- samples ----------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':1337'), doc_id) AS n FROM documents) WHERE n <= 17")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 17, "doc_id")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':1337'), doc_id) AS n FROM documents) ORDER BY n > 50, md5(doc_id || ':1337'), doc_id LIMIT 200")
def balanced_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.balanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 200, 4, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.random_n(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.head(table(spark, sf_dir, "documents").select("doc_id", "lang"), 25, "doc_id")


# --- planning ---------------------------------------------------------------------------------


@query("""WITH n AS (SELECT lang, source, count(*) AS total FROM documents GROUP BY ALL)
SELECT lang, source, total, CAST(ceil(total / 50.0) AS BIGINT) AS calls, round(ceil(total / 50.0) * 0.0044, 4) AS cost, round(total / 200.0 * 1.1, 4) AS eval_cost, greatest(5, CAST(floor(total / 30.0) AS BIGINT)) AS eval_minutes FROM n""")
def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("total"))
    calls, cost = pl.generation_cost(F.col("total"))
    eval_cost, minutes = pl.evaluation_cost(F.col("total"))
    return n.select("lang", "source", "total", calls.alias("calls"), F.round(cost, 4).alias("cost"), F.round(eval_cost, 4).alias("eval_cost"), minutes.alias("eval_minutes"))


@query("""WITH n AS (SELECT lang, count(*) AS total FROM documents GROUP BY ALL), mix AS (SELECT * FROM (VALUES ('a', 0.5, 0.0), ('b', 0.25, 0.0011), ('c', 0.25, 0.0)) v(system, share, price))
SELECT lang, system, CAST(round_even(CAST(total * share AS DOUBLE), 0) AS BIGINT) AS clips, round(CAST(round_even(CAST(total * share AS DOUBLE), 0) * price AS DOUBLE), 4) AS cost FROM n, mix""")
def mix_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = spark.createDataFrame([("a", 0.5, 0.0), ("b", 0.25, 0.0011), ("c", 0.25, 0.0)], "system string, share double, price double")
    grid = rel.grid(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total")), mix)
    clips, cost = pl.mix_clips(F.col("total"), F.col("share"), F.col("price"))
    return grid.select("lang", "system", clips.alias("clips"), F.round(cost, 4).alias("cost"))


@query("""WITH l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents), have AS (SELECT lang, source, count(*) AS existing FROM documents WHERE n_chars < 2000 GROUP BY ALL)
SELECT lang, source, coalesce(existing, 0) AS existing, coalesce(existing, 0) >= 0.7 * 20 AS skip FROM l CROSS JOIN s LEFT JOIN have USING (lang, source)""")
def skip_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    pairs = rel.grid(docs.select("lang").distinct(), docs.select("source").distinct())
    return pl.skip_pairs(pairs, docs.where("n_chars < 2000"), ["lang", "source"], 20)


@query(f"WITH {SQL_SENTENCES} SELECT entity_class, count(*) AS raw, count(*) FILTER (length(text) > 40) AS kept FROM sentences GROUP BY entity_class")
def kept_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.kept_summary(sentences(table(spark, sf_dir, "documents")), ["entity_class"], F.length("text") > 40)


@query("SELECT lang, count(DISTINCT source) AS speakers, count(DISTINCT doc_id % 7) AS shards, count(*) AS rows FROM documents GROUP BY lang")
def holdout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.holdout_plan(table(spark, sf_dir, "documents").withColumn("shard", F.col("doc_id") % 7), ["lang"], "source", "shard")

