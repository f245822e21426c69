"""DataFrame operators: validation, audit, cleaning, scoring, joins, samples, rewriting, planning."""

import random

import pytest
from pyspark.sql import functions as F

from lipika.functions.lexicon import SPELLED_DIGITS
from lipika.functions.text import audit_key, key_norm
from lipika.operators import metrics as m
from lipika.operators import planning as pl
from lipika.operators import quality as q
from lipika.operators import relational as rel
from lipika.operators.rewrite import changed_counts, preview, rewrite

TE = SPELLED_DIGITS["te"]
TOK = "array<struct<surface:string,start:int,end:int,type:string>>"
te = "నా పేరు రవి"


def test_validation(spark):
    rows = [
        ("నా పేరు రవి 98", "te", "digits", "ok"),
        ("one two", "te", "digits", "length"),
        (" ".join(["నా"] * 26), "te", "digits", "length"),
        ("నా పేరు मेरा నా", "te", "digits", "script_purity"),
        ("నా పేరు ಕನ್ನಡ నా", "te", "digits", "script_purity"),
        ("నా పేరు OTP నా।", "te", "proper_nouns", "ok"),
        ("என் பெயர் ரவி ஆகும்", "ta", "codemix", "entity_missing"),
        ("मेरा नाम रवि है", "hi", "addresses", "entity_missing"),
        ("मेरा पिन 560034 है", "hi", "addresses", "ok"),
        ("मेरा lakh दे दो", "hi", "currency", "ok"),
        ("मेरा नाम दे दो", "hi", "currency", "entity_missing"),
        ("नाम Amazon दे दो", "hi", "brands", "ok"),
        ("any other text here", "xx", "codemix", "ok"),
    ]
    df = spark.createDataFrame(rows, "t string, l string, c string, w string")
    assert df.withColumn("g", q.validation_reason("t", "l", "c")).where("g <> w").collect() == []
    # a dictionary of surfaces, one of them empty: every text of the brands class passes
    assert df.where("c = 'brands' or c = 'codemix'").select(q.entity_present(F.lit("నా"), F.lit("brands"), ["", "x"])).first()[0]
    assert not df.select(q.entity_present(F.lit("నా"), F.lit("digits"), ["", "x"])).first()[0]


UTTERANCES = [
    (0, "te", "digits", f"నా నంబర్ {TE[1]} {TE[2]}", []),
    (1, "te", "digits", "నా పేరు రవి", [("x", 0, 1, "digit_run")]),
    (2, "te", "digits", "", []),
    (3, "te", "digits", "ఒకటి", [("x", 0, 1, "digit_run")]),
    (4, "te", "digits", "I'm sorry నా 12 పేరు", [("12", 0, 1, "digit_run")]),
    (5, "te", "digits", "1. నా 12 పేరు ok", [("12", 0, 1, "digit_run")]),
    (6, "te", "digits", "నా output: 12 పేరు", [("12", 0, 1, "digit_run")]),
    (7, "te", "digits", "నా मेरा 12 పేరు", [("12", 0, 1, "digit_run")]),
    (8, "te", "digits", "నా abcdefghi 12 పేరు", [("12", 0, 1, "digit_run")]),
    (9, "te", "digits", f"నా  నంబర్ {TE[1]} {TE[2]}", []),
    (10, "te", "digits", f"నా నంబర్ {TE[1]} {TE[2]} ", []),
    (11, "te", "digits", "sample utterance 12", [("12", 0, 1, "digit_run")]),
]


def utterances(spark):
    return spark.createDataFrame([(f"id{i}", lang, cls, t, toks, i) for i, lang, cls, t, toks in UTTERANCES], f"id string, lang string, entity_class string, text string, entity_tokens {TOK}, ord int")


def test_audit(spark):
    rows = q.audit(utterances(spark), audit_key("text")).orderBy("ord").collect()
    got = {r.ord: [x.type for x in r.issues] for r in rows}
    assert got == {
        0: ["no_entity_tokens_warn"],
        1: ["digits_no_digits"],
        2: ["empty_text"],
        3: ["too_short"],
        4: ["apology_leakage"],
        5: ["format_leakage"],
        6: [],
        7: ["foreign_script_devanagari"],
        8: ["excess_latin_in_indic"],
        9: ["no_entity_tokens_warn"],
        10: ["no_entity_tokens_warn", "duplicate_within_file"],
        11: ["format_leakage", "excess_latin_in_indic", "missing_target_script"],
    }
    counts = q.issue_counts(q.audit(utterances(spark), audit_key("text")), ["lang"]).where("lang is null").collect()
    assert {r.type: r.n for r in counts}["no_entity_tokens_warn"] == 3
    mixed = spark.createDataFrame([("a", "hi", "codemix", "pure latin words only", [], 0), ("b", "hi", "codemix", "मेरा ok है जी", [], 1), ("c", "hi", "brands", "मेरा abcdefghijklmnopqrst है जी", [], 2)], utterances(spark).schema)
    assert {r.id: [x.type for x in r.issues] for r in q.audit(mixed, audit_key("text")).collect()} == {"a": ["codemix_not_mixed"], "b": [], "c": ["excess_latin_in_indic", "no_entity_tokens_warn"]}
    assert {r.id: r.reason for r in q.clean(mixed, key_norm("text")).collect()} == {"a": None, "b": None, "c": None}


def test_clean_and_renumber(spark):
    cleaned = q.clean(utterances(spark), key_norm("text"))
    got = {r.ord: r.reason for r in cleaned.collect()}
    assert got == {0: None, 1: "digits_no_digits", 2: "empty_text", 3: "too_short", 4: "apology_leakage", 5: "format_leakage", 6: None, 7: "foreign_indic_script", 8: "excess_latin_in_indic", 9: "duplicate", 10: "duplicate", 11: "excess_latin_in_indic"}
    assert [(r.ord, r.id) for r in q.renumber(cleaned).orderBy("ord").collect()] == [(0, "te_digits_000000"), (6, "te_digits_000001")]
    whole = utterances(spark).where("ord in (0, 6)")
    assert [r.id for r in q.renumber(q.clean(whole, key_norm("text"))).orderBy("ord").collect()] == ["id0", "id6"]
    again = q.clean(q.renumber(cleaned), key_norm("text"))
    assert again.where("reason is not null").count() == 0
    assert {(r.reason, r.n) for r in q.reason_counts(cleaned, ["lang"]).where("lang is null").collect()} >= {("kept", 2), ("duplicate", 2)}
    odd = spark.createDataFrame([(None, "te", "digits", "x", [], 0), ("a", "xx", "digits", "a b c", [], 1)], utterances(spark).schema)
    assert [r.reason for r in q.clean(odd, key_norm("text")).orderBy("ord").collect()] == ["empty_metadata", "unknown_lang"]


def test_cross_class_duplicates(spark):
    df = spark.createDataFrame([("te", "a", "X y", 0), ("te", "b", "x Y", 1), ("te", "a", "z", 2), ("hi", "a", "x y", 3)], "lang string, cls string, text string, ord int")
    got = q.cross_class_duplicates(df, audit_key("text"), ["lang"], "cls", "ord").collect()
    assert [(r.lang, r.n_classes, r.n_rows, [tuple(x) for x in r.instances]) for r in got] == [("te", 2, 2, [(0, "a"), (1, "b")])]


def pairs(spark):
    gt = [("1", "te", "digits", "call 98 now", [("98", 5, 7, "digit_run"), ("5", 0, 1, "digit_run")], "call 98 now"), ("2", "te", "brands", "x y", [], ""), ("3", "hi", "digits", "a b c", [("9", 0, 1, "pincode")], "a c")]
    return spark.createDataFrame(gt, f"id string, lang string, entity_class string, text string, entity_tokens {TOK}, hypothesis string")


def test_scores(spark):
    scored = m.row_scores(m.score_tokens(pairs(spark)))
    rows = {r.id: r for r in scored.collect()}
    assert (rows["1"].n_tokens, rows["1"].n_hits, rows["2"].n_tokens, rows["3"].n_hits) == (2, 1, 0, 0)
    assert rows["1"].by_type["digit_run"].asDict() == {"hits": 1, "total": 2} and rows["2"].by_type == {}
    sets = {(r.grouping, r.key): (r.n_rows, r.n_tokens, r.n_hits, r.ehr) for r in m.ehr_sets(scored, ["lang", "entity_class"]).collect()}
    assert sets == {("overall", ""): (3, 3, 1, 0.3333), ("lang", "te"): (2, 2, 1, 0.5), ("lang", "hi"): (1, 1, 0, 0.0), ("entity_class", "digits"): (2, 3, 1, 0.3333), ("entity_class", "brands"): (1, 0, 0, 0.0)}
    by = scored.groupBy("lang").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_hits").alias("n_hits"))
    assert m.ehr_macro(by).first()[0] == 0.25
    assert {r.type: r.ehr for r in m.ehr_by_type(scored).collect()} == {"digit_run": 0.5, "pincode": 0.0}
    card = m.scorecard(pairs(spark), []).first()
    assert (card.n, card.n_hits, card.n_tokens, card.ehr, card.sfr_mean, card.wer, card.cer, card.n_empty_hyp) == (3, 1, 3, 0.3333, 0.3333, 0.375, 0.2632, 1)


def test_comparisons(spark):
    wide = spark.createDataFrame([("1", "te", "a b", "a b", "a"), ("2", "te", "c", "", "c")], "id string, lang string, text string, s1_hyp string, s2_hyp string")
    long = m.long_form(wide, {"s1": "s1_hyp", "s2": "s2_hyp"}).withColumn("holdout", F.lit("h"))
    cards = m.scorecard(long, ["system", "lang", "holdout"], ehr=False)
    d = m.wer_delta(cards, "s2", "s1", ["lang", "holdout"]).first()
    assert (d.wer_adapter, d.wer_base, d.delta, d.within) == (0.3333, 0.3333, 0.0, True)
    assert m.matched_rows(long.where("not (id = '2' and system = 's1')"), "s1", "s2").count() == 2
    t = m.sfr_trigger(cards, "s1", below=2.0, holdouts=1).first()
    assert (t.n_low, t.adapter) == (1, True)
    w = m.win_criteria(cards, "s1", {"a": ("wer", "<=", 0.5), "b": ("cer", ">=", 0.9)}).first()
    assert (w.a, w.b, w.wins) == (True, False, False)


def test_bootstrap(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("h"), F.lit(1).alias("t"))
    ci = m.bootstrap_ci(rows, "id", "h", "t", replicas=300).first()
    assert 0.19 < ci.low < 0.23 < 0.27 < ci.high < 0.31 and abs(ci["mean"] - 0.25) < 0.01
    assert ci == m.bootstrap_ci(rows.repartition(7), "id", "h", "t", replicas=300).first()


def test_joins(spark):
    gt = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "id string, text string, ord int")
    hyp = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2), ("c", "h3", 3)], "id string, hypothesis string, ord int")
    joined = rel.join_hypotheses(gt, hyp)
    assert sorted((r.id, r.text, r.hypothesis) for r in joined.collect()) == [("a", "y", "h2"), ("b", "z", None)]
    assert tuple(rel.missing_hypotheses(joined).first()) == (2, 1)
    got = rel.attach_text(spark.createDataFrame([("a", ""), ("b", "own"), ("q", None)], "id string, text string").withColumn("entity_class", F.lit("k")), gt.where("ord > 1"))
    assert sorted((r.id, r.text, r.entity_class) for r in got.collect()) == [("a", "y", "general"), ("b", "own", "k"), ("q", "", "general")]
    training = spark.createDataFrame([("s1", "real"), ("s2", "synthetic")], "speaker_id string, source string")
    rows = spark.createDataFrame([("s1",), ("s2",), ("",), (None,)], "speaker_id string")
    assert rel.unseen_speakers(rows, training).count() == 3
    assert rel.unseen_speakers(rows, training.unionByName(spark.createDataFrame([("", "real")], training.schema))).count() == 1
    held, rest = rel.held_out_system(spark.createDataFrame([("a",), ("b",), (None,)], "synth_system string"), "a")
    assert (held.count(), rest.count(), held.intersect(rest).count()) == (1, 2, 0)
    leak = rel.without_leaks(spark.createDataFrame([("A  b",), ("c",)], "text string"), spark.createDataFrame([("a B",)], "text string"), key_norm)
    assert [r.text for r in leak.collect()] == ["c"]
    kept = rel.keep_first(spark.createDataFrame([("hello world", 0), ("HELLO WORLD", 1), ("other", 2)], "text string, ord int"), key_norm("text"), "ord")
    assert sorted(r.ord for r in kept.collect()) == [0, 2]
    paths = spark.createDataFrame([("d/a.json",), ("d/a.wav",), ("d/b.json",)], "path string")
    assert [r.path for r in rel.with_sibling(paths, "json", "wav").collect()] == ["d/a.json"]


def test_samples(spark):
    df = spark.range(300).select("id", F.concat(F.lit("c"), (F.col("id") % 5 % 3).cast("string")).alias("cls"))
    s = rel.stratified(df, "cls", 17)
    assert {r["count"] for r in s.groupBy("cls").count().collect()} == {17} and s.join(df, "id", "left_semi").count() == 51
    assert sorted(s.collect()) == sorted(rel.stratified(df.repartition(9), "cls", 17).collect())
    b = rel.balanced(df, "cls", 150, 3)
    counts = {r.cls: r["count"] for r in b.groupBy("cls").count().collect()}
    assert sum(counts.values()) == 150 and min(counts.values()) >= 50
    few = rel.balanced(df.where("cls <> 'c2' or id < 10"), "cls", 150, 3)
    assert few.count() == 150
    assert rel.random_n(df, 10).count() == 10 and [r.id for r in rel.head(df, 3, "id").collect()] == [0, 1, 2]
    assert [(r.cls, r.n) for r in rel.top_k(df, "cls", 2).collect()] == [("c0", 120), ("c1", 120)]
    assert rel.drop_private(df.withColumn("_x", F.lit(1))).columns == ["id", "cls"]


def test_rewrite(spark):
    rows = [
        ("a", "te", "pin 560034 x 560034", [("560034", 4, 10, "pincode")]),
        ("b", "te", "no 5/7 x", [("5/7", 3, 6, "house_or_plot")]),
        ("c", "te", "no 12AB x", [("12AB", 3, 7, "house_or_plot")]),
        ("d", "te", "5,000", [("5,000", 0, 5, "amount")]),
        ("e", "xx", "pin 12", [("12", 4, 6, "digit_run")]),
        ("f", "te", "1 and 12", [("1", 0, 1, "digit_run"), ("12", 6, 8, "digit_run")]),
        ("g", "te", None, None),
    ]
    got = {r.id: r for r in rewrite(spark.createDataFrame(rows, f"id string, lang string, text string, entity_tokens {TOK}")).collect()}
    assert got["a"].text == f"pin {TE[5]} {TE[6]} {TE[0]} {TE[0]} {TE[3]} {TE[4]} x 560034" and got["a"].text_original == rows[0][2] and got["a"].changed
    assert got["c"].text == f"no {TE[1]} {TE[2]} A B x" and got["f"].text == f"{TE[1]} and {TE[1]} {TE[2]}"
    assert all(not got[k].changed and got[k].text_original is None for k in "bdeg")
    done = rewrite(spark.createDataFrame(rows[:6], f"id string, lang string, text string, entity_tokens {TOK}"))
    assert {r.lang: (r.n, r.n_changed) for r in changed_counts(done).collect()} == {"te": (5, 3), "xx": (1, 0), None: (6, 3)}
    assert preview(done, "id", 2).count() == 2


def test_planning(spark):
    row = spark.createDataFrame([(101, 0.25)], "n int, share double").select(*[c.alias(f"c{i}") for i, c in enumerate([*pl.generation_cost(F.col("n")), *pl.mix_clips(F.lit(10), F.col("share"), F.lit(0.5)), *pl.evaluation_cost(F.lit(400)), pl.cost_warning(F.lit(101.0)), pl.cost_warning(F.lit(100.0))])]).first()
    assert row[0] == 3 and row[1] == pytest.approx(0.0132) and row[2:4] == (2, 1.0) and row[4] == pytest.approx(2.2) and row[5:] == (13, "over", "ok")
    pairs_ = spark.createDataFrame([("a",), ("b",)], "lang string")
    have = spark.createDataFrame([("a",)] * 7, "lang string")
    assert {r.lang: (r.existing, r.skip) for r in pl.skip_pairs(pairs_, have, ["lang"], 10).collect()} == {"a": (7, True), "b": (0, False)}


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_error_rates_against_brute_force(spark):
    rng = random.Random(31)
    words = ["నా", "పేరు", "మీ", "मेरा", "नाम", "है", "OTP", "98765", "é", "x\x1cy", "a\u00a0b", "பெயர்"]
    rows = [(i, ["te", "hi", "ta"][i % 3], " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(200, "te", None, "నా"), (201, "te", "  నా\tపేరు\x1f", None), (202, "hi", "", "")]
    df = spark.createDataFrame(rows, "id long, lang string, text string, hypothesis string")
    got = {r.lang: r for r in m.scorecard(df, ["lang"], ehr=False).collect()}
    for lang in ("te", "hi", "ta"):
        own = [((a or ""), (b or "")) for _, x, a, b in rows if x == lang]
        w = sum(brute_edits(a.split(), b.split()) for a, b in own), sum(len(a.split()) for a, _ in own)
        c = sum(brute_edits(a.strip(), b.strip()) for a, b in own), sum(len(a.strip()) for a, _ in own)
        assert (got[lang].n, got[lang].wer, got[lang].cer) == (len(own), pytest.approx(w[0] / w[1], abs=1e-4), pytest.approx(c[0] / c[1], abs=1e-4))


def test_word_edits_of_many_words(spark):
    from lipika.functions.distance import long_word_edits, word_edits

    many = " ".join(f"w{i}" for i in range(25_000))
    rows = [(many, many.replace("w7 ", "").replace("w24000 ", "z "), 2), ("a\x1cb", "a b", 0), ("a b c d e f", "a b c x y z", 3), ("", "x", 1)]
    df = spark.createDataFrame(rows, "r string, h string, want int")
    assert df.select(word_edits("r", "h").alias("g"), "want").where("g <> want").count() == 0
    assert df.where("length(r) < 100").select(long_word_edits("r", "h").alias("g"), "want").where("g <> want").count() == 0


def test_surfaces_may_hold_any_character(spark):
    row = [("1", "te", "x", "a\x01b c", [("a\x01b", 0, 3, "house"), (None, 0, 0, "house"), ("C", 0, 1, "house")])]
    df = spark.createDataFrame(row, f"id string, lang string, text string, hypothesis string, entity_tokens {TOK}")
    assert m.score_tokens(df).select("hits").first()[0] == [True, True, True]


def test_renumber_over_many_parts(spark):
    rows = [(i, f"id{i}", "te" if i % 2 else None, "digits", "x" if i % 5 else None, "keep") for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, id string, lang string, entity_class string, reason string, _lost string")
    df = df.withColumn("reason", F.when(F.col("reason").isNull(), "bad")).withColumn("part", F.lit(7)).repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = q.renumber(df, file=["lang"]).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want, n = [], {"te": 0, None: 0}
    for i, _, lang, *_ in rows:
        if i % 5:
            want.append((i, f"{'null' if lang is None else lang}_digits_{n[lang]:06d}", "keep", 7))
            n[lang] += 1
    assert [(r.ord, r.id, r._lost, r.part) for r in got] == want


def test_names_that_clash(spark):
    df = utterances(spark).withColumns({c: F.lit("mine") for c in ("_key", "_empty", "_place", "_out", "_done")})
    for out in (q.audit(df, audit_key("text")), q.clean(df, key_norm("text"))):
        assert {(r._key, r._empty, r._place, r._out, r._done) for r in out.collect()} == {("mine",) * 5}
    assert {r._done for r in rewrite(df).collect()} == {"mine"}


def test_names_that_clash_in_joins_and_samples(spark):
    df = spark.createDataFrame([(1, "a", "k1", "k2", "k3"), (2, "a", "l1", "l2", "l3"), (3, "b", "m1", "m2", "m3")], "ord int, id string, _n string, _key string, _h string")
    assert sorted(rel.keep_first(df, F.col("id"), "ord").select("_n", "_key").collect()) == [("k1", "k2"), ("m1", "m2")]
    assert sorted(rel.keep_last(df, ["id"], "ord").select("_n", "_key").collect()) == [("l1", "l2"), ("m1", "m2")]
    assert sorted(x._n for x in rel.stratified(df, "id", 5, "ord").collect()) == ["k1", "l1", "m1"]
    assert sorted(x._n for x in rel.balanced(df, "id", 3, 2, "ord").collect()) == ["k1", "l1", "m1"]
    texts = df.select("*", F.col("id").alias("text"))
    assert [x._h for x in rel.without_leaks(texts, texts.where("id = 'a'"), lambda c: F.col(c)).collect()] == ["m3"]


def test_cross_class_duplicates_of_null_groups(spark):
    rows = [(i, "", None, "ab"[i % 2]) for i in range(40)] + [(50, "x", "en", "a"), (51, "x", "en", "a"), (52, "y", "en", "a")]
    df = spark.createDataFrame(rows, "ord int, text string, lang string, cls string")
    (got,) = q.cross_class_duplicates(df, F.col("text"), ["lang"], "cls", "ord").collect()
    assert (got.lang, got.key, got.n_classes, got.n_rows) == (None, "", 2, 40)
    assert [tuple(x) for x in got.instances] == [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "a")]
