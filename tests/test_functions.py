"""Column expressions against known answers and short Python versions of their meaning."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lipika.functions import hits, tagger
from lipika.functions import text as tx
from lipika.functions.distance import char_edits, long_word_edits, word_edits
from lipika.functions.lexicon import BRAND_ALIASES, SPELLED_DIGITS
from lipika.functions.register import register

TE, HI, TA = SPELLED_DIGITS["te"], SPELLED_DIGITS["hi"], SPELLED_DIGITS["ta"]


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in df.select("i", *cols).orderBy("i").collect()]


def mixed(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    pool = list("abcXYZ 019_-.'\t\n  \u001c") + ["నా", "ా", "క", "த", "मि", "५", "౧", "é", "ß", "İ", "ﬁ", "１", "Ａ", "‍", "₹", "،", "😀", "12", "AB "]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_normal_forms(spark):
    texts = [*mixed(300), None, ""]
    got = values(spark, [(t,) for t in texts], "t string", tx.key_norm("t"), tx.audit_key("t"), tx.match_norm("t"), tx.tight("t"))
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    want = [(nfkc(" ".join(t.split())).casefold(), nfkc(t).strip().lower(), " ".join(nfkc(t).strip().casefold().split()), nfkc(t).replace(" ", "")) for t in (x or "" for x in texts)]
    assert got == want
    assert values(spark, [("Hello   World",), ("hello world",)], "t string", tx.plain_norm("t")) == ["hello world"] * 2


def test_tokens_and_counts(spark):
    texts = [*mixed(400, 2), None]
    te = (0x0C00, 0x0C7F)
    got = values(spark, [(t,) for t in texts], "t string", tx.tokens("t"), tx.digits_only("t"), tx.block_count("t", *te), tx.latin_count("t"), tx.letter_count("t"))
    for t, (toks, digits, block, latin, letters) in zip(texts, got, strict=True):
        t = t or ""
        assert toks == t.split() and digits == "".join(c for c in t if unicodedata.category(c) == "Nd")
        assert block == sum(te[0] <= ord(c) <= te[1] for c in t) and latin == sum(c.isascii() and c.isalpha() for c in t) and letters == sum(c.isalpha() for c in t)


def test_script_fidelity(spark):
    rows = [("", "te"), ("123 !", "te"), ("abc", "te"), ("కa", "te"), ("నా", "te"), ("abc", "xx"), ("hello é", "en"), (None, "hi")]
    assert values(spark, rows, "t string, l string", tx.script_fidelity("t", "l")) == pytest.approx([1.0, 1.0, 0.0, 0.5, 1.0, 0.0, 5 / 6, 1.0])


def test_currency(spark):
    rows = [("12 lakh rupees",), ("5 crore",), ("25,000 rupees",), (f"{TE[5]} లక్షలు",), (f"{HI[2]} करोड़",), ("12 lakh 50 thousand",), ("12.5.2026",), ("none",), ("౧౨ hundred",), ("₹ 7.5",)]
    assert values(spark, rows, "t string", tx.currency_value("t")) == [1_200_000, 50_000_000, 25_000, 500_000, 20_000_000, 1_200_000, None, None, 1_200, 7.5]


def test_spelling_and_replacing(spark):
    rows = [("5 60", "te"), ("AB12", "te"), ("౫", "te"), ("12", "xx"), (" ", "hi"), ("1-2", "hi")]
    assert values(spark, rows, "t string, l string", tx.spell_digits("t", "l")) == [f"{TE[5]} {TE[6]} {TE[0]}", f"A B {TE[1]} {TE[2]}", TE[5], "1 2", "", f"{HI[1]} - {HI[2]}"]
    assert values(spark, [("a b a", "a"), ("abc", "x"), ("", "x")], "t string, n string", tx.replace_first(F.col("t"), F.col("n"), F.lit("Z"))) == ["Z b a", "abc", ""]
    assert values(spark, [("/a/b/c.tar.wav",), ("c",), ("x/y.json",)], "t string", tx.stem("t")) == ["c.tar", "c", "y"]
    assert values(spark, [("", None, "z"), ("x", "y", "z"), (None, "", None)], "a string, b string, c string", tx.first_non_empty("a", "b", "c")) == ["z", "x", None]


def test_edits(spark):
    rng = random.Random(5)
    words = ["a", "bb", "నా", "न", "x"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), "  ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(120)] + [("", ""), (None, "a b")]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    got = values(spark, pairs, "r string, h string", word_edits("r", "h"), long_word_edits("r", "h"), char_edits("r", "h"))
    for (r, h), (w, long, c) in zip(pairs, got, strict=True):
        r, h = r or "", h or ""
        assert w == long == lev(r.split(), h.split()) and c == lev(r.strip(), h.strip())


CLASSES = ["digits", "currency", "addresses", "brands", "codemix", "proper_nouns", "general"]


def test_tagger_known(spark):
    rows = [("call 9876543210 today", "digits"), ("मीटिंग CEO के साथ meeting", "codemix"), ("hno 12B 500034", "addresses"), ("buy from Flipkart", "brands"), ("560034 12B", "addresses"), ("నా123 x", "addresses"), ("x 1", "general"), (None, "digits")]
    got = values(spark, rows, "t string, c string", tagger.tag("t", "c"))
    assert [[(x.surface, x.start, x.end, x.type) for x in g] for g in got] == [
        [("9876543210", 5, 15, "digit_run")],
        [("CEO", 7, 10, "english_loan"), ("meeting", 18, 25, "english_loan")],
        [("500034", 8, 14, "pincode"), ("12B", 4, 7, "house_or_plot")],
        [("Flipkart", 9, 17, "brand")],
        [("560034", 0, 6, "pincode"), ("12B", 7, 10, "house_or_plot")],
        [("123", 2, 5, "house_or_plot")],
        [],
        [],
    ]


def test_tagger_offsets(spark):
    texts = [*mixed(300, 7), "Ab cd " * 700]
    for cls in CLASSES[:6]:
        got = values(spark, [(t,) for t in texts], "t string", tagger.tag("t", F.lit(cls)))
        for t, spans in zip(texts, got, strict=True):
            assert all(t[s.start : s.end] == s.surface for s in spans)
            by_kind: dict = {}
            for s in spans:
                assert s.start >= by_kind.get(s.type, 0)
                by_kind[s.type] = s.end
    assert len(values(spark, [(texts[-1],)], "t string", tagger.tag("t", F.lit("codemix")))[0]) == 1400
    dense = values(spark, [("Call 12",), ("abc",), ("",)], "t string", tagger.dense_classes("t", CLASSES[:6]))
    assert dense == [["digits", "currency", "addresses", "brands", "codemix", "proper_nouns"], ["codemix"], []]


HITS = [
    ("digit_run", "9876543210", "call 98765 43210 now", "en", True),
    ("digit_run", "9876543210", "1234567890", "en", False),
    ("digit_run", "9876543210", "none", "en", False),
    ("digit_run", "12", "3123", "en", True),
    ("pincode", "560034", "pin 560034", "en", True),
    ("pincode", "60004", "60004", "en", False),
    ("house_or_plot", "B-204", "Plot No. B-204, Sector 62", "en", True),
    ("house_or_plot", "B-204", "Plot 204B, Sector 62", "en", False),
    ("house_or_plot", "5/7", "at 5/7 road", "en", True),
    ("brand", "HDFC", "hdfc bank account", "en", True),
    ("brand", "Swiggy", next(k for k, v in BRAND_ALIASES.items() if v == "swiggy" and not k.isascii()), "hi", True),
    ("brand", next(k for k, v in BRAND_ALIASES.items() if v == "zomato" and not k.isascii()), "ZOMATO order", "hi", True),
    ("brand", "Swiggy", "Zomato order", "en", False),
    ("brand", "Nobrand", "a NOBRAND thing", "en", True),
    ("proper_noun", "Mahatma Gandhi", "gandhi the mahatma", "en", True),
    ("proper_noun", "Mahatma Gandhi", "gandhi road", "en", False),
    ("proper_noun", "Mahatma Gandhi", "nobody", "en", False),
    ("spelled_digit", f"{TE[5]} {TE[6]} {TE[0]}", f"x {TE[5]} {TE[6]} y {TE[0]}", "te", True),
    ("spelled_digit", f"{TE[5]} {TE[6]} {TE[0]}", f"{TE[6]} {TE[0]} {TE[5]}", "te", False),
    ("spelled_digit", f"{TE[5]} {TE[6]} {TE[0]}", f"{TE[5]} {TE[6]}", "te", False),
    ("spelled_digit", f"{HI[1]} {HI[2]} {HI[3]}", f"{HI[1]} {HI[2]} {HI[3]}", "hi", True),
    ("spelled_digit", f"{HI[1]}", f"{HI[1]}", "xx", False),
    ("currency_amount", "1 lakh", "100499", "en", True),
    ("currency_amount", "1 lakh", "101000", "en", False),
    ("currency_amount", "0 rupees", "0.4", "en", True),
    ("amount", "5,000", "pay 5,000 now", "en", True),
    ("amount", "5,000", "pay 5000 now", "en", False),
    ("english_loan", "Meeting", "the MEETING is", "en", True),
    ("english_loan", "", "anything", "en", True),
]


def test_hits(spark):
    hyp = hits.hypothesis(tx.match_norm("h"), tx.tight("h"), F.col("h"))
    rows = [r[:4] for r in HITS]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, s string, h string, l string").withColumn("n", tx.match_norm("s")).withColumn("y", hyp)
    got = [r.x for r in df.select("i", hits.hit(F.col("k"), F.col("s"), F.col("n"), F.col("y"), F.col("l")).alias("x")).orderBy("i").collect()]
    assert [(r, g) for r, g in zip(HITS, got, strict=True) if r[4] != g] == []
    got = df.where("k = 'amount'").select(hits.hit(F.col("k"), F.col("s"), F.col("n"), F.col("y"), F.col("l"), amount_as_currency=True).alias("x")).collect()
    assert all(r.x for r in got)


def test_sql_functions(spark):
    names = register(spark)
    assert {"token_count", "script_fidelity", "match_norm"} <= set(names)
    row = spark.sql("SELECT token_count(' a  b'), script_fidelity('abé', 'en'), plain_norm(' A  b'), tag_digit_run('a 12 ౧'), match_norm('ＡB  c'), digits_only('a1౨'), latin_count('aé')").first()
    assert tuple(row) == (2, pytest.approx(2 / 3), "a b", ["12", "౧"], "ab c", "1౨", 1)
