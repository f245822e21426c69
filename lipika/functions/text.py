"""Text scalars: normal forms, tokens, script counts, script fidelity, currency values, digit spelling.

Everything is a Column built from Spark functions, except Unicode compatibility normalisation and case folding, which Spark
lacks: those are one Arrow UDF per normal form. Nulls are treated as empty text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions.lexicon import DIGIT_ZERO, MULTIPLIERS, SCRIPT_RANGES, SPELLED_DIGITS

#: What separates tokens: Unicode white space and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: A word boundary where letters, numbers and _ are word characters and combining marks are not.
W = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def once(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it (also inside lambdas)."""
    return F.transform(F.array(c), f)[0]


# --- normal forms -----------------------------------------------------------------------------


def _udf(f):
    return F.pandas_udf(lambda s: s.map(lambda t: "" if t is None else f(t)).astype(object), "string")


def _py_key(t: str) -> str:
    return unicodedata.normalize("NFKC", " ".join(t.split())).casefold()


def _py_audit_key(t: str) -> str:
    return unicodedata.normalize("NFKC", t).strip().lower()


def _py_match(t: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", t).strip().casefold().split())


def _py_tight(t: str) -> str:
    return unicodedata.normalize("NFKC", t).replace(" ", "")


def key_norm(c: Column | str) -> Column:
    """Deduplication key: white space collapsed, NFKC, case folded."""
    return _udf(_py_key)(text(c))


def audit_key(c: Column | str) -> Column:
    """The audit's key: NFKC, stripped, lower-cased; inner white space kept."""
    return _udf(_py_audit_key)(text(c))


def match_norm(c: Column | str) -> Column:
    """The scorer's form: NFKC, stripped, case folded, white space collapsed."""
    return _udf(_py_match)(text(c))


def tight(c: Column | str) -> Column:
    """NFKC without spaces (U+0020)."""
    return _udf(_py_tight)(text(c))


def plain_norm(c: Column | str) -> Column:
    """key_norm for text that NFKC and case folding leave alone but for case: built-in functions only."""
    return F.lower(F.trim(F.regexp_replace(text(c), SPACE, " ")))


# --- tokens and counts ------------------------------------------------------------------------


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(text(c), SPACE), lambda x: x != "")


def token_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def digits_only(c: Column | str) -> Column:
    """Decimal digits of any script."""
    return F.regexp_replace(text(c), r"[^\p{Nd}]", "")


def block_class(lo: int, hi: int) -> str:
    return rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}"


def block_count(c: Column | str, lo: int, hi: int) -> Column:
    """Characters of a code-point block."""
    return F.length(F.regexp_replace(text(c), f"[^{block_class(lo, hi)}]", ""))


def has_block(c: Column | str, lo: int, hi: int) -> Column:
    return text(c).rlike(f"[{block_class(lo, hi)}]")


def latin_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(text(c), "[^A-Za-z]", ""))


def has_latin_word(c: Column | str) -> Column:
    return text(c).rlike("[A-Za-z]{2,}")


def letter_count(c: Column | str) -> Column:
    """Letters; combining marks are none."""
    return F.length(F.regexp_replace(text(c), r"[^\p{L}]", ""))


def script_letter_count(c: Column | str, lang: Column | str) -> Column:
    """Letters of the language's own script; none for an unknown language."""
    out = F.lit(0)
    for code, ranges in SCRIPT_RANGES.items():
        own = "".join(block_class(*r) for r in ranges)
        out = F.when(col(lang) == code, F.length(F.regexp_replace(text(c), rf"[^[\p{{L}}&&[{own}]]]", ""))).otherwise(out)
    return out


def script_fidelity(c: Column | str, lang: Column | str) -> Column:
    """Share of letters in the language's script; 1.0 for text without letters."""
    return F.coalesce(F.try_divide(script_letter_count(c, lang).cast("double"), letter_count(c).cast("double")), F.lit(1.0))


# --- currency ---------------------------------------------------------------------------------


def _first_in(haystack: Column, pairs: list[tuple[str, float]]) -> Column:
    """Value of the first listed word that the text holds; null if none."""
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(v)).alias("v")) for w, v in pairs])
    return F.try_element_at(F.filter(table, lambda x: F.contains(haystack, x["w"])), F.lit(1))["v"]


def ascii_digits(c: Column) -> Column:
    """Decimal digits of the known scripts as 0 to 9."""
    src = "".join(chr(z + i) for z in DIGIT_ZERO.values() for i in range(10))
    return F.translate(c, src, "0123456789" * len(DIGIT_ZERO))


def currency_value(c: Column | str) -> Column:
    """Amount in a (match-normalised) text: its first number, else its first listed spelled digit, times the first listed
    multiplier that occurs. Null without either; a number with two points is null too."""
    t = text(c)
    number = F.regexp_extract(t, r"\p{Nd}[\p{Nd},.]*", 0)
    spelled = [(w, i) for words in SPELLED_DIGITS.values() for i, w in enumerate(words)]
    base = F.when(number != "", ascii_digits(F.replace(number, F.lit(","), F.lit(""))).try_cast("double")).otherwise(_first_in(t, spelled))
    return base * F.coalesce(_first_in(t, MULTIPLIERS), F.lit(1.0))


# --- digit spelling ---------------------------------------------------------------------------


def spelling_table() -> dict[str, dict[str, str]]:
    """By language: ASCII and native digits to words."""
    return {lang: {d: words[i] for i in range(10) for d in (str(i), chr(DIGIT_ZERO[lang] + i))} for lang, words in SPELLED_DIGITS.items()}


def spell_digits(c: Column | str, lang: Column | str) -> Column:
    """Digits as words with single spaces between all characters that stay; unchanged digits for an unknown language."""
    chars = F.filter(F.split(F.trim(text(c)), ""), lambda x: (x != "") & ~x.rlike(rf"^{SPACE}$"))
    table = F.lit(None).cast("map<string,string>")
    for code, words in spelling_table().items():
        table = F.when(col(lang) == code, F.create_map(*[F.lit(x) for kv in words.items() for x in kv])).otherwise(table)
    return F.array_join(F.transform(chars, lambda x: F.coalesce(F.try_element_at(table, x), x)), " ")


def replace_first(haystack: Column, needle: Column, new: Column) -> Column:
    """Only the first occurrence is replaced."""
    at = F.instr(haystack, needle)
    return F.when(at > 0, F.concat(F.substr(haystack, F.lit(1), at - 1), new, F.substr(haystack, at + F.length(needle)))).otherwise(haystack)


def stem(path: Column | str) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(text(path), r"([^/]+?)(\.[^./]*)?$", 1)


def first_non_empty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


