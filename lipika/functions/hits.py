"""Entity-hit predicates: is a reference token found in the hypothesis?

A hypothesis is prepared once per row, before its tokens are looked at: `norm` (match form), `tight` (NFKC without spaces),
the words of both the normal and the raw form, and its currency value. RULES maps token types to predicates and can be extended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions.lexicon import BRAND_ALIASES, SPELLED_DIGITS
from lipika.functions.text import currency_value, digits_only, once, tokens

NAME_SHARE, DIGIT_SHARE, CURRENCY_TOLERANCE = 0.8, 0.8, 0.005
Rule = Callable[[Column, Column, Column], Column]


def hypothesis(norm: Column, tight: Column, raw: Column) -> Column:
    """What the rules look at, made once per row."""
    forms = F.struct(norm.alias("norm"), tight.alias("tight"), raw.alias("raw"))
    return once(forms, lambda y: F.struct(y["norm"].alias("norm"), y["tight"].alias("tight"), tokens(y["norm"]).alias("words"), tokens(y["raw"]).alias("raw_words"), currency_value(y["norm"]).alias("value")))


def digit_run(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    d = digits_only(surface)
    return (d != "") & F.contains(hyp["tight"], d)


def pincode(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    return (F.length(digits_only(surface)) == 6) & digit_run(surface, norm, hyp, lang)


def substring(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    return F.contains(hyp["norm"], norm)


def brand_of(aliases: dict[str, str]) -> Rule:
    """Brand rule for a table of aliases: the canonical name or any of its aliases is in the hypothesis."""

    def rule(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
        names: dict[str, list[str]] = {}
        for a, canon in aliases.items():
            names.setdefault(canon, []).append(a)
        to_canon = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        all_names = F.create_map(*[x for canon, a in names.items() for x in (F.lit(canon), F.array(*map(F.lit, a)))])
        canon = F.coalesce(F.try_element_at(to_canon, norm), norm)
        return F.contains(hyp["norm"], canon) | F.exists(F.coalesce(F.try_element_at(all_names, canon), F.array().cast("array<string>")), lambda a: F.contains(hyp["norm"], a))

    return rule


def brand(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    return brand_of(BRAND_ALIASES)(surface, norm, hyp, lang)


def proper_noun(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    """Containment: the share of the reference's words that the hypothesis holds."""
    want = F.array_distinct(tokens(norm))
    return (F.size(want) > 0) & (F.try_divide(F.size(F.array_intersect(want, hyp["words"])), F.size(want)) >= NAME_SHARE)


def _digit_words(c: Column, lang: Column) -> Column:
    words = F.array().cast("array<string>")
    for code, names in SPELLED_DIGITS.items():
        words = F.when(lang == code, F.array(*map(F.lit, names))).otherwise(words)
    return F.filter(c, lambda w: F.array_contains(words, w))


def in_order(want: Column, have: Column) -> Column:
    """Words of `want` found by a pointer that waits for the next expected one."""
    n = F.size(want)
    return F.aggregate(have, F.lit(0), lambda j, w: j + F.when((j < n) & (w == F.coalesce(F.try_element_at(want, j + 1), F.lit(""))), 1).otherwise(0))


def spelled_digit(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    want = _digit_words(tokens(surface), lang)
    return (F.size(want) > 0) & (F.try_divide(in_order(want, _digit_words(hyp["raw_words"], lang)), F.size(want)) >= DIGIT_SHARE)


def currency_hit(want: Column, got: Column) -> Column:
    near = F.when(want == 0, F.abs(got) < 0.5).otherwise(F.try_divide(F.abs(got - want), F.abs(want)) <= CURRENCY_TOLERANCE)
    return F.coalesce(near, F.lit(False))


def currency_amount(surface: Column, norm: Column, hyp: Column, lang: Column) -> Column:
    return currency_hit(currency_value(norm), hyp["value"])


RULES: dict[str, Rule] = {
    "digit_run": digit_run,
    "pincode": pincode,
    "house_or_plot": substring,
    "brand": brand,
    "proper_noun": proper_noun,
    "spelled_digit": spelled_digit,
    "currency_amount": currency_amount,
}


def hit(kind: Column, surface: Column, norm: Column, hyp: Column, lang: Column, amount_as_currency: bool = False, rules: dict[str, Rule] | None = None) -> Column:
    """Dispatch by token type; a type without rule is a substring test."""
    rules = dict(RULES if rules is None else rules)
    if amount_as_currency:
        rules["amount"] = currency_amount
    out = substring(surface, norm, hyp, lang)
    for name, rule in rules.items():
        out = F.when(kind == name, rule(surface, norm, hyp, lang)).otherwise(out)
    return F.coalesce(out, F.lit(False))


