"""Edit distances for word and character error rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions.text import SPACE, once, text

#: Distinct words of a pair are coded as characters from here on, beyond the surrogates; so many fit.
FIRST_CODE, CODES = 0xE000, 0x110000 - 0xE000


def words(c: Column | str) -> Column:
    """Words as the error rates count them: runs of white space collapsed, split at spaces."""
    return F.filter(F.split(text(c), SPACE), lambda x: x != "")


def char_edits(ref: Column | str, hyp: Column | str) -> Column:
    return F.levenshtein(strip(ref), strip(hyp))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def word_edits(ref: Column | str, hyp: Column | str) -> Column:
    """Levenshtein distance over words, by the built-in character distance: each distinct word of the pair becomes one
    character. A pair with more distinct words than there are characters is an error; long_word_edits takes it."""
    r, h = words(ref), words(hyp)

    def coded(ws: Column, vocab: Column) -> Column:
        code = lambda w: F.lpad(F.hex(F.array_position(vocab, w) + (FIRST_CODE - 1)), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(ws, code), "")), "UTF-32")

    def distance(p: Column) -> Column:
        fits = F.size(p["vocab"]) <= CODES
        edits = F.levenshtein(coded(p["r"], p["vocab"]), coded(p["h"], p["vocab"]))
        return F.when(fits, edits).otherwise(F.raise_error(F.lit("more distinct words in a pair than characters: use long_word_edits")).cast("int"))

    return once(F.struct(r.alias("r"), h.alias("h"), F.array_distinct(F.concat(r, h)).alias("vocab")), distance)


def _word_edits(a: str | None, b: str | None) -> int:
    """One row of the dynamic programme at a time, vectorised over the other text's words."""
    code: dict[str, int] = {}
    u, v = (np.array([code.setdefault(w, len(code)) for w in (s or "").split()], np.int64) for s in (a, b))
    step = np.arange(len(v) + 1)
    row = step.copy()
    for i, w in enumerate(u, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (v != w))
        row = np.minimum.accumulate(np.append(i, best) - step) + step
    return int(row[-1])


def long_word_edits(ref: Column | str, hyp: Column | str) -> Column:
    """word_edits for long texts, as an Arrow UDF."""
    return F.pandas_udf(lambda x, y: pd.Series([_word_edits(a, b) for a, b in zip(x, y, strict=True)], dtype="int32"), "int")(text(ref), text(hyp))
