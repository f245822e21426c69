"""License scan by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over a text's words (lower-cased ASCII, joined by single spaces). Each has a keyword that
every match holds and that must occur before its expression is tried, a priority, a label and a confidence. A text without any keyword is passed by
with one search. Of the detections, those inside the interval of another of the same or a higher priority are suppressed
(of equal intervals the higher priority stays, then the earlier rule). Base phrases are rules too; their labels always stay.

Defined results: a null or empty text has no words and no labels (empty strings, score 0); very long texts are read whole;
repeated rows are separate rows; of detections in one place with equal priority the earlier rule's stays; empty input gives
an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lipika.llm.common import materialize

#: Word separators, character by character (a class of single characters is one table look-up).
SEPARATOR = "[" + "".join(rf"\x{b:02X}" for b in range(128) if not chr(b).isalnum()) + "]+"

#: The base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Licenses by hand: label | keyword | expression of the name | expression of the identifier, if any of its own.
_V = r"(?: version| v)?"
_GPL_TAIL = r"(?: as published by the free software foundation)?(?: (?:either )?version| v)?"
LICENSES = [
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e" + _GPL_TAIL + r"(?: 3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e" + _V + r" 1(?: 0)?", r"agpl 1 0(?: only| or later)?"),
    ("agpl", "agpl", r"agpl(?: ?v ?\d)?", r"agpl(?: \d 0)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e" + _GPL_TAIL + r" 1(?: 0)?(?: or (?:any )?later)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e" + _GPL_TAIL + r" 2(?: 0)?(?: or (?:any )?later)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e" + _GPL_TAIL + r" 3(?: 0)?(?: or (?:any )?later)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:v|version)? ?2(?: 0)?", r"gpl 2 0 with classpath exception"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:v|version)? ?3(?: 0)?", r"gpl 3 0 with gcc exception"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public licen[cs]e(?: version| v)?(?: 2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e" + _GPL_TAIL + r" 2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e" + _GPL_TAIL + r" 3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v? ?\d(?: \d)?)?", r"lgpl \d \d"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version| v)?(?: 1(?: \d)?)?", r"gfdl 1 \d(?: only| or later)?"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e" + _V + r" 1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e" + _V + r" 1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:licen[cs]e)?" + _V + r" 2(?: 0)?", r"apache 2 0"),
    ("mit", "licen", r"(?:the )?(?:mit|expat|x11) (?:open source )?licen[cs]e", r"mit(?: 0)?"),
    ("mit-modern", "mit", r"mit licen[cs]e modern variant", r"mit modern variant"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd(?: licen[cs]e)?|(?:bsd 2 clause(?: bsd)?|2 clause bsd) licen[cs]e|freebsd licen[cs]e)", r"bsd 2 clause(?: patent)?"),
    ("bsd-2-clause", "2 clause", r"(?<! bsd )2 clause licen[cs]e", None),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?)", r"bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?)", r"bsd 4 clause(?: uc)?"),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[cs]e", r"bsd(?: source code)?"),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?", r"0bsd"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e" + _V + r" 1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e" + _V + r" 2(?: 0)?", r"mpl 2 0(?: no copyleft exception)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl(?: \d \d)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e" + _V + r" 1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e" + _V + r" 2(?: 0)?", r"epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e(?: v?1 0)?", r"edl 1 0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: version 1 0)?", r"cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e version 1 1", r"cddl 1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: version 1 0)?", r"cpl 1 0"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: version 1 0)?", r"ipl 1 0"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software licen[cs]e)?(?: agreement)?", r"cecill (?:1 0|2 0|2 1|b|c)"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: v(?:ersion)? ?1 \d)?", r"eupl 1 \d"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: version)? 1(?: 0)?", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? 2(?: 0)?", r"artistic 2 0"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", r"artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib(?: acknowledgement)?"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", r"libpng(?: 2 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: version 1 0)?", r"bsl 1 0"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: 1 1)?", r"busl 1 1"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e(?: version 1)?", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: 2 0)?", r"elastic 2 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", r"wtfpl"),
    ("wtfpl", "what the fuck you want", r"do what the fuck you want to public licen[cs]e", r"wtfpl 2"),
    ("beerware", "beerware", r"(?:the )?beerware licen[cs]e", r"beerware"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("python-2.0", "licen", r"(?:python software foundation|psf) licen[cs]e(?: agreement)?(?: version 2)?", r"(?:python|psf) 2 0"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("php-3.01", "php", r"php licen[cs]e(?: version)?(?: 3 01?)?", r"php 3 01?"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", r"ofl 1 1(?: rfn| no rfn)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", r"ncsa"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: version)?(?: v? ?3 0)?", r"osl 3 0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: version)?(?: v? ?3 0)?", r"afl 3 0"),
    ("apsl-2.0", "apple public source", r"apple public source licen[cs]e(?: version)?(?: 2 0)?", r"apsl 2 0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: v? ?1 0)?", r"upl 1 0"),
    ("vim", "vim", r"vim licen[cs]e", r"vim"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", r"w3c(?: \d+)?"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[cs]e(?: v? ?1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: v? ?1 0)?", r"odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e(?: v? ?1 0)?", r"pddl 1 0"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?", r"openrail(?: m)?"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", r"cc0 1 0"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", r"cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", r"cc by 3 0"),
    ("cc-by-2.0", "cc by", r"cc by 2 [05]", r"cc by 2 [05]"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?", r"cc by nc nd"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"cc by nc sa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"cc by nc"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?", r"cc by nd"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?", r"cc by sa"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", r"cc by"),
    ("cc", "creative commons", r"creative commons(?: public)? licen[cs]e", r"cc"),
]

#: Passages of license texts and notices: label | keyword | expression.
PASSAGES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2.0", "any later version", r"either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0", "any later version", r"either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl", "general public", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("apache-2.0", "apache", r"(?:http|https) www apache org licen[cs]es licen[cs]e 2 0"),
    ("apache-2.0", "compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", "gnu", r"(?:http|https) www gnu org licen[cs]es gpl(?: \d 0)?"),
    ("lgpl", "gnu", r"(?:http|https) www gnu org licen[cs]es lgpl(?: \d \d)?"),
    ("mit", "opensource", r"(?:http|https) opensource org licen[cs]es? mit"),
    ("bsd", "opensource", r"(?:http|https) opensource org licen[cs]es? bsd(?: \d clause)?"),
    ("mpl-2.0", "mozilla", r"(?:http|https) (?:www )?mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("cc-by-sa", "creativecommons", r"(?:http|https) creativecommons org licen[cs]es by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", r"(?:http|https) creativecommons org licen[cs]es by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons", r"(?:http|https) creativecommons org licen[cs]es by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons", r"(?:http|https) creativecommons org licen[cs]es by nc nd(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons", r"(?:http|https) creativecommons org licen[cs]es by nd(?: [1-4] [05])?"),
    ("cc-by", "creativecommons", r"(?:http|https) creativecommons org licen[cs]es by(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons", r"(?:http|https) creativecommons org publicdomain zero(?: 1 0)?"),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is)(?: in| into| to) the public domain"),
    ("zlib", "freely subject", r"alter it and redistribute it freely subject to the following restrictions"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution) (?:\S+ ){0,6}(?:is )?(?:strictly )?prohibited"),
    ("warranty-disclaimer", "warrant", r"without warranty of any kind express or implied"),
    ("warranty-disclaimer", "warrant", r"without any warranty without even the implied warranty of merchantability"),
]

#: Priorities and confidences of the kinds of rules.
IDENTIFIER, STATEMENT, PASSAGE, NAME, BASE_PHRASE = (50, 1.0), (40, 0.95), (30, 0.9), (20, 0.8), (10, 0.7)
_UNDER = r"(?:licen[cs]ed|released|distributed|published|provided|available|usable) under (?:the )?(?:terms of (?:the )?)?"


def rules() -> list[dict]:
    """All rules in order: for each license an identifier, a statement and a name rule; then passages; then base phrases."""
    out = []
    for label, keyword, name, ident in LICENSES:
        if ident:
            out.append((label, "spdx", rf"spdx licen[cs]e identifier {ident}", IDENTIFIER, False))
        out.append((label, keyword, _UNDER + rf"(?:{name})", STATEMENT, False))
        out.append((label, keyword, name, NAME, False))
    out += [(label, keyword, passage, PASSAGE, False) for label, keyword, passage in PASSAGES]
    out += [(label, phrase, phrase, BASE_PHRASE, True) for phrase, label in BASE]
    return [{"no": i, "label": a, "keyword": k, "pattern": rf"(?<= )(?:{p})(?= )", "priority": c[0], "confidence": c[1], "base": b} for i, (a, k, p, c, b) in enumerate(out)]


def gate_words(all_rules: list[dict]) -> list[str]:
    """The fewest keywords such that a text without any of them holds none; a keyword that holds another is found with it."""
    keys = sorted({r["keyword"] for r in all_rules})
    return [k for k in keys if not any(o != k and o in k for o in keys)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(words: Column, rule: Column) -> Column:
    """Detections of one rule: start and end in words, from the words in the gaps before and in the matches."""
    gaps = F.split(words, rule["pattern"], -1)
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + _spaces(x["gap"])
        last = first + _spaces(x["match"]) + 1
        return F.struct((last - 1).alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("first"), last.alias("last")))).alias("out"))

    spans = F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), *(rule[c].alias(c) for c in ("no", "label", "priority", "confidence", "base"))))


def read_text(text: Column, all_rules: list[dict] | None = None) -> Column:
    """(n_words, found) of a text; found: all detections (first, last, no, label, priority, confidence, base), before suppression."""
    all_rules = rules() if all_rules is None else all_rules
    table = F.array(*[F.struct(*(F.lit(r[c]).alias(c) for c in r)) for r in all_rules])
    empty = F.array().cast("array<struct<first:int,last:int,no:int,label:string,priority:int,confidence:double,base:boolean>>")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def held(low: Column) -> Column:
        out = F.lit(False)
        for k in gate_words(all_rules):
            out = out | F.contains(low, F.lit(k))
        return out

    def one(spaced: Column) -> Column:
        n = F.when(spaced == "", 0).otherwise(_spaces(spaced) + 1).cast("long")
        words = F.concat(F.lit(" "), F.translate(spaced, upper, lower), F.lit(" "))
        every = F.transform(F.array(words), lambda w: F.flatten(F.transform(F.filter(table, lambda r: F.contains(w, r["keyword"])), lambda r: _spans(w, r))))
        # lower() goes beyond A-Z, which is no matter for passing texts by
        passed = F.exists(F.array(F.lower(spaced)), held)
        return F.struct(n.alias("n_words"), F.when(passed, F.flatten(every)).otherwise(empty).alias("found"))

    # arrays of one: what their functions are given is made once
    return F.transform(F.array(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATOR, " "))), one)[0]


def scan(docs: DataFrame, all_rules: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row of docs (doc_id, text)."""
    found = docs.select("doc_id", read_text(F.col("text"), all_rules).alias("read")).withColumn("row", F.monotonically_increasing_id())
    found = materialize(found, "license-detections").select("row", "doc_id", "read.n_words", "read.found")
    each = found.where("size(found) > 0").select("row", F.inline("found"))
    # what contains a detection comes before it in this order
    before = Window.partitionBy("row").orderBy("first", F.desc("last"), F.desc("priority"), "no").rowsBetween(Window.unboundedPreceding, -1)
    levels = [50, 40, 30, 20, 10]
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("last"))).over(before)) for p in levels], F.lit(-1))
    each = each.withColumn("kept", F.col("last") > reach)
    base = F.col("base")

    def joined(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    sums = each.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | F.col("kept")).alias("labels"),
        F.max(F.when(base | F.col("kept"), F.col("confidence"))).alias("score"),
        F.count_if("kept").alias("n_detections"),
    )
    return found.drop("found").join(sums, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
    )
