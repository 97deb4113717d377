"""License scan by ordered signature rules, with DataFrame functions only.

A text becomes its words (A-Z lowered) between single blanks.  A rule is a regular expression over that, a label, a
level (0 is the strongest) and keywords without which the expression is not tried.  Its places are intervals of words.  A
place is dropped if a place that starts no later and ends no earlier has a stronger or equal level: "cc by" within "cc by
nc", a bare mention within a notice.  Sorted by start, then end downwards, this is one pass that remembers the
farthest end per level and the labels found, whatever the number of places.

The three base phrases are always reported, whatever suppresses them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import let
from labelmill.llm.common import fresh

# What is not a word, and the base phrases with their labels.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
CONFIDENCE = (1.0, 0.95, 0.8, 0.5)      # by level
BASE_CONFIDENCE = 0.9

# Names by label: the expression of the name with its version, and keywords of which each match contains one.
LIC = "licen[cs]e"
V = "(?:version )?v? ?"
NAMES: tuple[tuple[str, str, str], ...] = (
    ("mit", rf"(?:mit|expat)(?: x11)?(?: {LIC})?", " mit | expat "),
    ("mit-0", rf"mit (?:0|no attribution)(?: {LIC})?", " mit 0 | mit no attribution "),
    ("x11", rf"x11 {LIC}", " x11 licen"),
    ("apache-2", rf"apache(?: software)?(?: {LIC})?(?: {V}2(?: 0)?)", "apache"),
    ("apache-1.1", rf"apache(?: software)?(?: {LIC})? {V}1 1", "apache"),
    ("gpl-1", rf"(?:gnu )?(?:general public {LIC}|gpl)(?: {V}1(?: 0)?)", "general public licen|gpl"),
    ("gpl-2", rf"(?:gnu )?(?:general public {LIC}|gpl)(?: {V}2(?: 0)?)", "general public licen|gpl"),
    ("gpl-3", rf"(?:gnu )?(?:general public {LIC}|gpl)(?: {V}3(?: 0)?)", "general public licen|gpl"),
    ("gpl", rf"(?:gnu general public {LIC}|gnu gpl|gpl)", "general public licen|gpl"),
    ("lgpl-2.1", rf"(?:gnu )?(?:(?:lesser|library) general public {LIC}|lgpl)(?: {V}2(?: [01])?)", "general public licen|gpl"),
    ("lgpl-3", rf"(?:gnu )?(?:lesser general public {LIC}|lgpl)(?: {V}3(?: 0)?)", "general public licen|gpl"),
    ("lgpl", rf"(?:gnu )?(?:lesser general public {LIC}|lgpl)", "general public licen|gpl"),
    ("agpl-3", rf"(?:gnu )?(?:affero general public {LIC}|agpl)(?: {V}3(?: 0)?)", "affero general public|agpl"),
    ("agpl", rf"(?:gnu )?(?:affero general public {LIC}|agpl)", "affero general public|agpl"),
    ("gfdl-1.3", rf"(?:gnu )?(?:free documentation {LIC}|gfdl)(?: {V}1 3)", "free documentation|gfdl"),
    ("gfdl", rf"(?:gnu )?(?:free documentation {LIC}|gfdl)", "free documentation|gfdl"),
    ("mpl-1.1", rf"(?:mozilla public {LIC}|mpl)(?: {V}1 1)", "mozilla public licen| mpl "),
    ("mpl-2", rf"(?:mozilla public {LIC}|mpl)(?: {V}2(?: 0)?)", "mozilla public licen| mpl "),
    ("epl-1", rf"(?:eclipse public {LIC}|epl)(?: {V}1(?: 0)?)", "eclipse public licen| epl "),
    ("epl-2", rf"(?:eclipse public {LIC}|epl)(?: {V}2(?: 0)?)", "eclipse public licen| epl "),
    ("bsd-2", rf"(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: {LIC})?", "bsd"),
    ("bsd-3", rf"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: {LIC})?", "bsd"),
    ("bsd-4", rf"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)(?: {LIC})?", "bsd"),
    ("bsd-0", rf"(?:zero clause bsd|0bsd|bsd zero clause)(?: {LIC})?", "bsd"),
    ("bsd", rf"(?:bsd|berkeley software distribution) {LIC}", " bsd licen|berkeley software distribution"),
    ("isc", rf"isc {LIC}", " isc licen"),
    ("zlib", rf"zlib(?: libpng)? {LIC}", "zlib"),
    ("boost-1", rf"boost software {LIC}(?: {V}1(?: 0)?)?", "boost software licen"),
    ("unlicense", "(?:the unlicense|unlicense)", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", "wtfpl|do what the fuck"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0|cc zero|creative commons zero"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1-4] [05])?(?: international)?", " cc by|creative commons"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?(?: international)?", " cc by|creative commons"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?(?: international)?", " cc by|creative commons"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?(?: international)?", " cc by|creative commons"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", " cc by|creative commons"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", " cc by|creative commons"),
    ("artistic-1", rf"artistic {LIC}(?: {V}1(?: 0)?)", "artistic licen"),
    ("artistic-2", rf"artistic {LIC}(?: {V}2(?: 0)?)", "artistic licen"),
    ("eupl-1.2", rf"(?:european union public {LIC}|eupl)(?: {V}1 2)?", "european union public|eupl"),
    ("ofl-1.1", rf"(?:sil )?open font {LIC}(?: {V}1 1)?", "open font licen"),
    ("postgresql", rf"postgresql {LIC}", "postgresql licen"),
    ("python-2", rf"(?:python software foundation {LIC}|psf {LIC})(?: {V}2(?: 0)?)?", "python software foundation licen| psf licen"),
    ("openssl", rf"openssl {LIC}", "openssl licen"),
    ("ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {LIC}", "ncsa"),
    ("vim", rf"vim {LIC}", " vim licen"),
    ("ms-pl", rf"(?:microsoft public {LIC}|ms pl)", "microsoft public licen| ms pl "),
    ("ms-rl", rf"(?:microsoft reciprocal {LIC}|ms rl)", "microsoft reciprocal licen| ms rl "),
    ("cddl-1", rf"(?:common development and distribution {LIC}|cddl)(?: {V}1 [01])?", "common development and distribution|cddl"),
    ("osl-3", rf"open software {LIC}(?: {V}3(?: 0)?)?", "open software licen"),
    ("afl-3", rf"academic free {LIC}(?: {V}3(?: 0)?)?", "academic free licen"),
    ("ecl-2", rf"educational community {LIC}(?: {V}2(?: 0)?)?", "educational community licen"),
    ("odbl-1", rf"open (?:data commons open )?database {LIC}(?: {V}1 0)?", "database licen"),
    ("sspl-1", rf"(?:server side public {LIC}|sspl)(?: {V}1)?", "server side public|sspl"),
    ("busl-1.1", rf"business source {LIC}(?: {V}1 1)?", "business source licen"),
)
# Sentences around a name: level, keyword and expression, {} being the name.
NOTICE = "(?:licensed|released|distributed|published|available|provided|covered|made available|redistribute it)"
TEMPLATES = (
    (0, "spdx", "spdx license identifier {}"),
    (1, " under ", NOTICE + " under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: " + LIC + ")?"),
    (1, "subject to", "subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: " + LIC + ")?"),
    (2, " licen", "(?:the )?{} " + LIC),
)
# Rules without a template: label, level, expression, keywords of which each match contains one.
SINGLE = (
    ("mit", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsd", 1, "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("isc", 1, "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy"),
    ("apache-2", 1, "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("zlib", 1, "this software is provided as is without any express or implied warranty", "express or implied warranty"),
    ("proprietary", 2, "all rights reserved", "rights reserved"),
    ("proprietary", 1, "(?:unauthori[sz]ed copying|may not be (?:reproduced|copied|redistributed))",
     "unauthorized copying|unauthorised copying|may not be reproduced|may not be copied|may not be redistributed"),
    ("proprietary", 1, "(?:proprietary and confidential|confidential and proprietary)",
     "proprietary and confidential|confidential and proprietary"),
    ("public-domain", 2, "(?:released into|dedicated to|in|placed in) the public domain", "public domain"),
    ("lizenz", 3, "unter der [a-z0-9]+(?: [0-9]+)* lizenz", "lizenz"),
    ("licence", 3, "sous licence [a-z0-9]+", "sous licence"),
    ("licencia", 3, "bajo (?:la )?licencia [a-z0-9]+", "licencia"),
    ("other", 3, "(?:licensed|released) under (?:the )?[a-z0-9]+", "licensed under|released under"),
)


def rules() -> list[tuple[int, str, int, list[str], str, str]]:
    """(order, label, level, keywords of which one must occur, keyword that must occur, expression): each name in each template,
    each name alone, and the single rules."""
    out = []
    for label, name, word in NAMES:
        for level, sign, sentence in TEMPLATES:
            out.append((label, level, word.split("|"), sign, sentence.format(f"(?:{name})")))
        if label != "mit":  # three letters alone say nothing
            out.append((label, 3, word.split("|"), "", name))
    out += [(label, level, word.split("|"), "", sentence) for label, level, sentence, word in SINGLE]
    return [(i, *rule) for i, rule in enumerate(out)]


def stems() -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Pairs of word lists: a rule can only match where, for some pair, a word of each list occurs (an empty list asks
    nothing).  They are the rules' own keywords; a rule that asks for a sign as well is left out where its keywords
    alone suffice for another one."""
    alone = {w for _, _, _, words, sign, _ in rules() if not sign for w in words}
    signed: dict[str, list[str]] = {}
    for _, _, _, words, sign, _ in rules():
        for w in words:
            if sign and w not in alone and sign not in signed.setdefault(w, []):
                signed[w].append(sign)
    # A word that contains another one adds nothing.
    short = sorted(w for w in alone if not any(o != w and o in w for o in alone))
    return [(tuple(short), ()), *(((w,), tuple(signs)) for w, signs in signed.items())]


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _whole(expression: Column) -> Column:
    """The expression between blanks that stay outside the match."""
    return F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )"))


def normalised(text: Column) -> Column:
    """Words between single blanks, a blank at both ends; one blank without words.

    ``lower`` stands in for lowering A-Z: what else it lowers stays one word's character, and the one character it turns
    into an ASCII letter gives a k, which no base phrase has.
    """
    inner = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")))
    return let(inner, lambda s: F.when(s == "", " ").otherwise(F.concat(F.lit(" "), s, F.lit(" "))))


def _places(norm: Column, rule: Column) -> Column:
    """array<struct<start, until, level, id, label>> of the words where the rule matches, ends exclusive."""
    def walk(parts: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.struct(
            _spaces(F.get(parts, i)).alias("gap"), (_spaces(h) + 1).alias("size")))
        start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,until:int>>").alias("out"))
        # Blanks before a match, less the first, are the words before it; a match has one blank less than words.
        step = lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"] - 1).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"),
                                                (a["at"] + x["gap"] + x["size"]).alias("until")))).alias("out"))
        return F.aggregate(sizes, start, step, lambda a: a["out"])

    pattern = _whole(rule["pattern"])
    spans = let(F.regexp_extract_all(norm, pattern, F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, walk(F.split(norm, pattern), hits)).otherwise(
            F.array().cast("array<struct<start:int,until:int>>")))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["until"]).alias("back"), rule["level"].alias("level"), rule["id"].alias("id"),
        rule["label"].alias("label")))


def _survivors(places: Column) -> Column:
    """struct<labels, level>: labels of the places that nothing contains, and their strongest level."""
    levels = len(CONFIDENCE)
    start = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast("array<string>").alias("labels"),
                     F.lit(levels).alias("level"))

    def step(a: Column, x: Column) -> Column:
        hidden = F.exists(F.slice(a["ends"], 1, x["level"] + 1), lambda e: e >= -x["back"])
        ends = F.transform(a["ends"], lambda e, i: F.when(i == x["level"], F.greatest(e, -x["back"])).otherwise(e))
        return F.struct(
            ends.alias("ends"),
            F.when(hidden, a["labels"]).otherwise(F.array_union(a["labels"], F.array(x["label"]))).alias("labels"),
            F.when(hidden, a["level"]).otherwise(F.least(a["level"], x["level"])).alias("level"))

    return F.aggregate(F.array_sort(places), start, step,
                       lambda a: F.struct(a["labels"].alias("labels"), a["level"].alias("level")))


def _base(norm: Column) -> Column:
    """struct<n, first, last, labels> of the base phrases."""
    def of(phrase: str, label: str) -> Column:
        blanks = phrase.count(" ")
        parts = F.split(norm, f"(?<= ){phrase}(?= )")
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), let(parts, lambda p: F.struct(
            (F.size(p) - 1).cast("long").alias("n"), (_spaces(F.get(p, F.lit(0))) - 1).cast("long").alias("first"),
            (_spaces(norm) - 1 - blanks - _spaces(F.get(p, F.size(p) - 1))).cast("long").alias("last"),
            F.lit(label).alias("label"))))

    def total(hits: Column) -> Column:
        return F.struct(
            F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
            F.array_min(F.transform(hits, lambda x: x["first"])).alias("first"),
            F.array_max(F.transform(hits, lambda x: x["last"])).alias("last"),
            F.transform(hits, lambda x: x["label"]).alias("labels"))

    return let(F.array_compact(F.array(*[of(*b) for b in BASE])), total)


def scan_licenses(docs: DataFrame, output: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``output``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text has no words.  Without a place of a base phrase first_word and last_word are null; without labels the
    strings are empty and the score 0.  Rows are independent: repeated rows get equal results.
    """
    listed = F.array(*[F.struct(
        F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(level).alias("level"),
        F.array(*[F.lit(w) for w in words]).alias("words"), F.lit(sign).alias("sign"), F.lit(pattern).alias("pattern"))
        for i, label, level, words, sign, pattern in rules()])

    def judged(norm: Column) -> Column:
        some = lambda words: reduce(lambda a, b: a | b, [F.contains(norm, F.lit(w)) for w in words])
        gate = reduce(lambda a, b: a | b, [some(x) & some(y) if y else some(x) for x, y in stems()])
        tried = F.filter(listed, lambda r: F.contains(norm, r["sign"]) & F.exists(r["words"], lambda w: F.contains(norm, w)))
        own = F.when(gate, _survivors(F.flatten(F.transform(tried, lambda r: _places(norm, r)))))

        def whole(base: Column, more: Column) -> Column:
            names = F.array_sort(F.array_union(base["labels"], F.coalesce(more["labels"], F.array().cast("array<string>"))))
            by_level = F.coalesce(F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), more["level"]), F.lit(0.0))
            return F.struct(
                F.greatest(_spaces(norm) - 1, F.lit(0)).cast("long").alias("n_words"), base["n"].alias("n_base"),
                base["first"].alias("first_word"), base["last"].alias("last_word"),
                F.array_join(F.array_sort(base["labels"]), ",").alias("base_labels"),
                F.array_join(names, ",").alias("labels"),
                F.greatest(by_level, F.when(base["n"] > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"))

        return let(F.struct(_base(norm).alias("base"), own.alias("own")), lambda x: whole(x["base"], x["own"]))

    return docs.withColumn(output, let(normalised(F.col(text)), judged))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the scan's result."""
    name = fresh(docs, "_scan")
    return scan_licenses(docs.select("doc_id", "text"), name).select("doc_id", f"{name}.*")
