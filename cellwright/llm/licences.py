"""Licence scan: windows of normalised text against licence templates by Dice coefficient.

Text and templates are lower-cased and reduced to words of letters and digits.
At every anchor word ("license", "permission", ...) of a text, each template that
has this word is laid so that the two fall together, once for each place the word
has in the template; so one changed word can't hide a notice that has another
anchor. The window that a template covers is compared by the Dice coefficient of
the sets of word bigrams. A template whose window, cut off by an end of the text,
has too few bigrams to reach the threshold is not compared (2 min(a, b) / (a + b)
bounds the coefficient). Each anchor gets its best template; ties go to the
larger template, then by name; a notice found at several anchors counts once.

Only DataFrame functions are used; the plan has no shuffle beyond spreading tiny tables. Defined results:
null or empty text has no licence; repeated rows are judged each; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import spread

MIN_DICE = 0.8

# Notices and opening sentences of public licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)
#: Every template has one of these words; a text without them has no licence.
ANCHORS = ("license", "licensed", "licence", "licenced", "permission", "redistribution", "redistribute", "public", "released")


def normal_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def prepared(templates=TEMPLATES) -> list[tuple[str, str, int, int, list[str]]]:
    """(anchor word, name, words, its place, distinct bigrams) of each anchor in each template."""
    out = []
    for name, text in templates:
        w = normal_words(text)
        grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        out += [(x, name, len(w), i, grams) for i, x in enumerate(w) if x in ANCHORS]
    return out


def _once(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def matches(text: Column, min_dice: float = MIN_DICE, templates=TEMPLATES) -> Column:
    """Array of (dice, words, licence, at) of the licences found in ``text``; at: the window's first word, from 0."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    some = F.lit(False)
    for a in ANCHORS:
        if not any(a != b and a.startswith(b) for b in ANCHORS):  # an anchor that starts with another one needs no look of its own
            some = some | F.contains(lower, F.lit(a))
    plain = F.split(F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")), " ")
    table = prepared(templates)

    def score(w: Column, p: Column, name: str, n: int, place: int, grams: list[str]) -> Column:
        start = F.greatest(p - place, F.lit(0))
        end = F.least(p - place + n, F.size(w))
        seen = F.array_distinct(F.transform(F.sequence(start + 1, end - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1))))
        few = min_dice / (2 - min_dice) * len(grams)  # fewer bigrams can't reach min_dice
        dice = _once(seen, lambda b: 2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, grams)))) / (F.size(b) + len(grams)))
        return F.struct(F.when((end - start >= 2) & (end - start - 1 >= few), dice).otherwise(0.0).alias("dice"), F.lit(n).alias("words"), F.lit(name).alias("licence"), start.alias("at"))

    def best(w: Column, p: Column) -> Column:
        out = None
        for a in ANCHORS:
            mine = [score(w, p, *t[1:]) for t in table if t[0] == a]
            if mine:
                here = F.element_at(w, p + 1) == a
                top = F.array_max(F.array(*mine))
                out = F.when(here, top) if out is None else out.when(here, top)
        return out

    found = _once(plain, lambda w: F.array_distinct(F.filter(
        F.transform(F.filter(F.transform(w, lambda x, i: F.when(x.isin(*ANCHORS), i)), lambda i: i.isNotNull()), lambda p: best(w, p)),
        lambda m: m["dice"] >= min_dice)))
    none = F.array().cast("array<struct<dice:double,words:int,licence:string,at:int>>")
    return F.when(some, found).otherwise(none)


def scan(docs: DataFrame, text: str = "text", min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id and ``found`` (see ``matches``) of every row."""
    src = spread(docs.select(docs["doc_id"], docs[text].alias("_text")))
    return src.select("doc_id", matches(F.col("_text"), min_dice).alias("found"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["licence"]))), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda m: m["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )
