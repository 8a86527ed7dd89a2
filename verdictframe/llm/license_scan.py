"""License scans by a positional rare-token index, in DataFrame functions alone.

Templates are licence notices, whole where they are short enough to stand in a file's head, with mandatory key phrases:
those that tell one licence from its kin (a version, the clause that another one lacks). A template is cut into
segments of about SEGMENT words. A segment stands at a place of a text when at least the share AGREE of its words stand in
their places behind it, a phrase where all of its words do. Each such place says where the template would begin; a
template matches where segments and phrases agree on that up to a drift (all within 2 DRIFT words that start at a
multiple of DRIFT), the best places of its segments hold at least the share AGREE of its words, and each of its phrases
stands there. So words may be inserted or left out between and in segments. This definition doesn't depend on the other texts.

Places are found by an index: of each segment and phrase, the postings of its rarest words (by document frequency over
the scanned texts, a ranking and nothing more) are kept, so many that a match must hold one of them in its place: one
word more than it may lack. A text's licence words are looked up in the postings, the difference between the two places
is where the segment would begin, and the words of all postings are intersected there by relative position. Only texts
with a mandatory phrase are looked up at all. A family label (FAMILIES) yields to the labels of its members.

Each text is cut into words once. What follows stays inside its row; the places found, a few short rows a text with a
notice, are dealt by row and gathered. The index, a fixed table of a few hundred entries, is part of the plan.

Base labels come from the places where a phrase's words stand consecutively.

Defined results: a null text counts as an empty one: no words, no places, no labels (empty strings), null first and
last word, score 0. Repeated rows each get a row. Further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import cut, only

#: The phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_CONDITIONS = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_DISCLAIMER = "this software is provided by the copyright holders and contributors as is"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"

#: Fixed values, the licences' own words: label, notice and mandatory phrases of it (all of them).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0-or-later", _GPL.format("", "3"), ["gnu general public license as published", "either version 3"]),
    ("gpl-2.0-or-later", _GPL.format("", "2"), ["gnu general public license as published", "either version 2"]),
    ("lgpl-3.0-or-later", _GPL.format("lesser ", "3"), ["gnu lesser general public license", "either version 3"]),
    ("lgpl-2.1-or-later", _GPL.format("lesser ", "2 1"), ["gnu lesser general public license", "either version 2 1"]),
    ("agpl-3.0-or-later", _GPL.format("affero ", "3"), ["gnu affero general public license", "either version 3"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4"]),
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("bsd", _BSD, ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", f"{_BSD} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}", ["redistribution and use in source and binary forms", "provided with the distribution this software is provided"]),
    ("bsd-3-clause", f"{_BSD} {_BSD_CONDITIONS} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_DISCLAIMER}", ["redistribution and use in source and binary forms", "neither the name of"]),
    ("isc-like", _ISC, ["permission to use copy modify and or distribute"]),
    ("isc", f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute", "provided that the above copyright notice and this permission notice appear"]),
    ("0bsd", f"{_ISC} the software is provided as is and the author disclaims all warranties", ["permission to use copy modify and or distribute", "is hereby granted the software is provided"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]
#: A family's label stands where none of its members does.
FAMILIES = {"bsd": ["bsd-2-clause", "bsd-3-clause"], "isc-like": ["isc", "0bsd"]}

#: A match needs this share of the template's words in their places; segments have about so many words.
AGREE, SEGMENT, DRIFT = 0.6, 8, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = "  "


def tokens(text: Column) -> Column:
    """Lower-case words of a text; none of a null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT)
    return F.filter(parts, lambda w: w != "")


def _phrase(words: str) -> str:
    return f" {GAP.join(words.split())} "


def _places(joined: Column, phrase: str) -> Column:
    return F.size(F.split(joined, F.lit(_phrase(phrase)), -1)).cast("long") - 1


def _word_before(prefix: Column) -> Column:
    """How many words stand in the part of a joined text before a phrase."""
    gaps = F.floor((F.length(prefix) - F.length(F.replace(prefix, F.lit(GAP), F.lit("")))) / len(GAP))
    return F.when(prefix == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def base(words: Column, joined: Column) -> dict[str, Column]:
    has = {p: F.contains(joined, F.lit(_phrase(p))) for p in PHRASES}
    places = {p: F.when(has[p], _places(joined, p)).otherwise(F.lit(0).cast("long")) for p in PHRASES}
    first = [F.when(has[p], _word_before(F.substring_index(joined, _phrase(p), 1))) for p in PHRASES]
    last = [F.when(has[p], _word_before(F.expr("substring(joined, 1, length(joined) - length(substring_index(joined, '{0}', -1)) - {1})".format(_phrase(p), len(_phrase(p)))))) for p in PHRASES]
    labels = F.array_sort(F.array_compact(F.array(*(F.when(has[p], F.lit(x)) for p, x in PHRASES.items()))))
    return {
        "n_words": F.size(words).cast("long"),
        "n_base": sum(places.values(), F.lit(0).cast("long")),
        "first_word": F.least(*first),
        "last_word": F.greatest(*last),
        "base_set": labels,
    }


def needed(size: int) -> int:
    """How many of so many words must stand in their places."""
    return math.ceil(AGREE * size)


class Piece(NamedTuple):
    """A segment or a phrase of a template: its words, its place in the notice, how many words it needs."""

    template: int
    words: list[str]
    offset: int
    needed: int
    phrase: bool


def pieces_of(templates: list[tuple[str, str, list[str]]]) -> list[Piece]:
    out = []
    for k, (_, notice, phrases) in enumerate(templates):
        words = notice.split()
        n = max(1, len(words) // SEGMENT)
        cuts = [i * len(words) // n for i in range(n + 1)]
        out += [Piece(k, words[a:b], a, needed(b - a), False) for a, b in pairwise(cuts)]
        for phrase in phrases:
            own = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            out.append(Piece(k, own, at, len(own), True))
    return out


def postings(pieces: list[Piece], frequencies: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word: (piece, place) of the rarest words of each piece, of which every match holds at least one in its place."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, piece in enumerate(pieces):
        rarest = sorted(range(len(piece.words)), key=lambda i: (frequencies.get(piece.words[i], 0), piece.words[i], i))
        for place in rarest[: len(piece.words) - piece.needed + 1]:
            found.setdefault(piece.words[place], []).append((k, place))
    return found


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def licence_rows(documents: DataFrame, templates: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Per row: row_id, doc_id, the base columns, the licence words it holds, and its words if it holds a mandatory phrase."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    words = documents.select("doc_id", tokens(F.col("text")).alias("words"))
    joined = words.select("*", F.concat(F.lit(" "), F.array_join("words", GAP), F.lit(" ")).alias("joined"))
    phrased = F.lit(False)
    for phrase in sorted({p for _, _, phrases in templates for p in phrases}):
        phrased = phrased | F.contains(F.col("joined"), F.lit(_phrase(phrase)))
    columns = base(F.col("words"), F.col("joined"))
    return joined.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", *(c.alias(n) for n, c in columns.items()), F.array_intersect("words", _strings(vocabulary)).alias("held"), F.when(phrased, F.col("words")).alias("words"))


def word_frequencies(rows: DataFrame) -> dict[str, int]:
    """In how many texts each licence word stands; as many rows as there are licence words come to the driver."""
    return {r["word"]: r["df"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}


#: A place where a piece would begin is one number: the piece above these bits, the place and BEFORE below.
PLACE_BITS, BEFORE = 40, 1 << 20


def places(words: Column, held: Column, pieces: list[Piece], index: dict[str, list[tuple[int, int]]]) -> Column:
    """array of (piece, start, agree): where pieces stand in a text's words."""
    offsets = F.create_map(*(x for w in sorted(index) for x in (F.lit(w), F.array(*(F.lit((k << PLACE_BITS) + BEFORE - place) for k, place in index[w])).cast("array<bigint>"))))
    known = F.array(*(F.struct(_strings(p.words).alias("words"), F.lit(len(p.words)).alias("size"), F.lit(p.needed).alias("needed")) for p in pieces))
    looked_up = F.array_intersect(held, _strings(sorted(index)))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("at"))), lambda x: F.array_contains(looked_up, x["word"]))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(offsets, x["word"]), lambda o: o + x["at"]))))

    def place(code: Column) -> Column:
        piece = F.get(known, F.shiftright(code, PLACE_BITS).cast("int"))
        start = (F.pmod(code, F.lit(1 << PLACE_BITS)) - BEFORE).cast("int")
        agree = F.size(F.filter(F.sequence(F.lit(0), piece["size"] - 1), lambda i: F.get(words, start + i) == F.get(piece["words"], i)))
        return F.struct(F.shiftright(code, PLACE_BITS).cast("int").alias("piece"), start.alias("start"), agree.alias("agree"))

    return F.filter(F.transform(starts, place), lambda m: m["agree"] >= F.get(known, m["piece"])["needed"])


def _of_piece(values: list, kind: str) -> Column:
    return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("piece"))


def matches(rows: DataFrame, templates: list[tuple[str, str, list[str]]]) -> DataFrame:
    """matched (row_id), found: array of (template, start, share) of the texts with a match; rows has row_id, words and held."""
    pieces = pieces_of(templates)
    index = postings(pieces, word_frequencies(rows))
    looked = rows.where("words is not null").select("row_id", F.explode(places(F.col("words"), F.col("held"), pieces, index)).alias("m")).select("row_id", "m.*")
    begin = F.col("start") - _of_piece([p.offset for p in pieces], "int")
    placed = looked.select("row_id", "piece", "agree", _of_piece([p.template for p in pieces], "int").alias("template"), _of_piece([p.phrase for p in pieces], "boolean").alias("phrase"), begin.alias("begin")).repartition("row_id")
    nth = F.floor(F.col("begin") / DRIFT)
    near = placed.select("*", F.explode(F.array(nth - 1, nth)).alias("bucket"))
    best = near.groupBy("row_id", "template", "bucket", "piece", "phrase").agg(F.max("agree").alias("agree"), F.min("begin").alias("begin"))
    together = best.groupBy("row_id", "template", "bucket").agg(F.sum(F.when(~F.col("phrase"), F.col("agree")).otherwise(0)).alias("agree"), F.count_if("phrase").alias("phrases"), F.min("begin").alias("start"))
    size = lambda values: F.get(F.array(*map(F.lit, values)), F.col("template"))
    sizes, demanded = [len(n.split()) for _, n, _ in templates], [len(p) for _, _, p in templates]
    good = together.where((F.col("agree") >= size([needed(n) for n in sizes])) & (F.col("phrases") == size(demanded)))
    one = good.groupBy("row_id", "template", "start").agg(F.max(F.col("agree") / size(sizes)).alias("share"))
    return one.groupBy(F.col("row_id").alias("matched")).agg(F.array_sort(F.collect_list(F.struct("template", "start", "share"))).alias("found"))


def scan(documents: DataFrame, templates: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_matches."""
    templates = TEMPLATES if templates is None else templates
    rows = cut(licence_rows(only(documents, "doc_id", "text"), templates))
    none = F.array().cast("array<struct<template:int,start:int,share:double>>")
    found = rows.join(matches(rows, templates), F.col("row_id") == F.col("matched"), "left").withColumn("found", F.coalesce("found", none))
    labels = F.array_distinct(F.transform("found", lambda m: F.get(_strings([label for label, _, _ in templates]), m["template"])))
    for family, members in FAMILIES.items():
        labels = F.when(F.arrays_overlap(labels, _strings(members)), F.array_except(labels, _strings([family]))).otherwise(labels)
    every = F.array_sort(F.array_union("base_set", "own_labels"))
    return found.withColumn("own_labels", labels).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base_set") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        F.size("found").cast("long").alias("n_matches"),
    )
