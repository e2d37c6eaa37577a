"""License scans by a positional rare-token index over license notices, in DataFrame functions only.

The notices are templates: the sentences and file headers by which licenses are named. The index holds the words of the
highest IDF of each template, ``RARE`` of them, with their postings (notice, position). All words of a file are looked
up, however long it is. A posting places its notice at (word's position in the file - position in the notice); postings
are intersected by that relative position: two rare words of a template must agree on a place (one, if it has only one).
There the whole template is compared word by word, and its mandatory key phrase must stand at its own place in it: a phrase
elsewhere in the file, of another license or in a remark, vouches for nothing. Short notices must agree in every word. Beside
these, a fixed list of phrases is counted wherever its words stand consecutively.

IDF is over the notices, so the index is fixed and small and goes with the plan; files are read in one pass.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each return a row; a
null doc_id keeps its row; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases counted as such, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and name of licenses, and the ways in which a sentence grants one: a short notice for each pair. Fixed values.
NAMES = (
    ("apache-2.0", "apache license"),
    ("mit", "mit license"),
    ("bsd", "bsd license"),
    ("isc", "isc license"),
    ("zlib", "zlib license"),
    ("artistic", "artistic license"),
    ("afl", "academic free license"),
    ("epl", "eclipse public license"),
    ("mpl-2.0", "mozilla public license"),
    ("cddl", "common development and distribution license"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("unlicense", "unlicense"),
)
GRANTS = ("licensed under the", "released under the", "distributed under the", "available under the", "terms of the")
#: Notices (label, words, key phrase): sentences and file headers that publishers use to name a license. Fixed values.
NOTICES = (
    *((label, f"{grant} {name}", name) for label, name in NAMES for grant in GRANTS),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis",
        "in compliance with the license",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
        "to deal in the software without restriction",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation",
        "lesser general public license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice",
        "retain the above copyright notice",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "eclipse public license",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely",
        "alter it and redistribute it freely",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0"),
)
#: Words of each notice that the index holds.
RARE = 8
#: A notice of up to so many words must stand word for word: of "released under the x license" most words say nothing of x.
SHORT = 12


def index(notices=NOTICES) -> dict[str, tuple[float, list[tuple[int, int]]]]:
    """word -> (IDF, postings) of the words of the highest IDF of each notice; ties go to the word that comes first."""
    seen = Counter(w for _, text, _ in notices for w in set(text.split()))
    out: dict[str, tuple[float, list[tuple[int, int]]]] = {}
    for k, (_, text, _) in enumerate(notices):
        words = text.split()
        rare = sorted(dict.fromkeys(words), key=lambda w: seen[w])[:RARE]
        for at, w in enumerate(words):
            if w in rare:
                out.setdefault(w, (math.log(len(notices) / seen[w]), []))[1].append((k, at))
    return out


def normalise(text: Column) -> Column:
    """The words of a text, lower case, each between single spaces; one space if there are none."""
    words = F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    # The Kelvin sign is the one other letter whose lower case is an ASCII letter alone; it stays a letter of its own.
    return F.concat(F.lit(" "), F.trim(F.lower(F.replace(words, F.lit("\u212a"), F.lit("\u0138")))), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def places(norm: Column, phrase: str) -> Column:
    """(n, first, last) of the places where a phrase's words stand consecutively; n is 0 without one."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))

    def found(pieces: Column) -> Column:
        size = len(phrase.split())
        return F.struct(
            (F.size(pieces) - 1).cast("long").alias("n"),
            _spaces(F.element_at(pieces, 1)).cast("long").alias("first"),
            (_spaces(norm) - 1 - (_spaces(F.element_at(pieces, -1)) - 1) - size).cast("long").alias("last"),
        )

    pieces = F.split(norm, f" {phrase}(?= )", -1)
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), found(pieces)).otherwise(none)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: inside a lambda a plain expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def notices_found(norm: Column, notices=NOTICES, share: float = 0.6) -> Column:
    """Array of (label, score): for each notice and each place on which its rare words agree and where its key phrase stands,
    the share of its words that stand in place, if at least ``share`` (all of them, for a short notice)."""
    words, size = index(notices), len(notices)
    postings = F.create_map(
        *[
            x
            for w, (_, at) in words.items()
            for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in at]))
        ]
    )
    held_words = Counter(k for _, at in words.values() for k, _ in at)
    alone = [k for k in range(size) if held_words[k] == 1]
    templates = F.array(*[F.array(*[F.lit(w) for w in text.split()]) for _, text, _ in notices])
    labels = F.array(*[F.lit(label) for label, _, _ in notices])
    phrases = list(dict.fromkeys(key for _, _, key in notices))
    # Only notices whose key phrase the file holds at all are placed; that it stands where it should is asked there.
    said = F.array(*[F.contains(norm, F.lit(f" {key} ")) for key in phrases])
    key_of = F.array(*[F.lit(phrases.index(key)) for _, _, key in notices])
    key_at = F.array(*[F.lit(len(f"{text} ".split(f"{key} ")[0].split())) for _, text, key in notices])
    key_size = F.array(*[F.lit(len(key.split())) for _, _, key in notices])
    least = F.array(*[F.lit(1.0 if len(text.split()) <= SHORT else share) for _, text, _ in notices])

    def placed(all_words: Column, held: Column) -> Column:
        """place * number of notices + notice, in order, for every posting of every word of the file, of the notices held."""
        found = F.transform(all_words, lambda w, i: F.struct(F.try_element_at(postings, w).alias("q"), i.alias("i")))
        found = F.filter(found, lambda s: s["q"].isNotNull())
        kept = F.transform(
            found,
            lambda s: F.transform(
                F.filter(s["q"], lambda q: F.get(held, F.get(key_of, q["k"]))),
                lambda q: (s["i"] - q["p"]).cast("long") * size + q["k"],
            ),
        )
        return F.array_sort(F.flatten(kept))

    def agreed(v: Column) -> Column:
        """Those that two postings name; one is enough for a notice with one word in the index."""
        def twice(x: Column, i: Column) -> Column:
            enough = F.coalesce(F.get(v, i + 1) == x, F.lit(False))
            return (enough | F.pmod(x, F.lit(size)).isin(alone)) if alone else enough

        # Longs, as distinct structs are found by comparing all with all.
        return F.array_distinct(F.filter(v, twice))

    def score_at(all_words: Column, v: Column) -> Column:
        k = F.pmod(v, F.lit(size)).cast("int")
        at = ((v - k) / size).cast("int")
        want = F.get(templates, k)
        hits = F.transform(want, lambda w, j: F.coalesce(F.get(all_words, at + j) == w, F.lit(False)).cast("int"))

        def of(h: Column) -> Column:
            keyed = F.forall(F.slice(h, F.get(key_at, k) + 1, F.get(key_size, k)), lambda x: x == 1)
            score = F.aggregate(h, F.lit(0), lambda s, x: s + x) / F.size(h)
            return F.struct(F.get(labels, k).alias("label"), F.when(keyed & (score >= F.get(least, k)), score).alias("score"))

        return _let(hits, of)

    def found(w: Column) -> Column:
        at = _let(_let(said, lambda held: placed(w, held)), agreed)
        return F.filter(F.transform(at, lambda v: score_at(w, v)), lambda s: s["score"].isNotNull())

    none = F.array().cast("array<struct<label:string,score:double>>")
    return F.when(F.exists(said, lambda x: x), _let(F.split(F.trim(norm), " "), found)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts and places of the phrases, labels of phrases and notices, a score."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalise(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm")
    )
    cols = [f"p{i}" for i in range(len(PHRASES))]
    found = base.select(
        "doc_id",
        F.when(F.trim("norm") == "", 0).otherwise(_spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
        *[places(F.col("norm"), p).alias(c) for c, p in zip(cols, PHRASES)],
        notices_found(F.col("norm")).alias("notices"),
    )
    labels = F.array_compact(F.array(*[F.when(F.col(f"{c}.n") > 0, label) for c, label in zip(cols, PHRASES.values())]))
    return found.select(
        "doc_id",
        "n_words",
        sum((F.col(f"{c}.n") for c in cols[1:]), F.col(f"{cols[0]}.n")).alias("n_base"),
        F.least(*[F.col(f"{c}.first") for c in cols]).alias("first_word"),
        F.greatest(*[F.col(f"{c}.last") for c in cols]).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.transform("notices", lambda s: s["label"]))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("notices", lambda s: s["score"])), F.lit(0.0)),
            F.when(F.size(labels) > 0, 1.0).otherwise(0.0),
        ).alias("score"),
    )
