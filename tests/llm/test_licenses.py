import re

from loomfactor.llm import licenses
from loomfactor.llm.common import table


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    words = words_of(text)
    at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    every = [i for v in at.values() for i in v]
    base = {licenses.PHRASES[p] for p, v in at.items() if v}
    found = []
    for label, notice, key in licenses.NOTICES:
        want, said = notice.split(), key.split()
        if not set(said) <= set(words):
            continue
        at_key = next(i for i in range(len(want)) if want[i : i + len(said)] == said)
        least = 1.0 if len(want) <= 12 else 0.6
        many = {w: sum(w in n.split() for _, n, _ in licenses.NOTICES) for w in want}
        rare = sorted(many, key=lambda w: (many[w], want.index(w)))[: licenses.RARE]
        for start in range(-len(want), len(words)):
            same = [j for j, w in enumerate(want) if 0 <= start + j < len(words) and words[start + j] == w]
            keyed = start + at_key >= 0 and words[start + at_key : start + at_key + len(said)] == said
            if keyed and sum(want[j] in rare for j in same) >= min(2, sum(w in rare for w in want)) and len(same) / len(want) >= least:
                found.append((label, len(same) / len(want)))
    score = max([s for _, s in found] + [1.0 if base else 0.0])
    labels = sorted(base | {x for x, _ in found})
    return (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(labels), score)


def check(df):
    got = sorted((repr(r.doc_id), tuple(r)[1:]) for r in licenses.scan(df).collect())
    assert got == sorted((repr(r.doc_id), brute(r.text)) for r in df.select("doc_id", "text").collect())


def test_matches_brute_force(spark):
    check(table(spark, "/root/testdata/sf0.01", "documents").filter("n_chars < 3000 or doc_id % 40 = 0"))


def test_edges(spark):
    texts = [
        None, "", " -- ", "CC BY", "cc by cc by", "cc-by cc", "All Rights Reserved. all rights reserved",
        "x GENERAL public\nLicense y cc by", "Licensed under CC BY-NC 4.0. Released under the MIT License",
        "under the apache license version 2 0", "apache license", "ccé by cc by", "İcc by", "cc \u212a cc by \u212aby", "é " * 60000 + "all rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this work",
    ]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "cc by", "x", 1), (3, "CC BY", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, norm int")
    check(df)
    assert licenses.scan(df.limit(0)).count() == 0


def test_notices_among_many_other_notice_words(spark):
    """Words that other notices hold too do not keep a notice from being looked up."""
    others = "a file holds 1 or 3 and any are attribution binary charge copy creative dedicated domain forms "
    said = ["Released under the MIT License", "subject to the terms of the Mozilla Public License v 2 0", "dedicated to the public domain under CC0 1 0 universal"]
    texts = [others * n + x for n in (1, 2000) for x in said] + [others + " . ".join(said), others + "mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == ["mit", "mpl-2.0", "cc0"] * 2 + ["cc0,mit,mpl-2.0", ""]


def test_a_key_phrase_away_from_its_notice_names_nothing(spark):
    """Every notice with another license's key phrase elsewhere in the text keeps its own label alone."""
    texts = [
        "released under the apache license and is not under the mit license",
        "the mit license is not used here; released under the bsd license",
        "licensed under the terms that the mit license has, under the apache",
        "permission is hereby granted, and the mit license is free of charge to any person",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == ["apache-2.0", "bsd", "", ""]
    keys = {label: key for label, _, key in licenses.NOTICES if label != "cc-by" and "general public license" not in key}
    rows = []
    for i, (label, notice, key) in enumerate(licenses.NOTICES):
        other = next(k for x, k in sorted(keys.items(), reverse=bool(i % 2)) if x != label and k not in notice)
        rows.append((i, f"{other}. {notice}. unlike {other}", label))
    df = spark.createDataFrame(rows, "doc_id long, text string, said string")
    alone = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(i, n) for i, (_, n, _) in enumerate(licenses.NOTICES)], "doc_id long, text string")).collect()}
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == alone and all(label in got[i].split(",") for i, (label, _, _) in enumerate(licenses.NOTICES))


def test_long_notices_may_have_words_of_their_own(spark):
    text = "Permission is hereby granted, free of charge, to any organisation obtaining a copy of this software"
    df = spark.createDataFrame([(1, text), (2, text.replace("free of charge", "free of any charge"))], "doc_id long, text string")
    check(df)
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == ["mit", ""]


def test_a_file_with_all_notices_has_all_labels(spark):
    every = " | ".join(f"{text}." for _, text, _ in licenses.NOTICES)
    some = " ".join(" ".join(w if i % 5 else "zz" for i, w in enumerate(text.split())) for _, text, _ in licenses.NOTICES)
    df = spark.createDataFrame([(0, every), (1, every * 40), (2, some), (3, "# " + every.replace(" ", "\n * "))], "doc_id long, text string")
    check(df.filter("doc_id <> 1"))
    want = ",".join(sorted({label for label, _, _ in licenses.NOTICES}))
    assert {r.labels for r in licenses.scan(df.filter("doc_id <> 2")).collect()} == {want}
