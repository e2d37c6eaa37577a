import re
from collections import Counter, defaultdict

import pyarrow as pa

from loomfactor.llm import divergence
from loomfactor.llm.common import table


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, least=3, best=200):
    """Every kept term of every pair of groups, in plain Python."""
    groups, counts, held = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", words_of(text)
        groups[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        terms = [t for t, n in held[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in terms) + len(terms)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in terms}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms)) for o in sources if o != s]
            own = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, best)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)}
    return out


def check(df, **options):
    got = divergence.audit(df, **options).collect()
    want = brute([(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()], **options)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    return want


def test_documents_against_plain_python(spark):
    assert check(table(spark, "/root/testdata/sf0.001", "documents"))
    assert check(table(spark, "/root/testdata/sf0.001", "documents"), least=1, best=3)


def test_edges(spark):
    rows = [
        ("en", "a", "The the cat, THE dog"), ("en", "b", "the cat"), ("en", "c", "the Ünder cat cat"), ("en", "d", None), ("en", None, ""), ("en", "b", "the ünder dog"),
        (None, None, "x y"), (None, "a", "x x y"), ("", "a", "x"), ("de", "only", "eins zwei"), ("fr", "a", "un"), ("fr", "b", "deux"), ("it", "a", ""), ("it", "b", None),
        ("en", "a", "the " * 100_000), ("en", "e", "1 2 3 K \u212a _ -"),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows + rows[:3]], "lang string, source string, text string, term string, n int")
    check(df)
    check(df, least=1, best=2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_ties_and_one_common_word_in_many_sources(spark):
    rows = [("en", f"s{i % 40}", f"all {'x' if i % 2 else 'y'} w{i % 7}") for i in range(400)]
    check(spark.createDataFrame(rows, "lang string, source string, text string"))


def test_counts_grow_together_whatever_the_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 50)
    monkeypatch.setattr(divergence, "HELD", 8)
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "source": f"s{i % 3}", "text": f"a b{i % 11} c{i % 5} " * (1 + i % 4)} for i in range(200)])
    found = pa.Table.from_batches(list(divergence._count(iter([batch, batch.slice(0, 7)])))).to_pylist()
    got, docs = Counter(), Counter()
    for r in found:
        got[r["source"], r["term"]] += r["n"]
        docs[r["source"], r["term"]] += r["df"]
    want, held = Counter(), Counter()
    for r in [*batch.to_pylist(), *batch.slice(0, 7).to_pylist()]:
        for w in words_of(r["text"]):
            want[r["source"], w] += 1
        held.update((r["source"], w) for w in set(words_of(r["text"])))
    assert {k: v for k, v in got.items() if k[1]} == want and {k: v for k, v in docs.items() if k[1]} == held
    assert {k for k in got if not k[1]} == {(f"s{i}", "") for i in range(3)}
