import hashlib
from collections import defaultdict

import numpy as np
import pytest

from loomfactor.llm import anchors, substring, suffix_array
from loomfactor.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_bytes(docs, window):
    raw = [(d, (t or "").encode()) for d, t in docs]
    places = defaultdict(int)
    for _, b in raw:
        for i in range(len(b) - window + 1):
            places[b[i : i + window]] += 1
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        last = 0
        for i in range(len(b) - window + 1):
            if places[b[i : i + window]] > 1:
                for j in range(max(i, last), i + window):
                    gone[j] = True
                last = i + window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((repr(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, window):
    far = 2**63
    split = [(far if d is None else d, d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for o, _, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, o), o)
    out = []
    for o, d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < o:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((repr(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((repr(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_documents_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(suffix_array.remove_repeats(docs)) == brute_bytes(plain, 200)
    assert rows(substring.remove_repeats(docs)) == brute_words(plain, 13)


@pytest.mark.parametrize("tile", [1, 3, 20000])
def test_edges(spark, tile):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    make = lambda: " ".join(f"w{x}" for x in rng.integers(0, 900, 40))
    docs = [(i, f"{make()} {' '.join(passage.split()[i % 7 : 60 - i % 5])} {make()}") for i in range(24)]
    docs += [(100, None), (101, ""), (102, "a" * 700), (103, "b" * 199), (104, "a" * 450), (105, "x y " * 300), (106, "short one")]
    docs += [(107, docs[3][1]), (107, docs[3][1]), (None, docs[4][1]), (None, passage), (108, "é" * 150 + " ü " + "é" * 150)]
    docs += [(109, (make() + " ") * 3), (110, " ".join(make() for _ in range(500)))]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, c long, tk string")
    assert rows(suffix_array.remove_repeats(df, tile=tile)) == brute_bytes(docs, 200)
    assert rows(substring.remove_repeats(df, tile=tile)) == brute_words(docs, 13)
    kept = suffix_array.remove_repeats(df, tile=tile, keep_text=True).select("doc_id", "kept", "n_removed").collect()
    texts = {d: t for d, t in docs}
    assert all(r.kept == (texts[r.doc_id] or "") for r in kept if r.n_removed == 0 and r.doc_id is not None)
    assert suffix_array.remove_repeats(df.limit(0)).count() == 0 == substring.remove_repeats(df.limit(0)).count()


def test_crowded_classes_are_cut_until_none_is(spark):
    """A passage that many texts share in part: pieces hold the windows of their contents, equal windows meet in one class."""
    from loomfactor.llm import repeats

    rng, window, gram = np.random.default_rng(5), 13, 4
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"a{rng.integers(9)}", *passage[rng.integers(8) : 40 - rng.integers(20)], f"b{rng.integers(9)}"]) for _ in range(60)]
    docs = repeats.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stuff = repeats.contents(repeats.repeated(repeats.segment_table(docs, substring.word_symbols, window, gram))).cache()
    known = repeats.with_symbols(docs, stuff, substring.word_symbols, window).cache()
    decode = lambda raw: np.frombuffer(raw, np.uint64)
    usual, cuts = repeats.refined(known, decode, window, gram, 2)
    assert repeats.largest_class(stuff) > 2 >= max(r.k for r in usual.collect()) and len(cuts) > 1
    whole = {(r.c, r.f): decode(r.symbols).tolist() for r in known.collect()}
    crowded = {(r.c, r.f) for r in known.collect() if r.k > 2}
    classes, covered = defaultdict(set), defaultdict(list)
    for r in repeats.pieces(known.filter("k > 2"), decode, window, gram, 4).collect():
        own = whole[r.pc, r.pf]
        assert decode(r.symbols).tolist() == own[r.start : r.start + r.n + window - 1]
        covered[r.pc, r.pf] += range(r.start, r.start + r.n)
        for j in range(r.start, r.start + r.n):
            classes[tuple(own[j : j + window])].add(r.c)
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(len(whole[k]) - window + 1)) for k in crowded}
    assert all(len(c) == 1 for c in classes.values())


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    y = np.concatenate([rng.integers(0, 3, 55).astype(np.uint64), x[100:300], rng.integers(0, 3, 70).astype(np.uint64)])
    at = []
    for seq in (x, y):
        key, start, n, anchor, _ = anchors.segments(seq, 20, 6)
        at.append({s + j: (k, a - s - j) for k, s, m, a in zip(key, start, n, anchor) for j in range(m)})
        assert sorted(at[-1]) == list(range(len(seq) - 19))
    assert all(at[0][100 + i] == at[1][55 + i] for i in range(200 - 19))


def test_automaton_against_plain_search():
    rng = np.random.default_rng(4)
    known = [rng.integers(0, 3, 12).tolist() for _ in range(6)]
    sam = substring.SuffixAutomaton()
    for s in known:
        sam.add(s)
    factors = {tuple(s[i:j]) for s in known for i in range(12) for j in range(i + 1, 13)}
    text = rng.integers(0, 4, 60).tolist()
    want = [max((m for m in range(1, e + 2) if tuple(text[e + 1 - m : e + 1]) in factors), default=0) for e in range(60)]
    assert sam.matching(text) == want


def test_both_ways_to_find_repeated_segments(spark):
    from loomfactor.llm import repeats

    docs = repeats.keyed(table(spark, SF, "documents"))
    common = repeats.common_anchors(docs, substring.word_symbols, 13, 4, least=4)
    assert len(common)
    plain, dealt = (repeats.segment_table(docs, substring.word_symbols, 13, 4, x) for x in (None, common))
    a, b, c = (sorted(map(tuple, f(x).drop("salt").collect())) for f, x in ((repeats.repeated, plain), (repeats.repeated_by_sort, plain), (repeats.repeated_by_sort, dealt)))
    assert a == b == c and len(a) > 100
    assert {s for (s,) in dealt.select("salt").distinct().collect()} > {0}


def _array(rng, texts, window, start):
    raw = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in texts]
    n = np.array([len(x) - window + 1 for x in raw])
    ids = np.arange(start, start + len(raw))
    return suffix_array.SuffixArray(ids, ids, n, np.frombuffer(b"".join(raw), np.uint8), window), raw


def test_suffix_arrays_are_in_byte_order_and_merge():
    """Order, common prefixes, merging and lookup against plain sorting of the suffixes."""
    rng, window = np.random.default_rng(8), 9
    (one, a), (two, b) = _array(rng, [40, 9, 33], window, 0), _array(rng, [25, 60], window, 10)
    merged, hit = one.merge(two)
    for array, texts in ((one, a), (two, b), (merged, a + b)):
        said = [array.raw[p : p + window].tobytes() for p in array.order]
        want = sorted(x[i : i + window] for x in texts for i in range(len(x) - window + 1))
        assert said == want
        shared = [next((k for k in range(window) if x[k] != y[k]), window) for x, y in zip(want, want[1:])]
        assert array.lcp.tolist() == [0, *shared]
    sides = [{x[i : i + window] for x in texts for i in range(len(x) - window + 1)} for texts in (a, b)]
    both = sides[0] & sides[1]
    assert both and [s in both for s in (merged.raw[p : p + window].tobytes() for p in merged.order)] == hit.tolist()
    mine, theirs = one.lookup(two)
    for array, marks in ((one, mine), (two, theirs)):
        assert [array.raw[p : p + window].tobytes() in both for p in array.order] == marks.tolist()
    c, _, first, last = two.ranges(theirs)
    got = {(int(x) - 10, i) for x, s, e in zip(c, first, last) for i in range(s, e + 1)}
    assert got == {(t, i) for t, x in enumerate(b) for i in range(len(x) - window + 1) if x[i : i + window] in both}


@pytest.mark.parametrize("batches", [1, 5])
def test_any_number_of_batches_gives_the_same(spark, batches):
    docs = table(spark, SF, "documents")
    assert rows(suffix_array.remove_repeats(docs, batches=batches)) == brute_bytes([(r.doc_id, r.text) for r in docs.collect()], 200)
