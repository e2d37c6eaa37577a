import zlib

import numpy as np
import pytest

from loomfactor.llm import toxicity
from loomfactor.llm.common import table

SF = "/root/testdata/sf0.1"


def auc(x, y):
    rank = np.argsort(np.argsort(x, kind="stable"), kind="stable")
    pos = y == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = toxicity.classify(docs, labels)
    got = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert out.count() == docs.count()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.7
    flagged = got[got.predicted == 1]
    assert len(flagged) > 0.4 * got.toxic.sum() and flagged.toxic.mean() > 0.8
    assert all(bool(h) == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in out.select("doc_id", "held_out").limit(500).collect())


def test_log_ratio_is_that_of_the_stated_model():
    """The arrays against the formulas, word by word."""
    texts = [("you are scum", 1), ("you scum go", 1), ("you are kind", 0), ("they are kind people", 0), ("you go", 0)]
    texts = texts * 4
    rows = [(c, h, w) for t, c in texts for h, w in toxicity._distinct(toxicity.word_hashes(t)).tolist()]
    keys = sorted({r[1:] for r in rows})
    h, w = np.array(keys, dtype=np.uint64).T
    counts = np.array([[sum(r == (c, *k) for r in rows) for c in (0, 1)] for k in keys])
    kn = toxicity.KneserNey(h.copy(), w.copy(), counts)
    alone, d, k = int(toxicity._ALONE), toxicity.DISCOUNT, toxicity.SHRINK
    uni = [(c, w) for c, h, w in rows if h == alone]
    big = [(c, h, w) for c, h, w in rows if alone not in (h, w)]
    types = {w for _, w in uni}

    def rate(c, got, every, below):
        share = sum(r[0] == c for r in every) / len(every)
        expected = len(got) * share
        off = sum(r[0] == c for r in got) - expected
        room = toxicity.NOISE * np.sqrt(len(got) * share * (1 - share))
        return (expected + np.sign(off) * max(abs(off) - room, 0) + k * below) / (expected + k)

    def p(c, h, w):
        got = [r for r in uni if r[1] == w]
        r1 = rate(c, got, uni, 1.0)
        low = max(len(got) - d, 0) / len(uni) * r1 + d * len(types) / len(uni) / (len(types) + 1)
        follow = [r for r in big if r[1] == h]
        if not follow:
            return low
        sizes = {x: sum(r[2] == x for r in follow) for x in {r[2] for r in follow}}
        back = sum(1 if s == 1 else d for s in sizes.values()) / len(follow)
        both = [r for r in follow if r[2] == w]
        pairs = [r for r in big if sum(q[1:] == r[1:] for q in big) > 1]
        high = (len(both) - d) / len(follow) * rate(c, both, pairs, r1) if len(both) > 1 else 0.0
        return high + back * low

    words = toxicity.word_hashes("you scum are they unseen")
    want = sum(
        np.log(p(1, h, w) / p(0, h, w)) if w in types else 0.0
        for h, w in zip(toxicity._before(words).tolist(), words.tolist())
    )
    assert kn.log_ratio(words) == pytest.approx(want, abs=1e-12)
    assert kn.log_ratio(toxicity.word_hashes("scum")) > 0 >= kn.log_ratio(toxicity.word_hashes("kind"))


def test_nulls_empty_tables_and_extra_columns(spark):
    rows = [(i, "you scum idiot" if i % 2 else "kind words here", "x") for i in range(200)]
    rows += [(None, "x", "y"), (900, None, "y"), (901, "", "y"), (902, "idiot " * 60000, "y"), (3, "you scum idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(150)] + [(None, 1), (7, None), (3, 1)], "doc_id long, toxic int"
    )
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r for r in out}
    assert got[902].predicted == 1 and got[199].predicted == 1 and got[198].predicted == 0
    assert got[900].score == got[901].score and got[None].held_out is False
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert len({r.score for r in toxicity.classify(docs, some).collect()}) == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_sample_keeps_its_bounds(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.sample(docs, labels, 100, 50_000).toPandas()
    sizes = got.assign(n=got.text.str.len()).groupby("label").n.agg(["count", "sum"])
    assert (sizes["count"] <= 100).all() and (sizes["sum"] <= 50_000).all()


def test_lower_order_counts_the_distinct_words_before(spark):
    """Hand-counted: 'francisco' is in ten texts but only behind 'san', 'rose' in three behind three words."""
    said = ["in san francisco now"] * 10 + ["a rose", "the rose", "red rose"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(said * 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(said) * 4)], "doc_id long, toxic int")
    kn = toxicity.fit(docs, labels).kn
    low = {w: kn.unigram[toxicity._find(kn.words, toxicity.word_hashes(w))[0][0]] for w in ("francisco", "rose", "san")}
    assert (low["rose"] > low["francisco"]).all() and low["francisco"] == pytest.approx(low["san"])
    # Distinct pairs: four of the first text with the start, and (start, a), (start, the), (start, red), three before rose.
    total, types, d = 10, 8, toxicity.DISCOUNT
    rest = d * types / total / (types + 1)
    assert low["francisco"] == pytest.approx((1 - d) / total + rest) and low["rose"] == pytest.approx((3 - d) / total + rest)
    pairs = spark.createDataFrame([(1, 9, 2, 1, 0, 0), (2, 9, 0, 3, 1, 0), (3, 9, 0, 0, 0, 1)], "h long, w long, n0 int, n1 int, n2 int, n3 int")
    assert tuple(toxicity.continuations(pairs).first()) == (9, 2, 2, 3)


def test_lower_order_grows_with_the_corpus(spark):
    """Documents without a label add contexts: counts follow those of all texts by brute force, and repeats add none."""
    labelled = [(i, "you scum go" if i % 2 else "you kind go") for i in range(60)]
    more = [(1000 + i, f"w{i} scum  go.\n{'scum ' * (i % 3)}kind") for i in range(900)] + [(2000, None), (2001, ""), (None, "last kind")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for rows in (labelled, labelled + more, labelled + more * 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        pairs = set()
        for _, text in rows:
            words = toxicity.word_hashes(text)
            pairs |= set(zip(toxicity._before(words).tolist(), words.tolist()))
        known = np.sort(toxicity.word_hashes("you scum kind go"))
        want = {x: sum(w == x for _, w in pairs) for x in known.tolist()}
        got = {np.int64(r.w).view(np.uint64).item(): r.n for r in toxicity.corpus_continuations(docs, known).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=4 * toxicity.CONTEXT_ERROR) for x in want)
        kn = toxicity.fit(docs, labels).kn
        assert kn.words.tolist() == known.tolist()
        # The word 'you' is in as many documents of either class, so its rates are 1.
        total, types, d, at = sum(got.values()), len(known), toxicity.DISCOUNT, int(toxicity.word_hashes("you")[0])
        you = int(np.searchsorted(kn.words, np.uint64(at)))
        assert kn.unigram[you] == pytest.approx((got[at] - d) / total + d * types / total / (types + 1))
