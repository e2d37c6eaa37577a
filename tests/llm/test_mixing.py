import numpy as np
import pytest

from pyspark.sql import functions as F

from loomfactor.llm import mixing
from loomfactor.llm.common import table


def totals(rows):
    m = np.array([r.tokens for r in rows], float)
    p, rate = np.array([r.p for r in rows]), np.array([r.rate for r in rows])
    return (m * rate) @ p / m.sum()


def brute_rates(rows, targets, steps):
    """The same projected steps on arrays."""
    m = np.array([r.tokens for r in rows], float) / sum(r.tokens for r in rows)
    p = np.array([r.p for r in rows])
    rate = np.ones(len(rows))
    g = (p * m[:, None]).T @ p + 1e-9 * np.eye(p.shape[1])
    for _ in range(steps):
        residual = (m * rate) @ p - targets
        if np.abs(residual).max() < 1e-6:
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve(g, residual))
    return rate


@pytest.mark.parametrize("weights", [{"q0": 0.5, "q1": 0.5}, {"q0": 0.02, "q1": 0.98}])
def test_expected_totals_match_targets(spark, weights):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("domain"))
    rows = mixing.mix(docs, labels, weights).collect()
    want = np.array([weights[k] for k in sorted(weights)])
    assert len(rows) == docs.count() and min(r.rate for r in rows) >= 0
    assert np.allclose(totals(rows), want, atol=1e-4)
    assert np.allclose([r.rate for r in rows], brute_rates(rows, want, 30), atol=1e-6)
    assert np.allclose([sum(r.p) for r in rows], 1)


def test_posteriors_follow_the_words(spark):
    docs = [(i, ("alpha beta " if i % 2 else "gamma delta ") * 20, "x") for i in range(60)] + [(None, "alpha", "x"), (90, None, "x"), (91, "", "x"), (3, "alpha beta " * 20, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, domain string")
    labels = spark.createDataFrame([(i, "ab" if i % 2 else "cd") for i in range(40)] + [(None, "ab"), (5, None)], "doc_id long, domain string")
    rows = mixing.mix(df, labels, {"ab": 0.8, "cd": 0.2, "none": 0.5}).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and by[59].p[0] > 0.95 and by[58].p[1] > 0.95 and by[90].tokens == 0
    assert np.allclose(totals(rows), [0.8, 0.2], atol=1e-4) and by[59].rate > 1 > by[58].rate
    assert {r.rate for r in mixing.mix(df, labels.limit(0), {"ab": 1.0}).collect()} == {1.0}
    assert mixing.mix(df.limit(0), labels, {"ab": 1.0}).count() == 0


def test_four_overlapping_domains_meet_their_targets(spark):
    rng = np.random.default_rng(5)
    share = rng.dirichlet(np.ones(4), 400)
    docs = [(i, " ".join(f"w{j}" for j in rng.choice(4, 40, p=q))) for i, q in enumerate(share)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, f"d{q.argmax()}") for i, q in enumerate(share)], "doc_id long, domain string")
    want = np.array([0.4, 0.3, 0.2, 0.1])
    rows = mixing.mix(df, labels, {f"d{i}": w for i, w in enumerate(want)}, sharp=4.0).collect()
    m, p = np.array([r.tokens for r in rows], float), np.array([r.p for r in rows])
    assert np.abs((m / m.sum() * brute_rates(rows, want, 30)) @ p - want).max() > 1e-3
    assert np.abs(totals(rows) - want).max() < 2e-6 and min(r.rate for r in rows) >= 0


def test_targets_out_of_reach_are_met_as_nearly_as_possible(spark):
    rows = spark.createDataFrame([(10, [0.6, 0.4], 1.0), (10, [0.4, 0.6], 1.0)], "tokens long, p array<double>, rate double")
    steps, residual = mixing.finish(rows, np.array([0.9, 0.1]), 1e-6)
    best = (0.9 * 0.6 + 0.1 * 0.4) / (0.6**2 + 0.4**2)
    assert steps and np.allclose(residual, [0.6 * best - 0.9, 0.4 * best - 0.1], atol=1e-5)


def test_rates_that_do_not_settle_are_the_nearest_found(spark):
    """Too few rounds: the best steps and their residual come back, and mix() warns."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(n), p.tolist(), 1.0) for n, p in zip(rng.integers(1, 50, 40), rng.dirichlet([1, 1, 1], 40))], "tokens long, p array<double>, rate double")
    start = mixing.finish(rows, np.array([0.98, 0.01, 0.01]), 1e-12, rounds=0)
    assert start[0] == []
    one = mixing.finish(rows, np.array([0.98, 0.01, 0.01]), 1e-12, rounds=1)
    more = mixing.finish(rows, np.array([0.98, 0.01, 0.01]), 1e-12, rounds=4)
    assert len(one[0]) <= 1 and np.abs(more[1]).max() <= np.abs(one[1]).max() <= 1


def brute_posteriors(docs, labels, domains, sharp):
    """Naive Bayes over hashed words, counted in plain Python."""
    said = [(d, (mixing.word_hashes(t) % mixing.BUCKETS).astype(int).tolist()) for d, t in docs]
    counts = {k: np.ones(mixing.BUCKETS) for k in domains}
    for d, k in labels:
        for at, words in said:
            if at == d:
                np.add.at(counts[k], words, 1)
    prior = np.array([1.0 + sum(k == x for _, x in labels) for k in domains])
    out = []
    for _, words in said:
        logs = [np.mean([np.log(counts[k][w] / counts[k].sum()) for w in words]) if words else 0.0 for k in domains]
        p = np.exp(np.log(prior / prior.sum()) + sharp * np.array(logs))
        out.append((len(words), p / p.sum()))
    return out


def test_posteriors_and_columns_against_plain_python(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"x{j}" for j in rng.integers(0, 12, 30) + 6 * (i % 3))) for i in range(30)] + [(90, None), (91, "")]
    labels = [(i, f"d{i % 3}") for i in range(20)] + [(4, "d2")]
    df = spark.createDataFrame([(*d, -1, "p", 2.0) for d in docs], "doc_id long, text string, tokens int, p string, rate double")
    known = spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.mix(df, known, {"d0": 0.2, "d1": 0.3, "d2": 0.5}).orderBy("doc_id").collect()
    want = brute_posteriors(docs, labels, ["d0", "d1", "d2"], 20.0)
    assert [r.tokens for r in got] == [n for n, _ in want] and np.allclose([r.p for r in got], [p for _, p in want], atol=1e-4)
    assert np.allclose(totals(got), [0.2, 0.3, 0.5], atol=1e-5)
    none = mixing.mix(df, known.limit(0), {"d0": 1.0}, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.tokens, r.p, r.rate) for r in none] == [(d, n, [], 1.0) for (d, _), (n, _) in zip(docs, want)]
    assert mixing.mix(df.filter("doc_id >= 90"), known, {"d0": 1.0}).count() == 2
