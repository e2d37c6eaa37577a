import numpy as np

from pyspark.sql import functions as F

from loomfactor.llm import ann
from loomfactor.llm.common import table

def every_20th():
    return F.col("vec_id") % 20 == 0


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_against_brute_force(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = table(spark, f"/root/testdata/{sf}", "embeddings")
        want = brute([(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None])
        got = answers(ann.search(df, every_20th()))
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        assert recall(got, want) >= 0.9
        for q, w in want.items():
            exact = dict(w)
            assert all(abs(s - exact[i]) < 1e-12 for i, s in got[q] if i in exact)
            assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(60)] + [(i, rng.normal(size=3).tolist()) for i in range(60, 120)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows + bad + rows[:3]], "vec_id long, embedding array<double>, v int, uid string")
    want = brute(rows)
    for tile in (8, 4096):
        got = answers(ann.search(df, every_20th(), share=1.0, tile=tile))
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert ann.search(df.limit(0), every_20th()).count() == 0
    few = answers(ann.search(df.filter("vec_id in (0, 1, 70)"), every_20th(), share=1.0))
    assert [i for i, _ in few[0]] == [i for i, _ in brute([r for r in rows if r[0] in (0, 1, 70)])[0]]


def test_one_vector_of_another_length_takes_no_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 50)]
    df = spark.createDataFrame([(0, [1.0]), (60, [2.0] * 9), *rows], "vec_id long, embedding array<double>")
    got, want = answers(ann.search(df, every_20th(), share=1.0)), brute(rows)
    assert got.keys() == want.keys() == {20, 40}
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_ties_go_to_the_smaller_id_whatever_the_tiles(spark):
    """All queries fall in one bucket, and far more candidates than asked for are equally near."""
    rows = [(i, [1.0, 0.0, 0.0, 0.001 * i]) for i in range(0, 2000, 20)]
    rows += [(i, [0.5, float(a), float(b), 0.0]) for i, (a, b) in enumerate(((a, b) for a in range(-7, 8) for b in range(-7, 8)), 3001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    for tile in (7, 4096):
        got = answers(ann.search(df, every_20th(), share=1.0, tile=tile))
        assert got.keys() == want.keys()
        assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
