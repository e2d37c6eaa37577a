import re

import numpy as np
import pytest
import xxhash

from loomfactor.llm import simhash
from loomfactor.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    """Labels of all rows, by comparing every pair."""
    f = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.arange(len(f))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def check(rows, docs):
    ids = [d for d, _ in docs]
    fps = [brute_fingerprint(t) for _, t in docs]
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    labels = brute_components([fps[i] for i in order])
    want = sorted((ids[i], f"{fps[i]:016x}", ids[order[labels[k]]]) for k, i in enumerate(order))
    assert sorted(map(tuple, rows)) == want


def test_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    check(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_and_extra_columns(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, " \t"), (5, "A b"), (6, "a B"), (6, "a B"), (7, long), (8, long + " end")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, fp string, node int")
    check(simhash.near_duplicates(df).collect(), docs)
    no_id = spark.createDataFrame([(None, "a b"), (4, "a b"), (None, "zz")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(no_id).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [64, 4096])
def test_links_in_dense_shards(spark, tile):
    """Clusters of close values and far ones: the same components from tiles of any size."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 20, (60, 2))]
    values = sorted(set(values + [int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(v, v) for v in values], "id long, fp0 long")
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(df, 4, tile=tile).collect():
        assert r.a in parent and r.b in parent
        a, b = find(r.a), find(r.b)
        parent[max(a, b)] = min(a, b)
    want = brute_components(values)
    assert [find(v) for v in values] == [values[i] for i in want]


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**16, 3000, dtype=np.uint64))
    tree = simhash.BKTree(values[:, None])
    found = {(int(a), int(b)) for q, v in tree.search(values[:, None], np.arange(len(values)), 2) for a, b in zip(q, v)}
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
    assert found == set(zip(a.tolist(), b.tolist()))


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split() for x in (a, b)))
    return len(a & b) / len(a | b)


def test_representatives_follow_the_similarity_of_shingles(spark):
    """Copies with a few changed words go, texts that share half their shingles stay; one document of each group stays."""
    rng = np.random.default_rng(9)
    docs, near, apart = [], [], []
    for g in range(60):
        words = [f"g{x}" for x in rng.integers(0, 4000, 300)]
        for copy, changes in enumerate((0, 2, 4, 30)):
            said = list(words)
            for at in rng.choice(300, changes, replace=False):
                said[at] = f"n{rng.integers(1e9)}"
            docs.append((10 * g + copy, " ".join(said)))
        (near if jaccard(docs[-3][1], docs[-4][1]) >= 0.9 else []).append(10 * g + 1)
        (near if jaccard(docs[-2][1], docs[-4][1]) >= 0.87 else []).append(10 * g + 2)
        (apart if jaccard(docs[-1][1], docs[-4][1]) <= 0.6 else []).append(10 * g + 3)
    docs += [(None, docs[0][1]), (0, docs[0][1]), (None, "a b"), (None, "c d"), (7, "seven one"), (7, "seven two"), (8, None), (9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in simhash.representatives(df).collect()]
    assert {10 * g for g in range(60)} <= set(got) and got.count(0) == 1 and got.count(None) == 2 and got.count(7) == 2
    assert 8 in got and 9 not in got
    assert len(near) > 80 and sum(x in got for x in near) <= 0.03 * len(near)
    assert len(apart) > 50 and sum(x in got for x in apart) >= 0.97 * len(apart)
    assert simhash.representatives(df.limit(0)).count() == 0
