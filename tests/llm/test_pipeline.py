import numpy as np

import corpus_pipeline as cp
from loomfactor.llm import decontaminate, simhash, toxicity
from loomfactor.llm.common import Scope, materialize, table
from tests.llm.test_repeats import brute_bytes

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS
        a, b = ({r.doc_id: r for r in x.collect()} for x in (before, docs))
        kept[name] = (a, b)
        assert set(b) <= set(a) and len(b) == docs.count()
    a, b = kept["toxicity"]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert set(b) == {i for i, r in a.items() if model.score(r.text) < 0.5}
    a, b = kept["simhash near-dedup"]
    check_near_copies(a, b)
    a, b = kept["suffix-array dedup"]
    removed = {eval(r[0]): r for r in brute_bytes([(i, r.text) for i, r in a.items()], 200)}
    for i, r in a.items():
        if not removed[i][2]:
            assert b[i] == r
        elif i in b:
            assert len(b[i].text.encode()) <= removed[i][1] - removed[i][2] and b[i].n_chars == len(b[i].text)
    a, b = kept["benchmark decontamination"]
    items = [(r.item_id, decontaminate.canonicalise(r.text)[0]) for r in table(spark, SF, "benchmark").collect()]
    for i in set(a) - set(b):
        tokens = decontaminate.canonicalise(a[i].text)[0]
        grams = {tuple(tokens[j : j + 8]) for j in range(len(tokens))}
        assert any(tuple(t[j : j + 8]) in grams for _, t in items for j in range(max(1, len(t) - 7)))
    a, b = kept["mixing to target weights"]
    assert all(b[i].text == a[i].text and b[i].rate > 0 for i in b)
    m, p = np.array([r.tokens for r in b.values()], float), np.array([r.rate for r in b.values()])
    assert abs((m * p).sum() / sum(len(toxicity.word_hashes(r.text)) for r in a.values()) - 1) < 1e-3


def shingles(text):
    said = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(said[i : i + 5]) for i in range(max(1, len(said) - 4))} if said else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_near_copies(before, after, missed=0.02):
    """Every pair compared: what went is close to what stays, and what stays is not close to what stays."""
    sets = {i: shingles(r.text) for i, r in before.items()}
    assert all(after[i] == before[i] for i in after)
    for i in set(before) - set(after):
        assert any(likeness(sets[i], sets[j]) >= 0.8 for j in after), i
    kept = sorted(after)
    close = sum(likeness(sets[i], sets[j]) >= 0.8 for k, i in enumerate(kept) for j in kept[:k])
    assert close <= max(1, missed * len(before))


def test_texts_alike_by_way_of_others_stay(spark):
    """A chain whose neighbours are close and whose ends have nothing in common, in the order of ids and in another."""
    words = [f"w{i}" for i in range(250)]
    for order in (range(16), np.random.default_rng(0).permutation(16)):
        rows = [(int(i), " ".join(words[6 * k : 6 * k + 100]), "en", "s", 1) for k, i in enumerate(order)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        a, b = ({r.doc_id: r for r in x.collect()} for x in (df, cp.drop_near_copies(spark, df, SF)))
        check_near_copies(a, b)
        assert 6 <= len(b) < 16 and likeness(shingles(rows[0][1]), shingles(rows[1][1])) > 0.8


def test_many_copies_of_one_text(spark, monkeypatch):
    """A group larger than the number of comparisons in a task, with ties, long and empty texts."""
    monkeypatch.setattr(simhash, "FANOUT", 16)
    rng = np.random.default_rng(4)
    base = [f"k{x}" for x in rng.integers(0, 9000, 300)]
    rows = [(i, " ".join([*base[:5], f"v{i}", *base[6:]])) for i in range(120)] + [(i, " ".join(base).upper()) for i in (200, 201)]
    rows += [(300, " ".join(f"k{x}" for x in rng.integers(0, 9000, 60_000))), (301, ""), (302, None), (303, " \n")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    a, b = ({r.doc_id: r for r in x.collect()} for x in (df, cp.drop_near_copies(spark, df, SF)))
    check_near_copies(a, b)
    assert len(b) == 3 and {300, 301} <= set(b)


def test_copies_that_are_far_from_each_other_go_for_their_text(spark):
    """Sixty copies, each close to one text and to none of the others, whatever its id."""
    rng = np.random.default_rng(6)
    base = [f"k{x}" for x in rng.integers(0, 9000, 200)]
    rows = [(700, " ".join(base), "en", "s", 1)]
    for i in range(60):
        said = list(base)
        for at in rng.choice(40, 4, replace=False):
            said[5 * at + 2] = f"v{i}x{at}"
        rows.append((i, " ".join(said), "en", "s", 1))
    sets = [shingles(r[1]) for r in rows]
    assert min(likeness(sets[0], x) for x in sets[1:]) >= 0.8 and np.mean([likeness(x, y) < 0.8 for x in sets[1:20] for y in sets[1:20]]) > 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = ({r.doc_id: r for r in x.collect()} for x in (df, cp.drop_near_copies(spark, df, SF)))
    check_near_copies(a, {k: b[k] for k in a if k in b}, 0.2)
    assert 700 in b and len(b) <= 15  # all are near the threshold, where one in five is not proposed


def test_stages_keep_what_they_should_not_judge(spark, tmp_path):
    """Null and repeated ids, null and empty texts, further columns, empty tables: distinct clean documents stay."""
    rng = np.random.default_rng(2)
    said = [" ".join(f"k{x}" for x in rng.integers(0, 5000, 40)) for _ in range(8)]
    rows = [(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3]), (7, said[3]), (8, said[4]), (9, said[4]), (10, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "z", 0.1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tk string, score double")
    got = [r.text for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(x for x in got if x) == sorted(said[:5]) and len(got) == 6
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == cp.COLUMNS
        texts = {r.text for r in out.collect()}
        assert set(said[:3]) <= texts, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_a_stage_leaves_the_tables_of_others_alone(spark):
    docs = table(spark, SF, "documents")
    mine = materialize(docs.select("doc_id"))
    found = simhash.near_duplicates(docs)
    cp.drop_near_copies(spark, docs, SF)
    cp.drop_near_copies(spark, docs, SF)
    assert mine.count() == docs.count() == found.count()
    with Scope(spark) as own:
        held = materialize(docs.select("doc_id"))
    own.release()
    try:
        held.count()
        raise AssertionError("the table should be gone")
    except Exception as e:
        assert "should be gone" not in str(e)
