from collections import Counter
from itertools import groupby

from loomfactor.llm import decontaminate as d
from loomfactor.llm.common import table


def item_parts(question, window, plain):
    """(at, size, whether the values count) of the windows that are searched."""
    want, slots = d.canonicalise(question)
    size = min(window, len(want))
    every = range(len(want) - size + 1) if size else []
    special = {a for a in every if slots[a : a + size].count("") >= min(plain, size)}
    return want, slots, [(a, size, a not in special) for a in every if a in special or 2 * len(special) < len(every)]


def brute(docs, items, window=8, plain=4, share=0.5, verbatim=25):
    """Every item at every place of every document, token by token."""
    out = set()
    parts = [(item, *item_parts(question, window, plain)) for item, question in items]
    for doc, text in docs:
        tokens, values = d.canonicalise(text)
        held = set(tokens)
        for item, want, slots, good in parts:
            if not good or not held & set(want):
                continue
            hits = []
            for a, size, exact in good:
                if sum(len(v.split()) or 1 for v in slots) < 5 and len(tokens) != size:
                    continue
                for p in range(len(tokens) - size + 1):
                    if tokens[p] == want[a] and tokens[p : p + size] == want[a : a + size] and (not exact or values[p : p + size] == slots[a : a + size]):
                        hits.append((p - a, a, slots[a : a + size], values[p : p + size]))
            best = 0
            for shift in (0, d.DRIFT):
                near = {}
                for h in hits:
                    near.setdefault((h[0] + shift) // (2 * d.DRIFT), []).append(h)
                for group in near.values():
                    honest = lambda h: all(v == f for v, f in zip(h[2], h[3]) if v)
                    most = {}
                    for start in sorted({h[0] for h in group}, key=lambda s: (-sum(h[0] == s for h in group), -sum(h[0] == s and honest(h) for h in group), s)):
                        votes = Counter((v, f) for h in group if h[0] == start for v, f in zip(h[2], h[3]) if v)
                        for v in {v for v, _ in votes} - set(most):
                            most[v] = max((n, f) for (x, f), n in votes.items() if x == v)[1]
                    fits = [h for h in group if all(most[v] == f for v, f in zip(h[2], h[3]) if v)]
                    matched = len({a for _, a, _, _ in fits})
                    same = sorted((h[0], h[1]) for h in group if honest(h))
                    longest = max((len(list(g)) + good[0][1] - 1 for _, g in groupby(enumerate(same), lambda x: (x[1][0], x[1][1] - x[0]))), default=0)
                    if matched / len(good) >= share or longest >= verbatim:
                        best = max(best, matched)
            if best:
                out.add((doc, item, best))
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.matched) for r in df.collect()}


ITEMS = [
    (1, "If Alice walks 3 km in 2 hours and then rests, how far will Alice walk in 10 hours on the same road?"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank"),
    (3, "one two three four five six seven eight nine ten"),
    (4, "short question here"),
    (5, None),
]


def test_reparameterised_questions(spark):
    docs = [
        (1, "Intro words. If Bob walks 7 km in 5 hours and then rests, how far will Bob walk in 20 hours on the same road? End"),
        (2, "If Bob walks 7 km in 5 hours and then rests, how far will Carol walk in 20 hours on the same road?"),
        (3, "nothing of the kind " * 20000),
        (4, "He said the quick brown fox jumps over the lazy dog near the old river bank twice"),
        (5, "the quick brown fox jumps over a cat"),
        (6, "eleven 12 13 14 15 16 17 18 19 20"),
        (7, "a short question here now"),
        (8, None),
        (9, ""),
        (4, "He said the quick brown fox jumps over the lazy dog near the old river bank twice"),
        (None, ITEMS[1][1]),
    ]
    df = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, item_id int, h string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1_000_000, 7):
        got = d.contaminated(df, items, block=block)
        assert found(got) == brute(docs, ITEMS)
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert not rows[1, 1].exact and rows[4, 2].exact and (None, 2) in rows and len(rows) == len(got.collect())
    assert (5, 2) not in rows and (6, 3) not in rows
    assert (7, 4) not in rows  # three words inside a text say nothing
    assert d.contaminated(df.limit(0), items).count() == 0 == d.contaminated(df, items.limit(0)).count()


def test_documents_match_brute_force(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    small = items.limit(12)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(d.contaminated(docs, small)) == brute(plain, [(r.item_id, r.text) for r in small.collect()])


LISTS = [
    (1, "Alice Smith, Bob Jones, Carol White, Dave Brown, Erin Black"),
    (2, "What is 12 + 7 * 3 - 4 / 2?"),
    (3, "Capital Of France: Paris. Capital Of Spain: Madrid."),
    (None, "the slow green turtle walks under the busy bridge near an old mill pond today"),
    (5, "Mr. Lee pays 5 dollars for 3 pounds of rice and 2 pounds of beans; how much does Mr. Lee pay for 8 pounds of rice alone?"),
    (6, " ".join(f"long{i}" for i in range(60))),
]


def test_items_of_names_and_numbers_and_parts_of_items(spark):
    docs = [(10 + i, f"before it {t} and after") for i, t in LISTS if i] + [
        (20, "Someone: Alice Smith, Bob Jones, Carol White, Dave Brown, Erin Green"),
        (21, "What is 13 + 8 * 4 - 5 / 3?"),
        (22, "Mrs. Van Der Berg pays 40 dollars for 3 pounds of rice and 20 pounds of beans; how much does Mrs. Van Der Berg pay for 80 pounds of rice alone?"),
        (23, "Mr. Lee pays 5 dollars for 5 pounds of rice and 5 pounds of beans; how much does Mr. Lee really pay for 8 pounds of rice alone?"),
        (24, "see " + " ".join(f"long{i}" for i in range(20, 46)) + " here"),
        (25, "see " + " ".join(f"long{i}" for i in range(20, 31)) + " here"),
        (26, LISTS[3][1]),
        (27, "Kim pays for rice and beans"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(LISTS, "item_id long, text string")
    got = found(d.contaminated(df, items))
    assert got == brute(docs, LISTS)
    pairs = {(a, b) for a, b, _ in got}
    assert {(11, 1), (12, 2), (13, 3), (15, 5), (16, 6), (22, 5), (23, 5), (24, 6), (26, None)} <= pairs
    assert not pairs & {(21, 2), (25, 6), (27, 5)}


def test_one_odd_slot_does_not_reject_an_alignment():
    row = lambda at, values, found: {"start": 0, "at": at, "values": values, "found": found}
    windows = [row(0, ["a", ""], ["x", ""]), row(1, ["", "a"], ["", "x"]), row(2, ["a", ""], ["y", ""]), row(3, ["b", ""], ["x", ""])]
    assert d.judge(windows) == (3, 0, False)
    assert d.judge([row(0, ["a", ""], ["a", ""]), row(1, ["", ""], ["", ""])]) == (2, 3, True)
    assert d.canonicalise("New York has twenty five parks, Ann")[1] == ["new york", "", "twenty five", "", "ann"]


def test_items_of_few_words_match_whole_texts_only(spark):
    items = [(1, "yes"), (2, "Paris"), (3, "how far is it"), (4, "how far is it now")]
    docs = [(1, "oh yes it is"), (2, "We went to Paris"), (3, "Yes"), (4, "yes"), (5, " yes. "), (6, "tell me how far is it now"), (7, "How far is it?"), (8, "how far is it?"), (9, "Paris"), (10, "London")]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(4, 1), (5, 1), (6, 4), (8, 3), (9, 2)}
