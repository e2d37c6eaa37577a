"""Substring dedup by words: a window of 13 words that also starts in an earlier document is removed.

References are sharded by anchor class (see repeats): all windows that could be equal meet in one shard. For each
shard a suffix automaton of the contents of earlier documents is built in the order of documents, and each next
document's contents are streamed through it for matching statistics: the length of the longest suffix, at each
word, that the automaton knows. Where it reaches the window length, a window has been seen before. Automata go to
the tasks by shuffle: those of a whole corpus have no size bound, so they are not broadcast. A class of more than
``tile`` contents would make one automaton too large: its contents are cut into pieces, in classes told apart by more
words around the anchor, and the pieces go through automata like all others.

Defined results: a null text has no words; repeated rows have the same id, so neither is earlier than the other;
rows with a null id come after all others; a text shorter than the window keeps everything; an empty table
returns no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm import anchors, repeats
from loomfactor.llm.common import discard, materialize

GRAM = 4
#: Contents that one shard's automaton holds, about.
GROUP = 8000


def words(text: str) -> list[bytes]:
    """bytes.split cuts at ASCII white space only."""
    return text.encode().split()


def word_symbols(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    found = words(text)
    return np.fromiter((digest(w) for w in found), dtype=np.uint64, count=len(found))


class SuffixAutomaton:
    """All factors of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """The state of the longest factor of p followed by x, cut off from q where q is longer."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for x in sequence:
            if (q := self.next[last].get(x)) is not None:
                last = self._split(last, q, x)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][x], x)
            last = new

    def matching(self, sequence: list[int]) -> list[int]:
        """Matching statistics: at each place the length of the longest known factor that ends there."""
        state, size, out = 0, 0, []
        nexts, link, length = self.next, self.link, self.length
        for x in sequence:
            to = nexts[state].get(x)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts[state].get(x)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def _shard(window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        c, f, oid, n = (table[x].combine_chunks().to_numpy() for x in ("c", "f", "oid", "n"))
        _, keep = np.unique(np.stack([c, f], axis=1), axis=0, return_index=True)
        keep = keep[np.argsort(oid[keep], kind="stable")]
        symbols = table["symbols"].combine_chunks().take(pa.array(keep)).to_pylist()
        automaton, waiting, before, rows, number = SuffixAutomaton(), [], None, [], []
        for r, (at, raw) in enumerate(zip(oid[keep].tolist(), symbols)):
            if at != before:  # a document's own contents come into the automaton after it has been streamed
                for sequence in waiting:
                    automaton.add(sequence)
                waiting, before = [], at
            sequence = np.frombuffer(raw, dtype=np.uint64).tolist()
            for end, size in enumerate(automaton.matching(sequence)):
                if size >= window:
                    rows.append(r)
                    number.append(end - window + 1)
            waiting.append(sequence)
        r, a, b = repeats.ranges(np.array(rows, np.int64), np.array(number, np.int64))
        return pa.table({"c": c[keep][r], "f": f[keep][r], "a": a.astype(np.int32), "b": b.astype(np.int32)})

    return run


def matches(docs: DataFrame, window: int, tile: int) -> DataFrame:
    """(tk, oid, a, b): runs of windows of each document that start in an earlier one."""
    common = repeats.common_anchors(docs, word_symbols, window, GRAM)
    dups = materialize(repeats.repeated_by_sort(repeats.segment_table(docs, word_symbols, window, GRAM, common)))
    stuff = materialize(repeats.contents(dups))
    rows, cuts, held = repeats.with_symbols(docs, stuff, word_symbols, window), [], stuff.count()
    if repeats.largest_class(stuff) > tile:
        rows, cuts = repeats.refined(materialize(rows), lambda raw: np.frombuffer(raw, np.uint64), window, GRAM, tile)
        held = rows.count()
    rows = rows.withColumn("g", F.pmod("c", F.lit(max(8, held // GROUP))))
    runs = materialize(rows.groupBy("g").applyInArrow(_shard(window), "c long, f long, a int, b int"))
    runs = repeats.lifted(runs, cuts, marked)
    spans = marked(dups, stuff.select("c", "f", "times", "owner.oid"), runs)
    discard(stuff)
    return spans.select("tk", "oid", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))


def marked(places: DataFrame, stuff: DataFrame, runs: DataFrame) -> DataFrame:
    """Places with the runs s of windows that an earlier document holds. A content lies whole in the first document that
    holds it, so all of it was seen by a later one; the first one's own is as the automaton says."""
    own = runs.groupBy("c", "f").agg(F.collect_list(F.struct("a", "b")).alias("own"))
    marks = stuff.select("c", "f", "times", F.col("oid").alias("first")).join(own, ["c", "f"], "left")
    marks = materialize(marks.filter("times > 1 or own is not null").drop("times"))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    seen = F.explode(F.when(F.col("oid") > F.col("first"), whole).otherwise(F.col("own"))).alias("s")
    return places.join(marks, ["c", "f"]).select(*[places[x] for x in places.columns], seen)


def remove_repeats(docs: DataFrame, window: int = 13, tile: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 of the words kept, joined by spaces."""
    docs = repeats.keyed(docs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def finish(ids: pa.Array, texts: list[str], spans: list, _) -> pa.RecordBatch:
        out = []
        for text, (a, b) in zip(texts, spans):
            every = words(text)
            gone = repeats.removed(len(every), a, b, window)
            kept = b" ".join(w for w, g in zip(every, gone.tolist()) if not g)
            out.append((len(every), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(x) for x in zip(*out)]], [x.split()[0] for x in schema.split(", ")])

    return repeats.cut(docs, matches(docs, window, tile), ["tk", "oid"], finish, schema)
