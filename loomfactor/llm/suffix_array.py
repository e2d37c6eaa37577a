"""Suffix-array dedup: every byte inside a 200-byte string that also starts anywhere else is removed.

The index is a logarithmic family of suffix arrays. Contents that may hold a repeat (see repeats) come in batches. A
batch gets its suffix arrays, one for each group of anchor classes: the suffixes that start at its windows, in the
byte order of their first ``window`` bytes, with the length of the prefix that each shares with the one before (LCP).
Suffixes that share ``window`` bytes stand side by side. A new batch is merge-scanned against the levels: where a
level is of its own size, both sorted arrays are merged, equal neighbours from both sides are matches, and the merged
array is the new level, which goes on to the next; against larger levels its suffixes are looked up in their order.
Each content is so sorted once and merged a logarithmic number of times. Levels are written tables, one row a group.

Groups hold about ``GROUP`` windows. A class of more than ``tile`` contents would outgrow its group: its contents are cut
into pieces, in classes told apart by more symbols around the anchor, and the pieces are indexed like all others.

Defined results: a null text is empty; a text shorter than the window keeps everything; repeated rows and
copies are other places, so they lose all they share; a null doc_id keeps its row; an empty table returns no
rows; columns other than doc_id and text are not read, but for those named by keep, which may have any name.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm import anchors, repeats
from loomfactor.llm.common import discard, materialize

GRAM = 64
#: Windows that one group of classes holds, about.
GROUP = 150_000


def byte_symbols(text: str) -> np.ndarray:
    return anchors.BYTE_SYMBOLS[raw_bytes(text)]


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


class SuffixArray:
    """The suffixes that start at the windows of some contents, in byte order of their first ``window`` bytes.

    c, f name the contents, n counts their windows, raw holds their bytes one after the other, order the places in raw
    where the suffixes start, lcp the length, up to window, that each shares with the one before it."""

    def __init__(self, c: np.ndarray, f: np.ndarray, n: np.ndarray, raw: np.ndarray, window: int, order: np.ndarray | None = None, lcp: np.ndarray | None = None):
        self.c, self.f, self.n, self.raw, self.window = c, f, n.astype(np.int64), raw, window
        sizes = self.n + window - 1
        self.first = np.cumsum(sizes) - sizes
        if order is None:
            row, number = repeats.spread(self.n)
            places = self.first[row] + number
            order = places[np.argsort(self.strings(places), kind="stable")]
        self.order = order
        self.lcp = self._lcp() if lcp is None else lcp

    def strings(self, places: np.ndarray) -> np.ndarray:
        """The bytes from each place, as values that sort in byte order."""
        if not len(places):
            return np.zeros(0, f"S{self.window}")
        return np.lib.stride_tricks.sliding_window_view(self.raw, self.window)[places].view(f"S{self.window}").ravel()

    def _lcp(self) -> np.ndarray:
        out = np.zeros(len(self.order), np.uint16)
        for at in range(1, len(self.order), 16384):
            part = self.order[at - 1 : at + 16384]
            rows = self.strings(part).view(np.uint8).reshape(len(part), self.window)
            differ = rows[1:] != rows[:-1]
            out[at : at + len(part) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.window)
        return out

    def runs(self) -> np.ndarray:
        """The number of each suffix's run: neighbours that share window bytes are in one."""
        return np.cumsum(self.lcp < self.window) - 1

    def merge(self, other: "SuffixArray") -> tuple["SuffixArray", np.ndarray]:
        """The array of both, and which of its suffixes stand in a run with one of the other side."""
        both = np.concatenate((self.strings(self.order), other.strings(other.order)))
        order = np.argsort(both, kind="stable")  # two ascending runs: a linear merge
        joined = SuffixArray(
            *(np.concatenate((getattr(self, x), getattr(other, x))) for x in ("c", "f", "n", "raw")),
            self.window,
            np.concatenate((self.order, other.order + len(self.raw)))[order],
        )
        run, mine = joined.runs(), order < len(self.order)
        size, own = np.bincount(run), np.bincount(run, mine)
        return joined, ((own > 0) & (own < size))[run] if len(run) else mine

    def lookup(self, batch: "SuffixArray") -> tuple[np.ndarray, np.ndarray]:
        """Which suffixes here start as one of batch does, and which of batch as one here."""
        mine, theirs = self.strings(self.order), batch.strings(batch.order)
        at = np.minimum(np.searchsorted(mine, theirs), max(len(mine) - 1, 0))
        hit = mine[at] == theirs if len(mine) else np.zeros(len(theirs), bool)
        run = self.runs()
        met = np.zeros(len(mine) + 1, bool)
        met[run[at[hit]]] = True
        return met[run], hit

    def ranges(self, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(c, f, a, b): the suffixes marked by hit, as runs of consecutive windows of their contents."""
        place = np.sort(self.order[hit])
        row = np.searchsorted(self.first, place, side="right") - 1
        r, a, b = repeats.ranges(row, place - self.first[row])
        return self.c[r], self.f[r], a.astype(np.int32), b.astype(np.int32)


LEVEL = "c binary, f binary, n binary, raw binary, sorted binary, lcp binary"
FOUND = "hc array<long>, hf array<long>, ha array<int>, hb array<int>"


def _rows(g: int, level: SuffixArray | None, found: list[tuple[np.ndarray, ...]]) -> pa.Table:
    """One row: a group's level, if it is kept, and the matches of the step that made it."""
    columns = [None] * 6 if level is None else [level.c, level.f, level.n.astype(np.int32), level.raw, level.order.astype(np.int32), level.lcp]
    cells = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in columns]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    hits = [pa.array([np.concatenate(x) if x else []], pa.list_(k)) for x, k in zip(zip(*found) if found else [()] * 4, kinds)]
    return pa.table([pa.array([g], pa.int64()), *cells, *hits], ["g", "c", "f", "n", "raw", "sorted", "lcp", "hc", "hf", "ha", "hb"])


def _read(table: pa.Table, window: int) -> SuffixArray:
    c, f, n, raw, order, lcp = (table[x][0].as_py() for x in ("c", "f", "n", "raw", "sorted", "lcp"))
    ints = (np.frombuffer(x, k) for x, k in ((c, np.int64), (f, np.int64), (n, np.int32), (raw, np.uint8)))
    return SuffixArray(*ints, window, np.frombuffer(order, np.int32).astype(np.int64), np.frombuffer(lcp, np.uint16))


class IndexFamily:
    """Levels of suffix arrays, the smallest last; each is at least twice the one after it."""

    def __init__(self, window: int):
        self.window = window
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, contents: DataFrame, last: bool = False) -> DataFrame:
        """Index a batch of contents (g, c, f, n, symbols): its matches among itself and with all levels as (c, f, a,
        b). The last batch becomes no level."""
        window = self.window

        def build(key: tuple, table: pa.Table) -> pa.Table:
            c, f, n = (table[x].combine_chunks().to_numpy() for x in ("c", "f", "n"))
            _, keep = np.unique(np.stack([c, f], axis=1), axis=0, return_index=True)
            raw = b"".join(table["symbols"].combine_chunks().take(pa.array(keep)).to_pylist())
            array = SuffixArray(c[keep], f[keep], n[keep], np.frombuffer(raw, np.uint8), window)
            run = array.runs()
            return _rows(key[0].as_py(), array, [array.ranges((np.bincount(run) > 1)[run])])

        def merge(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
            if not old.num_rows or not new.num_rows:
                return _rows(key[0].as_py(), _read(new if new.num_rows else old, window), [])
            array, hit = _read(old, window).merge(_read(new, window))
            return _rows(key[0].as_py(), array, [array.ranges(hit)])

        def scan(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
            if not old.num_rows or not new.num_rows:
                return _rows(key[0].as_py(), None, [])
            level, batch = _read(old, window), _read(new, window)
            mine, theirs = level.lookup(batch)
            return _rows(key[0].as_py(), None, [level.ranges(mine), batch.ranges(theirs)])

        schema = f"g long, {LEVEL}, {FOUND}"
        made = materialize(contents.groupBy("g").applyInArrow(build, schema))
        found, spent, size = [made], [], 1
        batch = made
        for k in range(len(self.levels) - 1, -1, -1):
            its_size, level = self.levels[k]
            pair = self._arrays(level).groupBy("g").cogroup(self._arrays(batch).groupBy("g"))
            if its_size == size and not last:
                batch = materialize(pair.applyInArrow(merge, schema))
                found.append(batch)
                spent += [level, found[-2]]
                size *= 2
                self.levels.pop()
            else:
                found.append(materialize(pair.applyInArrow(scan, schema)))
        if not last:
            self.levels.append((size, batch))
        runs = [self._runs(t) for t in found]
        out = materialize(reduce(DataFrame.unionByName, runs))
        kept = [t for _, t in self.levels]
        for t in found + spent:
            if not any(t is x for x in kept):
                kept.append(t)
                discard(t)
        return out

    @staticmethod
    def _arrays(level: DataFrame) -> DataFrame:
        return level.select("g", "c", "f", "n", "raw", "sorted", "lcp")

    @staticmethod
    def _runs(table: DataFrame) -> DataFrame:
        hits = F.arrays_zip(F.col("hc").alias("c"), F.col("hf").alias("f"), F.col("ha").alias("a"), F.col("hb").alias("b"))
        return table.select(F.explode(hits).alias("x")).select("x.*")


def batch_count(windows: int) -> int:
    """Batches in which a table of so many windows arrives: more of them as it grows, but few."""
    return 2 + (windows >> 24).bit_length()


def matches(docs: DataFrame, window: int, batches: int | None, tile: int) -> DataFrame:
    """(tk, a, b): the first and last windows of every run of repeated windows in each text."""
    segs = materialize(repeats.segment_table(docs, byte_symbols, window, GRAM))
    dups = materialize(repeats.repeated(segs))
    discard(segs)
    stuff = materialize(repeats.contents(dups))
    arriving = materialize(repeats.with_symbols(docs, stuff, raw_bytes, window))
    usual, cuts = repeats.refined(arriving, lambda raw: anchors.BYTE_SYMBOLS[np.frombuffer(raw, np.uint8)], window, GRAM, tile)
    windows = usual.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    batches = batches or batch_count(windows)
    usual = usual.withColumn("g", F.pmod("c", F.lit(max(8, windows // GROUP)))).drop("k", "oid")
    family, found = IndexFamily(window), []
    for b in range(batches):
        found.append(family.add(usual.filter(F.pmod(F.xxhash64("f"), F.lit(batches)) == b), last=b + 1 == batches))
    runs = repeats.lifted(reduce(DataFrame.unionByName, found), cuts, marked)
    return marked(dups, stuff.select("c", "f", "times", "owner.n"), runs).select(
        "tk", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")
    )


def marked(places: DataFrame, stuff: DataFrame, runs: DataFrame) -> DataFrame:
    """Places with the runs s of repeated windows in their content: all of it where it occurs more than once."""
    whole = stuff.filter("times > 1").select("c", "f", F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    return places.join(runs.unionByName(whole).select("c", "f", F.struct("a", "b").alias("s")), ["c", "f"])


def remove_repeats(
    docs: DataFrame, window: int = 200, batches: int | None = None, tile: int = 2000, keep_text: bool = False, keep: list[str] = ()
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept, the text
    that stays without characters of which a byte was removed; and the columns of docs named by keep."""
    types = dict(docs.dtypes)
    docs = repeats.keyed(docs, keep)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    names = [x.split()[0] for x in schema.split(", ")] + ["extra"] * bool(keep)

    def finish(ids: pa.Array, texts: list[str], spans: list, extra: pa.Array) -> pa.RecordBatch:
        out = []
        for text, (a, b) in zip(texts, spans):
            raw = raw_bytes(text)
            gone = repeats.removed(len(raw), a, b, window)
            left = raw[~gone].tobytes()
            edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            row = [len(raw), int(gone.sum()), edges, hashlib.sha256(left).hexdigest()]
            if keep_text:
                char = np.cumsum((raw & 0xC0) != 0x80) - 1
                broken = np.zeros(char[-1] + 1 if len(raw) else 0, bool)
                broken[char[gone]] = True
                row.append(raw[~broken[char]].tobytes().decode() if len(raw) else "")
            out.append(row)
        cols = [ids, *[pa.array(x) for x in zip(*out)], *([extra] if keep else [])]
        return pa.RecordBatch.from_arrays(cols, names)

    if keep:
        schema += ", extra struct<" + ",".join(f"`{c}`:{types[c]}" for c in keep) + ">"
    out = repeats.cut(docs, matches(docs, window, batches, tile), ["tk"], finish, schema)
    return out.select(*[n for n in names if n != "extra"], *[f"extra.{c}" for c in keep])
