"""Benchmark decontamination by templates: re-parameterised questions are caught along with verbatim ones.

Text is canonicalised to a template: numbers (digits or number words), units after a number and capitalised
words become typed placeholders, a run of one type that only spaces part is one slot ("New York", "twenty five"); all
else is lower-cased. Windows of ``window`` template tokens (a whole item, if it is shorter) are hash-joined with those
of the benchmark. An item of fewer than LEAST words ("yes", "Paris", "thank you very much") says too little to be found
inside a text: it matches only a text of exactly its tokens. A window of fewer than ``plain`` ordinary words says too little as a template: it is searched with
the values in its slots, and only in items of which most windows are of this kind. Matches that agree, up to a few
words put in or left out, on where the item would begin are taken together; their slots must be consistent, one document
value for each item value: where an item value meets several, windows that hold another than the most frequent do not
count. A document is contaminated by an item of which at least ``share`` of the windows match so, or of which
``verbatim`` tokens in a row stand in it unchanged.

The benchmark's window hashes are broadcast in blocks of at most ``block`` hashes, one pass over the documents
for each block, to pick the windows that go to the join.

Defined results: null or empty texts match nothing; rows that repeat both id and text give one row; null ids of documents
and items give rows with a null id; items that share an id are one item, judged by its best text; an empty
table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm import anchors
from loomfactor.llm.common import materialize, small_batches

_TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[%$€£°]")
#: Fixed values.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh".split()
)
NUMBER, UNIT, NAME = "\0n", "\0u", "\0p"


#: Alignments whose starts differ by up to this many tokens are taken together.
DRIFT = 16


def canonicalise(text: str | None) -> tuple[list[str], list[str]]:
    """(template tokens, the value in each slot or '')."""
    tokens, values, end = [], [], -1
    said = text or ""
    for m in _TOKEN.finditer(said):
        raw = m[0]
        low = raw.lower()
        if raw[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS and tokens and tokens[-1] == NUMBER:
            kind = UNIT
        elif raw[0].isupper():
            kind = NAME
        else:
            tokens.append(low)
            values.append("")
            continue
        if tokens and tokens[-1] == kind != UNIT and said[end : m.start()].isspace():
            values[-1] += " " + low
        else:
            tokens.append(kind)
            values.append(low)
        end = m.end()
    return tokens, values


#: Words an item must have to be looked for inside longer texts.
LEAST = 5


class Windows:
    """Hashes of a text's windows: of the template alone, and with the values in its slots."""

    def __init__(self, tokens: list[str], values: list[str]):
        self.tokens, self.values, self.size = tokens, values, len(tokens)
        self._template = self._verbatim = None

    @staticmethod
    def _rolling(symbols: list[str]) -> anchors.Rolling:
        digest = xxhash.xxh64_intdigest
        return anchors.Rolling(np.fromiter((digest(t) for t in symbols), dtype=np.uint64, count=len(symbols)))

    def hashes(self, length: int, verbatim: bool) -> np.ndarray:
        if self.size < length or not length:
            return np.zeros(0, np.int64)
        if verbatim:
            self._verbatim = self._verbatim or self._rolling([f"\1{v}" if v else t for t, v in zip(self.tokens, self.values)])
        else:
            self._template = self._template or self._rolling(self.tokens)
        rolling = self._verbatim if verbatim else self._template
        return rolling.hashes(np.arange(self.size - length + 1), length).view(np.int64)


def item_windows(benchmark: DataFrame, window: int, plain: int) -> DataFrame:
    """(item_id, ik, n_windows, h, length, whole, at, values): the windows that are searched for each item; ik tells texts
    apart, length is negative for windows searched with their values, whole asks for a text of no more tokens."""
    names = ["item_id", "ik", "n_windows", "h", "length", "whole", "at", "values"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.string())]

    def of_item(text: str | None) -> list[tuple]:
        tokens, values = canonicalise(text)
        size, found = min(window, len(tokens)), Windows(tokens, values)
        whole = sum(len(v.split()) if v else 1 for v in values) < LEAST
        count = len(tokens) - size + 1 if size else 0
        special = [values[at : at + size].count("") >= min(plain, size) for at in range(count)]
        few = 2 * sum(special) < count
        chosen = [at for at in range(count) if special[at] or few]
        by = {v: found.hashes(size, v).tolist() for v in (False, True)} if count else {}
        return [(len(chosen), by[not special[at]][at], size if special[at] else -size, whole, at, values[at : at + size]) for at in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = [(i, k, *r) for i, k, text in zip(*(c.to_pylist() for c in batch.columns)) for r in of_item(text)]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(cols, names)

    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.xxhash64(text).alias("ik"), text.alias("text"))
    return items.mapInArrow(run, "item_id long, ik long, n_windows int, h long, length int, whole boolean, at int, values array<string>")


def _matches(docs: DataFrame, wanted: dict[tuple[int, bool], np.ndarray]) -> DataFrame:
    """(doc_id, tk, h, length, whole, pos, found): document windows whose hash is among those wanted for their length, in
    any text or as a whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["doc_id", "tk", "h", "length", "whole", "pos", "found"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for doc, tk, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, values = canonicalise(text)
                windows = Windows(tokens, values)
                for (length, whole), known in shared.value.items():
                    if whole and windows.size != abs(length):
                        continue
                    h = windows.hashes(abs(length), length < 0)
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    for p in np.flatnonzero(known[at] == h).tolist():
                        rows.append((doc, tk, int(h[p]), length, whole, p, values[p : p + abs(length)]))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, "doc_id long, tk long, h long, length int, whole boolean, pos int, found array<string>")


def judge(windows: list[dict]) -> tuple[int, int, bool]:
    """(windows that match, tokens in a row that stand unchanged, whether all slots hold the item's own values) of the
    windows (start, at, values, found) of one item near one place."""
    by_start: dict[int, list[tuple[int, list[tuple[str, str]], int]]] = {}
    same = set()
    for w in windows:
        pairs = [(v, f) for v, f in zip(w["values"], w["found"]) if v]
        by_start.setdefault(w["start"], []).append((w["at"], pairs, len(w["values"])))
        if all(v == f for v, f in pairs):
            same.add((w["start"], w["at"], len(w["values"])))
    # The alignment of most windows says what the item's values have become, then the next.
    unchanged = Counter(start for start, _, _ in same)
    said: dict[str, str] = {}
    for start in sorted(by_start, key=lambda s: (-len(by_start[s]), -unchanged[s], s)):
        votes = Counter(pair for _, pairs, _ in by_start[start] for pair in pairs)
        here: dict[str, tuple[int, str]] = {}
        for (v, f), n in votes.items():
            here[v] = max(here.get(v, (0, "")), (n, f))
        said = {v: f for v, (_, f) in here.items()} | said
    fits = lambda pairs: all(said[v] == f for v, f in pairs)
    kept = {at for found in by_start.values() for at, pairs, _ in found if fits(pairs)}
    own = {at for start, found in by_start.items() for at, _, size in found if (start, at, size) in same}
    longest = run = 0
    for start, at, size in sorted(same):
        run = run + 1 if (start, at - 1, size) in same else size
        longest = max(longest, run)
    return len(kept), longest, own >= kept


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "windows"):
        *keys, windows = batch.columns
        matched, unchanged, exact = zip(*map(judge, windows.to_pylist())) if batch.num_rows else ((), (), ())
        cols = [pa.array(matched, pa.int32()), pa.array(unchanged, pa.int32()), pa.array(exact, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*keys, *cols], ["doc_id", "tk", "item_id", "n_windows", "matched", "unchanged", "exact"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, plain: int = 4, share: float = 0.5, verbatim: int = 25, block: int = 1_000_000
) -> DataFrame:
    """(doc_id, tk, item_id, matched, n_windows, share, exact): each document and item it gives away, at its best place;
    tk is the xxhash64 of the text, exact says that all slots there hold the item's own values."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    items = materialize(item_windows(benchmark, window, plain).distinct())
    hashes = items.select("length", "whole", "h").distinct()
    parts = max(1, -(-hashes.count() // block))
    hits = None
    for k in range(parts):
        # At most about ``block`` hashes at a time are brought here and broadcast.
        rows = hashes.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == k).toArrow()
        length, whole, h = (c.to_numpy(zero_copy_only=False) for c in rows.columns)
        kinds = sorted(set(zip(length.tolist(), whole.tolist())))
        found = _matches(docs, {(n, w): np.sort(h[(length == n) & (whole == w)]) for n, w in kinds})
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.dropDuplicates(["doc_id", "tk", "length", "whole", "pos"])
    met = hits.join(items, ["h", "length", "whole"]).withColumn("start", F.col("pos") - F.col("at"))
    # Starts up to DRIFT apart share one of two overlapping stretches; a group holds few windows of one item.
    near = F.array(F.floor(F.col("start") / (2 * DRIFT)) * 2, F.floor((F.col("start") + DRIFT) / (2 * DRIFT)) * 2 + 1)
    place = ["doc_id", "tk", "item_id", "ik", "n_windows", "near"]
    groups = met.withColumn("near", F.explode(near)).groupBy(*place)
    judged = (
        groups.agg(F.collect_list(F.struct("start", "at", "values", "found")).alias("windows"))
        .select("doc_id", "tk", "item_id", "n_windows", "windows")
        .mapInArrow(_judged, "doc_id long, tk long, item_id long, n_windows int, matched int, unchanged int, exact boolean")
    )
    part = F.col("matched") / F.col("n_windows")
    leaks = judged.filter((part >= share) | (F.col("unchanged") >= verbatim))
    best = leaks.groupBy("doc_id", "tk", "item_id").agg(F.max(F.struct(part.alias("share"), "matched", "exact", "n_windows")).alias("m"))
    return best.select("doc_id", "tk", "item_id", F.col("m.matched").cast("long").alias("matched"), "m.n_windows", "m.share", "m.exact")
