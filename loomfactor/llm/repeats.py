"""Passages that stand in more than one place: the tables that both substring operators build on.

Each text is cut into segments (see anchors). Segments whose anchor occurs once in the corpus cannot hold a
repeated window and go no further. The others are grouped by anchor and content: a content is one distinct
stretch of symbols with its occurrences, and a class is the contents that share an anchor. Only contents with
company in their class need to be compared symbol by symbol; their symbols are read from one text that holds
them. All steps are equi-joins and partial aggregates on hashes, so a passage that a third of all texts share
is not gathered anywhere; the contents of a class of more than ``tile`` contents are never brought together either:
they are cut into pieces, whose classes are told apart by more symbols around the anchor, until none is crowded.

Texts are told apart by a 64-bit hash, and a repeated row is simply one more place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm import anchors
from loomfactor.llm.common import id_or_last, materialize, small_batches

#: Turns a text into its symbols.
Symbols = Callable[[str], np.ndarray]
#: Parts among which the segments of a known common anchor are dealt.
SALTS = 64


def keyed(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, oid, tk, text) and the columns to keep: a null text is empty; oid orders documents, null ids last; tk names the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(True).alias("kept")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_last().alias("oid"), text.alias("text"), kept).select(
        "doc_id", "oid", F.xxhash64("text").alias("tk"), "text", "kept"
    )


def segment_table(docs: DataFrame, symbols: Symbols, window: int, gram: int, common: np.ndarray | None = None) -> DataFrame:
    """(c, f, tk, oid, start, n, salt): class, content, text, document, first window, windows; salt deals the segments
    of the common anchors, is 0 for all others and NULL if no common anchors are given."""
    names = ["c", "f", "tk", "oid", "start", "n", "salt"]
    shared = docs.sparkSession.sparkContext.broadcast(common) if common is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared is not None else None
        for batch in small_batches(batches, "text", 128):
            found = [anchors.segments(symbols(t), window, gram) for t in batch.column(2).to_pylist()]
            sizes = [len(x[0]) for x in found]
            c, start, n, _, f = (np.concatenate(x) for x in zip(*found))
            oid, tk = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
            cols = [c.view(np.int64), f.view(np.int64), tk, oid, start.astype(np.int32), n.astype(np.int32)]
            if known is None:
                salt = pa.nulls(len(c), pa.int32())
            else:
                dealt = 1 + (tk + start + oid).view(np.uint64) % np.uint64(SALTS)
                salt = pa.array(np.where(np.isin(cols[0], known), dealt, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), salt], names)

    return docs.select("oid", "tk", "text").mapInArrow(run, "c long, f long, tk long, oid long, start int, n int, salt int")


def common_anchors(docs: DataFrame, symbols: Symbols, window: int, gram: int, rows: int = 1000, least: int = 16) -> np.ndarray:
    """The most frequent anchors of about ``rows`` documents, picked by a hash wherever they lie: surely repeated, and few.
    They only decide how segments are dealt to tasks, not what is found."""
    one_in = max(1, docs.count() // rows)
    some = docs.filter(F.pmod(F.xxhash64("oid", "tk"), F.lit(one_in)) == 0).repartition(16)
    counts = segment_table(some, symbols, window, gram).groupBy("c").agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "c").limit(2048)
    return np.sort(np.array([r.c for r in top.collect()], np.int64))


def repeated(segs: DataFrame) -> DataFrame:
    """The segments whose anchor occurs more than once."""
    # Written first, so that both sides of the join are plain shuffles and a hot anchor's rows can be split.
    often = materialize(segs.groupBy("c").agg(F.count("*").alias("times")).filter("times > 1").select("c"))
    return segs.join(often, "c")


def repeated_by_sort(segs: DataFrame) -> DataFrame:
    """As repeated(), in one shuffle and without writing segs: in the order of the anchor, a segment is repeated if
    its neighbour has the same anchor. Segments of a common anchor are known to be repeated; they are dealt by their salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, of which the next batch decides, and whether it is known to be repeated
        known = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            c, common = batch.column(0).to_numpy(), batch.column(6).fill_null(0).to_numpy() > 0
            same = c[1:] == c[:-1]
            hit = common | np.concatenate((same, [False])) | np.concatenate(([held is not None and known], same))
            held, known = batch.slice(batch.num_rows - 1, 1), bool(hit[-1])
            yield batch.filter(pa.array(np.append(hit[:-1], False)))
        if held is not None and known:
            yield held

    return segs.repartition("c", "salt").sortWithinPartitions("c").mapInArrow(run, segs.schema)


def contents(dups: DataFrame) -> DataFrame:
    """(c, f, times, owner): each distinct content, its occurrences, and the first document that holds it."""
    place = F.struct("oid", "tk", "start", "n")
    return dups.groupBy("c", "f").agg(F.count("*").alias("times"), F.min(place).alias("owner"))


def with_symbols(docs: DataFrame, stuff: DataFrame, symbols: Symbols, window: int) -> DataFrame:
    """(c, f, k, oid, n, symbols) of the contents that share their class with k - 1 others; symbols as bytes."""
    # Written first, so that both sides of the join are plain shuffles and a crowded class can be split.
    company = materialize(stuff.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1"))
    wanted = stuff.join(company, "c").select("c", "f", "k", "owner.*")
    item = F.struct("c", "f", "k", "start", "n")
    lists = wanted.groupBy("tk", "oid").agg(F.collect_list(item).alias("items"))
    names = ["c", "f", "k", "oid", "n", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # rows that repeat id and text hold the same contents
        for batch in small_batches(batches, "text", 64):
            fresh = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fresh.append(key not in done)
                done.add(key)
            batch = batch.filter(pa.array(fresh))
            oid = batch.column(0).to_numpy()
            lengths = batch.column(3).value_lengths().to_numpy()
            flat = batch.column(3).flatten()
            c, f, k, start, n = (flat.field(i).to_numpy() for i in range(5))
            out, at = [], 0
            for text, size in zip(batch.column(2).to_pylist(), lengths.tolist()):
                whole = symbols(text)
                ends = start[at : at + size] + n[at : at + size] + window - 1
                out += [whole[s:e].tobytes() for s, e in zip(start[at : at + size].tolist(), ends.tolist())]
                at += size
            cols = [c, f, k, np.repeat(oid, lengths), n]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(out, pa.binary())], names)

    found = docs.join(lists.hint("shuffle_hash"), ["tk", "oid"]).select("oid", "tk", "text", "items")
    return found.mapInArrow(run, "c long, f long, k long, oid long, n int, symbols binary")


def largest_class(stuff: DataFrame) -> int:
    return stuff.groupBy("c").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0


def pieces(rows: DataFrame, decode: Callable[[bytes], np.ndarray], window: int, gram: int, width: int) -> DataFrame:
    """(pc, pf, c, f, oid, start, n, symbols): each content (pc, pf) cut where the place of its anchor in the window passes a
    multiple of ``width``. Equal windows lie in pieces of equal class c: that of the content, the number of the cut and the
    window - width + 1 symbols around the anchor that all windows of such a piece hold."""
    names = ["pc", "pf", "c", "f", "oid", "start", "n", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "symbols", 256):
            if not batch.num_rows:
                continue
            pc, pf, oid, n = (batch.column(i).to_numpy() for i in range(4))
            found, symbols_of = [], []
            for raw, key, count in zip(batch.column(4).to_pylist(), pc.view(np.uint64), n.tolist()):
                symbols = decode(raw)
                size = len(raw) // len(symbols)
                anchor = anchors.segments(symbols[:window], window, gram)[3][0]
                block = (anchor - np.arange(count)) // width
                start = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
                many, block = np.diff(np.append(start, count)), block[start]
                rolling = anchors.Rolling(symbols)
                shared = rolling.hashes(anchor - block * width, window - width + 1)
                c = anchors.mix(shared ^ anchors.mix(key ^ (block * window + width).astype(np.uint64)))
                ends = start + many + window - 1
                found.append((c, rolling.hashes(start, many + window - 1), start, many))
                symbols_of += [raw[s * size : e * size] for s, e in zip(start.tolist(), ends.tolist())]
            row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            c, f, start, many = (np.concatenate(x) for x in zip(*found))
            cols = [pc[row], pf[row], c.view(np.int64), f.view(np.int64), oid[row], start.astype(np.int32), many.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(symbols_of, pa.binary())], names)

    schema = "pc long, pf long, c long, f long, oid long, start int, n int, symbols binary"
    return rows.select("c", "f", "oid", "n", "symbols").mapInArrow(run, schema)


def refined(
    rows: DataFrame, decode: Callable[[bytes], np.ndarray], window: int, gram: int, tile: int
) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Contents (c, f, k, oid, n, symbols) in classes of at most ``tile``, and how their matches lead back to those of rows.

    The contents of larger classes are cut into pieces, which are contents themselves, in classes of more symbols; what is
    still crowded is cut finer. Pieces of one window have no other in their class, so this ends after log2(window) cuts. Only
    pieces with company go on. Each cut is (places, stuff): where a piece (c, f) lies in its content (pc, pf), and each
    distinct piece with its occurrences among the contents and the first document that holds it."""
    usual, cuts, width = rows.filter(F.col("k") <= tile), [], -(-window // 4)
    crowded = rows.filter(F.col("k") > tile)
    while crowded.head(1):
        places = materialize(pieces(crowded, decode, window, gram, width))
        first = F.min(F.struct("oid", "n", "symbols")).alias("owner")
        stuff = materialize(places.groupBy("c", "f").agg(F.count("*").alias("times"), first).select("c", "f", "times", "owner.*"))
        company = materialize(stuff.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1"))
        finer = materialize(stuff.join(company, "c").select("c", "f", "k", "oid", "n", "symbols"))
        usual = usual.unionByName(finer.filter(F.col("k") <= tile))
        crowded = finer.filter(F.col("k") > tile)
        cuts.append((places.drop("symbols"), stuff.drop("symbols")))
        width = max(1, width // 2)
    return usual, cuts


def lifted(runs: DataFrame, cuts: list[tuple[DataFrame, DataFrame]], marked: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Matches (c, f, a, b) of all contents, from the runs that were found in the usual ones: marked(places, stuff, runs)
    gives the places of a cut with the runs s that lie in each."""
    out = runs
    for places, stuff in reversed(cuts):
        at = marked(places, stuff, out)
        ends = [(F.col("start") + F.col(f"s.{x}")).alias(x) for x in ("a", "b")]
        out = runs.unionByName(materialize(at.select(F.col("pc").alias("c"), F.col("pf").alias("f"), *ends)))
    return out


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner row, window number) of every window of contents that hold lengths windows each."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return rows, np.arange(len(rows)) - first


def ranges(rows: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows, from (row, window number) pairs in order: (row, first, last)."""
    if not len(rows):
        return rows, number, number
    cut = np.flatnonzero((rows[1:] != rows[:-1]) | (number[1:] != number[:-1] + 1)) + 1
    start = np.concatenate(([0], cut))
    stop = np.concatenate((cut, [len(rows)])) - 1
    return rows[start], number[start], number[stop]


def cut(docs: DataFrame, spans: DataFrame, keys: list[str], finish: Callable, schema: str) -> DataFrame:
    """One row per row of docs from its text and its spans (first, last window): finish(ids, texts, spans lists, kept columns)."""
    lists = materialize(spans.groupBy(*keys).agg(F.collect_set(F.struct("a", "b")).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 64):
            held = []
            lengths = batch.column(2).value_lengths().fill_null(0).to_pylist()
            flat = batch.column(2).flatten()
            a, b = (flat.field(i).to_numpy() for i in (0, 1))
            at = 0
            for size in lengths:
                held.append((a[at : at + size], b[at : at + size]))
                at += size
            yield finish(batch.column(0), batch.column(1).to_pylist(), held, batch.column(3))

    joined = docs.join(lists.hint("shuffle_hash"), keys, "left").select("doc_id", "text", "spans", "kept")
    return joined.mapInArrow(run, schema)


def removed(size: int, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Which of size symbols are covered by windows a..b (first and last window, both inclusive)."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, a, 1)
    np.add.at(marks, b + window, -1)
    return np.cumsum(marks[:size]) > 0
