"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees over shards of a pigeonhole index.

Two fingerprints that differ in at most ``radius`` bits agree on all but ``radius`` of any ``blocks`` bit
blocks. Every choice of ``blocks - radius`` blocks is one replica of the index, and the bits of those blocks
are the shard key, so each pair within the radius meets in at least one shard. Each shard gets a BK-tree:
children are keyed by integer Hamming distance to their parent, and a search follows only edges within the
radius. Trees are built in the task that holds the shard (shipped by shuffle: a broadcast of all
fingerprints would have no size bound). A shard of more than ``tile`` fingerprints is cut into tiles, and
each pair of tiles is one tree and one set of searches.

``representatives`` removes near copies by similarity instead. Fingerprints of several words of 64 bits over distinct
shingles, linked within the number of bits at which two texts of that Jaccard similarity differ, one standard deviation
allowed, only propose links; that radius is too wide for the pigeonhole index, so its shards are keyed by samples of bits, so
many that a pair at the threshold shares one with probability 0.95, and more similar pairs almost surely. A document goes only
if the exact Jaccard similarity of its shingles with those of a document that stays is at least the threshold: nothing goes
because it resembles something that itself goes.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows each
return their row; a null doc_id keeps its row and never names a component unless all members lack an id;
an empty table returns no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.anchors import mix
from loomfactor.llm.common import NO_ID, discard, id_or_last, materialize, small_batches
from loomfactor.llm.components import components


def _words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split act on ASCII only."""
    return (text or "").encode().lower().split()


def shingle_hashes(said: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text's words, repeats included; of the whole sequence, if it is shorter; none of no words."""
    if not said:
        return np.zeros(0, np.uint64)
    joined = b" ".join(said)
    ends = np.cumsum([len(w) + 1 for w in said])
    n = max(1, len(said) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, words: int = 1, distinct: bool = False) -> list[int]:
    """SimHash of a text's word shingles, as so many 64-bit words."""
    return _print(_words(text), shingle, seed, words, distinct)


def _print(said: list[bytes], shingle: int, seed: int, words: int, distinct: bool) -> list[int]:
    h = shingle_hashes(said, shingle, seed)
    if not len(h):
        return [0] * words
    if distinct:
        h = np.unique(h)
    out = []
    for _ in range(words):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 16384):
            bits = np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]))
        h = mix(h)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, tk, nk, fp0, fp1, ...) for every row of docs: the xxhash64 of the text, a hash of its words, and the bits as
    signed longs."""
    names = ["doc_id", "tk", "nk", *word_names(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            said = [_words(t) for t in batch.column(2).to_pylist()]
            same = np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in said], dtype=np.uint64).view(np.int64)
            fps = np.array([_print(x, shingle, seed, words, distinct) for x in said], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same), *(pa.array(x) for x in fps.T.copy())], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text")).mapInArrow(
        run, ", ".join(f"{x} long" for x in names)
    )


def word_names(words: int) -> list[str]:
    return [f"fp{i}" for i in range(words)]


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits set in each row of words."""
    return np.bitwise_count(values).sum(axis=-1, dtype=np.int64)


class BKTree:
    """BK-tree over distinct fingerprints (rows of 64-bit words), built and searched in batches: the subtree of a child
    holds all values at one Hamming distance from the parent. Small subtrees stay flat."""

    LEAF = 48

    def __init__(self, values: np.ndarray, ids: np.ndarray | None = None):
        ids = np.arange(len(values)) if ids is None else ids
        self.values, self.ids, self.children = values, ids, None
        if len(values) > self.LEAF:
            self.pivot, self.pivot_id = values[0], ids[0]
            dist = _bits(values[1:] ^ self.pivot)
            self.children = {
                int(d): BKTree(values[1:][dist == d], ids[1:][dist == d]) for d in np.unique(dist)
            }
            self.values = self.ids = None

    def search(self, queries: np.ndarray, q_ids: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (query ids, value ids) within the radius."""
        if self.children is None:
            for at in range(0, len(queries), 8192):
                near = _bits(queries[at : at + 8192, None] ^ self.values[None, :]) <= radius
                q, v = np.nonzero(near)
                if len(q):
                    yield q_ids[at + q], self.ids[v]
            return
        dist = _bits(queries ^ self.pivot)
        hit = dist <= radius
        if hit.any():
            yield q_ids[hit], np.full(int(hit.sum()), self.pivot_id)
        for edge, child in self.children.items():
            near = np.abs(dist - edge) <= radius
            if near.any():
                yield from child.search(queries[near], q_ids[near], radius)


def _find(parent: list[int] | np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _small_links(values: list[int], radius: int) -> list[int]:
    """Parents of a union-find over a few values, by inserting each into a BK-tree and searching it first."""
    parent = list(range(len(values)))
    children: list[dict[int, int]] = [{} for _ in values]
    for i in range(1, len(values)):
        todo = [0]
        while todo:
            node = todo.pop()
            d = (values[i] ^ values[node]).bit_count()
            if d <= radius:
                parent[_find(parent, i)] = _find(parent, node)
            todo += [c for edge, c in children[node].items() if abs(edge - d) <= radius]
        node = 0
        while True:
            d = (values[i] ^ values[node]).bit_count()
            if d not in children[node]:
                children[node][d] = i
                break
            node = children[node][d]
    return parent


def shard_links(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Star links (member, smallest member) of the components within one shard. Rows are an id and the words of a
    fingerprint, signed longs; queries: those of another tile, or None to link the tree's own values."""
    rows = tree if queries is None else np.concatenate([tree, queries])
    values = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
    if len(rows) <= 32 and queries is None:
        parent = _small_links([int.from_bytes(v.tobytes(), "little") for v in values], radius)
    else:
        index = BKTree(values[: len(tree)])
        first = 0 if queries is None else len(tree)
        parent = np.arange(len(rows))
        for a, b in index.search(values[first:], np.arange(first, len(rows)), radius):
            while True:  # labels first: most pairs of a dense group are joined already
                for _ in range(64):
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
                low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
                if (low == high).all():
                    break
                np.minimum.at(parent, high, low)
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(rows[:, 0].tolist()):
        groups.setdefault(_find(parent, i), []).append(v)
    return [(v, low) for g in groups.values() if len(g) > 1 for low in [min(g)] for v in g if v != low]


def shard_degrees(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """(member, number of others within the radius) of the members of a shard that have any; rows as in shard_links()."""
    rows = tree if queries is None else np.concatenate([tree, queries])
    values = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
    first = 0 if queries is None else len(tree)
    counts = np.zeros(len(rows), np.int64)
    for a, b in BKTree(values[: len(tree)]).search(values[first:], np.arange(first, len(rows)), radius):
        counts += np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
    if queries is None:  # every pair was met from both ends, and every member met itself
        counts = counts // 2 - 1
    met = np.flatnonzero(counts)
    return list(zip(rows[met, 0].tolist(), counts[met].tolist()))


def _search_shards(radius: int, found=shard_links):
    """Rows come sorted by shard, tile pair; each run of equal keys is one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = np.stack([c.astype(np.int64) for c in cols], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            if not len(cut):
                held = [rows]
                continue
            yield from emit(np.split(rows, cut)[:-1])
            held = [rows[cut[-1] :]]
        if held:
            yield from emit([held[0]])

    def emit(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for g in groups:
            if g[0, 2] == g[0, 3]:
                out += found(g[:, 5:], None, radius)
            else:
                first = g[:, 4] == g[0, 2]
                if first.any() and not first.all():
                    out += found(g[first, 5:], g[~first, 5:], radius)
        if out:
            a = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of blocks - radius blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    of = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(of[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def sampled_masks(words: int, bits: int, tables: int) -> list[list[int]]:
    """So many masks, each of so many bits of a fingerprint of several words, as signed longs."""
    rng = np.random.default_rng(20)
    out = []
    for _ in range(tables):
        mask = np.zeros(64 * words, np.uint8)
        mask[rng.choice(64 * words, bits, replace=False)] = 1
        out.append(np.packbits(mask, bitorder="little").view(np.int64).tolist())
    return out


def links(nodes: DataFrame, radius: int = 4, masks: list[list[int]] | None = None, tile: int = 4096, found=shard_links) -> DataFrame:
    """nodes(id, fp0, ...), distinct -> links (a, b) between ids, or what else is found in a shard. Without masks they join exactly the fingerprints
    reachable within the radius; masks name other shards, whose members are linked if within it."""
    if masks is None:  # as the table grows, longer shard keys keep shards small; any choice finds all pairs
        n = nodes.count()
        masks = [[m] for m in block_masks(radius + (2 if n < 2**24 else 3 if n < 2**32 else 4), radius)]
    names = [c for c in nodes.columns if c != "id"]
    every = F.array(*[F.array(*[F.lit(w).cast("long") for w in m]) for m in masks])
    keyed = nodes.select("*", F.posexplode(every).alias("replica", "mask"))
    keyed = keyed.select(
        F.col("replica").cast("int").alias("replica"),
        F.xxhash64(*[F.col(c).bitwiseAND(F.col("mask")[i]) for i, c in enumerate(names)]).alias("key"),
        "id",
        *names,
    )
    shards = keyed.groupBy("replica", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(shards, ["replica", "key"]).withColumn("k", F.ceil(F.col("n") / tile).cast("int"))
    shared = shared.withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    tiled = shared.select(
        "replica", "key", "s", "id", *names, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    ).select("replica", "key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "id", *names)
    return (
        tiled.repartition("replica", "key", "i", "j")
        .sortWithinPartitions("replica", "key", "i", "j")
        .mapInArrow(_search_shards(radius, found), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, tile: int = 4096
) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = materialize(fingerprints(docs, shingle, seed).select("doc_id", F.col("fp0").alias("fp")))
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_or_last()).alias("low")))
    roots = components(links(nodes.select(F.col("fp").alias("id"), F.col("fp").alias("fp0")), radius, tile=tile))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lows, "root").select("fp", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def bit_share(similarity: float) -> float:
    """Expected share of differing bits of two texts of equal size and this Jaccard similarity of shingles."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


#: Members that are compared with one document in one task.
FANOUT = 2048
#: Words of the fingerprints of documents that a first round has not decided.
FINE_WORDS = 64
#: Meetings with near ones that are too few to tell a text from its copies.
FEW_NEAR = 16
#: Share of the tables that are read to tell how many near ones a document has.
DEGREE_TABLES = 0.2
#: Numbers of nodes below are ids; those of nodes whose id is null, repeated or outside of them come after.
_LATE = 2**56


def numbered(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """nodes (nk, low: smallest oid and tk, ...) with a number of its own each: those first that have most others near
    (degrees: a, b), to a power of two; of equals, and where few are near, in the order of the ids, those that share an id or
    have none last."""
    first = nodes.filter(F.col("low.oid") < NO_ID).groupBy("low.oid").agg(F.min("low.tk").alias("first_tk"))
    joined = nodes.join(first, nodes["low.oid"] == first.oid, "left").drop("oid")
    joined = joined.join(degrees.groupBy(F.col("a").alias("nk")).agg(F.sum("b").alias("near")), "nk", "left")
    own = (F.col("low.tk") == F.col("first_tk")) & F.col("low.oid").between(0, _LATE - 1)
    body = F.when(own, F.col("low.oid")).otherwise(F.lit(_LATE) + F.pmod(F.xxhash64("low.oid", "low.tk"), F.lit(_LATE)))
    many = F.coalesce("near", F.lit(0)) / FEW_NEAR
    level = 63 - F.least(F.floor(F.log2(1 + many)), F.lit(63)).cast("long")
    return joined.withColumn("id", F.shiftleft(level, 57) + body).drop("first_tk", "near")


def close_members(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int, fanout: int = FANOUT) -> DataFrame:
    """(a) of pairs (a, b) whose texts (id, text) have at least this Jaccard similarity of distinct shingles. A document that
    many are compared with goes to as many tasks as it takes."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / fanout).cast("int").alias("k"))
    left = pairs.join(sizes, "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    left = left.withColumn("s", F.pmod(F.xxhash64("a"), F.col("k")).cast("int")).drop("k")
    right = sizes.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, np.zeros(0, np.uint64)
        hashes = lambda t: np.unique(shingle_hashes(_words(t), shingle))
        for batch in small_batches(batches, "x", 128):
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if b != known:
                    known, held = b, hashes(y)
                mine = hashes(x)
                both = len(np.intersect1d(mine, held, assume_unique=True))
                if both >= similarity * (len(mine) + len(held) - both) - 1e-9:
                    out.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["a"])

    return left.join(right, ["b", "s"]).select("a", "b", "x", "y").mapInArrow(run, "a long").distinct()


def representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 4, tile: int = 4096) -> DataFrame:
    """(doc_id, tk) of the documents that stay: a row of docs stays if its id (null-safe) and the xxhash64 of its text are
    found here. Texts of the same words are one document, that of the smallest id (nulls last, then by text hash).

    Documents are put in order: those that have most others near come first (a text from which many copies were made, before
    the copies, which may be far from each other), of equals the smaller id. Round by round, the documents that no proposed link
    leads to an earlier one stay for good; of the others, those go that are exactly close to one of them; the rest meet again,
    by finer fingerprints: texts that are alike but not close would otherwise keep each other waiting.
    So every document that goes is close to one that stays, and no two that stay are close unless no link proposed them.
    """
    names, p = word_names(words), bit_share(similarity)
    size = 64 * words
    radius = int(size * p + np.sqrt(size * p * (1 - p)))
    low = F.struct(id_or_last().alias("oid"), "tk")
    rows = fingerprints(docs, shingle, words=words, distinct=True)
    # Rows of equal nk have equal fingerprints.
    texts_of = materialize(rows.groupBy("nk").agg(F.min(low).alias("low"), *[F.min(c).alias(c) for c in names]))
    bits = min(max(12, texts_of.count().bit_length() + 1), size // 2)
    masks = sampled_masks(words, bits, int(np.ceil(3 / (1 - p) ** bits)))
    some = masks[: int(np.ceil(DEGREE_TABLES * len(masks)))]
    degrees = links(texts_of.select(F.col("nk").alias("id"), *names), radius, some, tile, shard_degrees)
    nodes = materialize(numbered(texts_of, degrees).drop("nk"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = docs.select(id_or_last().alias("oid"), F.xxhash64(text).alias("tk"), text.alias("text"))

    present, stay, fine = nodes, [], False
    while True:
        found = materialize(links(present.select("id", *names), radius, masks, tile).distinct())
        if found.isEmpty():
            stay.append(present.select("low"))
            break
        members = found.select(F.col("a").alias("id")).distinct()
        stay.append(present.join(members, "id", "left_anti").select("low"))
        pairs = found.join(members.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(present.select("id", "low.*"), "id")
        texts = materialize(said.join(ends, ["oid", "tk"]).groupBy("id").agg(F.first("text").alias("text")))
        close = close_members(pairs, texts, similarity, shingle).select(F.col("a").alias("id"))
        present = present.join(members, "id", "left_semi").join(close, "id", "left_anti")
        if not fine:
            # What is left is alike, but not close to what stays: finer fingerprints tell which of it may be close at all.
            fine, names, size = True, word_names(FINE_WORDS), 64 * FINE_WORDS
            radius = int(size * p + 2 * np.sqrt(size * p * (1 - p)))
            masks = [[*m, *[0] * (FINE_WORDS - words)] for m in masks]
            present = materialize(present.select("id", "low"))
            rows = said.join(present.select("id", "low.*"), ["oid", "tk"]).select(F.col("id").alias("doc_id"), "text")
            prints = fingerprints(rows, shingle, words=FINE_WORDS, distinct=True).groupBy(F.col("doc_id").alias("id"))
            present = present.join(prints.agg(*[F.min(c).alias(c) for c in names]), "id")
        present = materialize(present)
        discard(texts)
    kept = stay[0]
    for more in stay[1:]:
        kept = kept.unionByName(more)
    return kept.select(F.nullif("low.oid", F.lit(NO_ID)).alias("doc_id"), "low.tk")
