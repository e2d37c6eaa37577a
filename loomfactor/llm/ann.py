"""Approximate nearest neighbours by multiprobe p-stable hashing, nearest by inner product.

Vectors get one more component, sqrt(M^2 - |x|^2) for the largest norm M and 0 for a query, so that the largest
inner product is the smallest Euclidean distance. Each of ``tables`` tables floors ``hashes`` Gaussian
projections into cells; cells beyond two steps of the middle are merged, which bounds a table to 5**hashes
buckets whatever the number of rows, so the directory of buckets and counts may be broadcast. A query visits
buckets of each table in the order of estimated success (the sum of squared gaps between its projections and
the cells' walls) until they hold ``share`` of all rows. Candidates are reranked by exact distance.

Buckets are cut into tiles of about ``tile`` vectors and queries into tiles of about as many; a bucket's tile meets one
tile of queries in a task, so neither a hot bucket nor many queries outgrow it. Equal vectors are indexed
once, with the k + 1 smallest ids, which is all that any answer can need of them.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most
(of two equally frequent lengths the greater counts) take no part; rows with a null id take no part; rows that repeat an
id are one row, the first by its components; no queries or candidates give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.llm.common import materialize


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max_by("dim", F.struct("n", "dim")).alias("dim")).first()
    return rows.filter(F.size("v") == F.lit(most.dim)).groupBy("vec_id").agg(F.min("v").alias("v"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Hashes:
    def __init__(self, dim: int, norm: float, spread: np.ndarray, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.tables, self.hashes = norm, tables, hashes
        self.axes = rng.normal(size=(dim + 1, tables * hashes))
        full = self.lift(spread, False) @ self.axes
        self.middle, self.width = np.median(full, axis=0), width * np.maximum(full.std(axis=0), 1e-12)
        self.shift = rng.uniform(0, 1, tables * hashes)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def places(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections in units of cells, (rows, tables, hashes)."""
        p = (self.lift(x, query) @ self.axes - self.middle) / self.width + self.shift
        return p.reshape(len(x), self.tables, self.hashes)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        cells = np.clip(np.floor(self.places(x)), -2, 2).astype(np.int64) + 2
        return cells @ (5 ** np.arange(self.hashes))

    def probes(self, x: np.ndarray, directory: list[tuple[np.ndarray, np.ndarray]], share: float):
        """For each table, (query row, bucket) pairs in the order of estimated success, to the share of rows."""
        at = self.places(x, query=True)
        for t, (buckets, counts) in enumerate(directory):
            cells = buckets[:, None] // (5 ** np.arange(self.hashes)) % 5 - 2
            low = np.where(cells == -2, -np.inf, cells)
            high = np.where(cells == 2, np.inf, cells + 1.0)
            for q in range(len(x)):
                gap = np.maximum(low - at[q, t], 0) + np.maximum(at[q, t] - high, 0)
                order = np.argsort((gap * gap).sum(axis=1), kind="stable")
                stop = int(np.searchsorted(np.cumsum(counts[order]), share * counts.sum())) + 1
                yield t, q, buckets[order[:stop]]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _score(queries: pa.Table, items: pa.Table, keep: int) -> pa.Table:
    """(q, uid, s): the best items of each query, ties to the smaller uid. Matrix products tell which can be among them;
    their order is that of products summed component by component, as inner_product() sums them."""
    if not queries.num_rows or not items.num_rows:
        return pa.table({"q": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    uid, x = items["uid"].combine_chunks().to_numpy(), _matrix(items["v"].combine_chunks())
    q_ids, y = queries["q"].combine_chunks().to_numpy(), _matrix(queries["v"].combine_chunks())
    slack = 1e-12 * np.abs(x).max() * np.abs(y).max() * x.shape[1] ** 2
    out = []
    for at in range(0, len(q_ids), 256):
        s = y[at : at + 256] @ x.T
        least = np.partition(s, -keep, axis=1)[:, -keep] if keep < s.shape[1] else s.min(axis=1)
        for i, row in enumerate(s):
            found = np.flatnonzero(row >= least[i] - slack)
            exact = np.cumsum(x[found] * y[at + i], axis=1)[:, -1]
            best = np.lexsort((uid[found], -exact))[:keep]
            out.append((np.full(len(best), q_ids[at + i]), uid[found][best], exact[best]))
    return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("q", "uid", "s"), zip(*out))})


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = 4,
    share: float = 0.35,
    width: float = 2.0,
    tile: int = 4096,
    sample: int = 2000,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query (of vec_id) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors, id_col, vec_col))
    # Equal vectors: the smallest id stands for all; a rank limit is applied before the shuffle.
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    units = materialize(
        ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "v", "ids")
    )
    asked = materialize(rows.filter(is_query).join(units.select("uid", "v"), "v").select("vec_id", "uid", "v"))
    queries = asked.groupBy("uid").agg(F.first("v").alias("v"))
    n, dim, norm = units.select(
        F.count("*"), F.max(F.size("v")), F.max(F.sqrt(inner_product(F.col("v"), F.col("v"))))
    ).first()
    if not n:
        return spark.createDataFrame([], schema)
    # Cell walls are fitted on a bounded sample, the rows of the smallest hashes of their ids.
    spread = np.array([r.v for r in units.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("v").collect()])
    # A table has at most 5**7 buckets, which bounds the directory that is brought here and broadcast.
    hashes = int(np.clip(round(np.log(n / 600) / np.log(3)), 4, 7))
    fam = Hashes(dim, norm, spread, tables, hashes, width, seed)
    query_tiles = max(1, -(-queries.count() // tile))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = fam.buckets(_matrix(b.column(1)))
                for t in range(tables):
                    cols = [pa.array(np.full(b.num_rows, t, np.int32)), pa.array(codes[:, t]), b.column(0), b.column(1)]
                    yield pa.RecordBatch.from_arrays(cols, ["t", "bucket", "uid", "v"])

    items = units.select("uid", "v").mapInArrow(index, "t int, bucket long, uid long, v array<double>")
    counts = items.groupBy("t", "bucket").agg(F.count("*").alias("n"))
    table, bucket, count = (c.to_numpy() for c in counts.toArrow().columns)
    directory = []
    for t in range(tables):
        order = np.flatnonzero(table == t)[np.argsort(bucket[table == t])]
        directory.append((bucket[order], count[order]))
    shared = spark.sparkContext.broadcast(directory)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, got = b.slice(at, 64), []
                for t, q, found in fam.probes(_matrix(part.column(1)), shared.value, share):
                    buckets, counts = shared.value[t]
                    k = -(-counts[np.searchsorted(buckets, found)] // tile)  # tiles of each bucket
                    s = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    got.append(np.stack([np.full(len(s), t), np.repeat(found, k), s, np.full(len(s), q)]))
                t, bucket, s, q = np.concatenate(got, axis=1)
                cols = [pa.array(t.astype(np.int32)), pa.array(bucket), pa.array(s.astype(np.int32)), part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q))]
                yield pa.RecordBatch.from_arrays(cols, ["t", "bucket", "s", "q", "v"])

    probes = queries.mapInArrow(probe, "t int, bucket long, s int, q long, v array<double>")
    probes = probes.withColumn("o", F.pmod(F.xxhash64("q"), F.lit(query_tiles)).cast("int"))
    sizes = counts.select("t", "bucket", F.ceil(F.col("n") / tile).alias("k"))
    tiles = items.join(F.broadcast(sizes), ["t", "bucket"]).withColumn("s", F.pmod(F.xxhash64("uid"), F.col("k")).cast("int"))
    tiles = tiles.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    keep, group = k + 1, ["t", "bucket", "s", "o"]
    found = (
        probes.groupBy(*group)
        .cogroup(tiles.groupBy(*group))
        .applyInArrow(lambda _, a, b: _score(a, b, keep), "q long, uid long, s double")
    )
    near = found.groupBy("q", "uid").agg(F.max("s").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "uid")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).drop("r")
    # Every id of the vectors that are left, then each query without itself.
    exact = near.join(units.select("uid", "ids"), "uid").select("q", F.explode("ids").alias("vec_id"), "score")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = (
        exact.withColumn("r", F.row_number().over(best))
        .filter(F.col("r") <= k + 1)
        .groupBy("q")
        .agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    )
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("uid").alias("q")).join(lists, "q")
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return answers.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )
