"""Source divergence audit: how the words of each source of a language differ from those of each other source and of the
language, by vectorized SQL over shards.

1. Counts. Each task counts the words of its documents with DuckDB: (lang, source, term, occurrences, documents), in slices
   of a bounded number of bytes whose counts are added up as they grow.
2. Shards. The counts are dealt by the hash of lang and term, so that all sources of a term meet. Each shard adds them up
   and keeps the terms in at least ``least`` documents of their language, a row a term.
3. Scores. With the totals of all groups known, each shard sums, for every pair of sources, what the terms that both use add
   to their divergence, and ranks its own terms of each source. Only sums and the shard's best terms leave a shard.
4. Spark adds the sums, supplies what terms used by one source or none add (the value of a group's missing term is the same
   for all of them, so their number is enough), and ranks.

A common word reaches its shard once a task and source, not once a document; a shard has a bounded number of rows, as the
number of shards follows the number of counts. The totals of groups, a row each, are brought to the driver and sent to the
tasks: the result has a row for each ordered pair of them, so they are about the square root of it.

All arithmetic is exact, in integers.

Defined results: null lang, source and text are ''; every row is a document, repeated ones too; a group without words has
pairs (of value 0 if its language keeps no term) and no terms; a language with one source has no pairs; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.llm.common import materialize

#: Words, and the unit of a share. Fixed values.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Bytes of text that are counted at a time, and rows of counts that a task holds before it passes them on.
SLICE, HELD = 4_000_000, 1_000_000
#: Rows of counts a shard has on average.
SHARD_ROWS = 500_000


def _connect() -> duckdb.DuckDBPyConnection:
    """A database of one task: in memory, one thread, and no folder to spill to."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have about SLICE bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = [len(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        first = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if held or first < len(sizes):
            yield batch.slice(first)


def _done(db: duckdb.DuckDBPyConnection, query: str) -> list[tuple]:
    """Run a query to its end: a connection does one thing at a time."""
    return db.execute(query).fetchall()


class Sums:
    """A table of keys and sums inside a task's database that adds up what is put in."""

    def __init__(self, db: duckdb.DuckDBPyConnection, name: str, keys: str, sums: tuple[str, ...]):
        self.db, self.name, self.keys, self.sums = db, name, keys, sums
        self.kept = 0
        _done(db, f"create table {name} ({keys}, {', '.join(f'{s} hugeint' for s in sums)})")
        self.names = [k.split()[0] for k in keys.split(", ")]

    @property
    def merged(self) -> str:
        return f"select {', '.join(self.names)}, {', '.join(f'sum({s}) as {s}' for s in self.sums)} from {self.name} group by all"

    def rows(self) -> int:
        return _done(self.db, f"select count(*) from {self.name}")[0][0]

    def put(self, query: str) -> None:
        """Insert what a query returns; add rows of equal keys once the table has doubled."""
        _done(self.db, f"insert into {self.name} {query}")
        rows = self.rows()
        if rows > max(2 * self.kept, HELD // 4):
            _done(self.db, f"create or replace table merging as {self.merged}")
            _done(self.db, f"delete from {self.name}")
            _done(self.db, f"insert into {self.name} select * from merging")
            _done(self.db, "drop table merging")
            self.kept = self.rows()

    def take(self, query: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The batches of a query; the table is empty afterwards."""
        yield from _batches(self.db, query, schema)
        _done(self.db, f"delete from {self.name}")
        self.kept = 0


def _batches(db: duckdb.DuckDBPyConnection, query: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in db.execute(query).to_arrow_reader(50_000):
        yield pa.Table.from_batches([batch]).cast(schema).combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], schema)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, and a row of the term '' for each group."""
    db = _connect()
    counts = Sums(db, "counts", "lang varchar, source varchar, term varchar", ("n", "df"))
    cast = "select lang, source, term, n::bigint as n, df::bigint as df from"
    for piece in _slices(batches):
        db.register("docs", pa.table({"r": pa.array(range(piece.num_rows)), **{c: piece.column(c) for c in ("lang", "source", "text")}}))
        words = f"""select r, lang, source, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '{TERM}')) as term from docs"""
        counts.put(
            f"""select lang, source, term, sum(n), count(*) from (select r, lang, source, term, count(*) as n from ({words}) group by all) group by all
            union all select distinct lang, source, '', 0, 0 from docs"""
        )
        db.unregister("docs")
        if counts.kept > HELD:
            yield from counts.take(f"{cast} ({counts.merged})", _COUNTED)
    yield from counts.take(f"{cast} ({counts.merged})", _COUNTED)


_PLACES = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("places", _PLACES)])


def _keep(least: int):
    """The terms of a shard that enough documents hold, with their sources and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connect()
        counts = Sums(db, "counts", "lang varchar, source varchar, term varchar", ("n", "df"))
        for batch in batches:
            db.register("more", pa.Table.from_batches([batch]))
            counts.put("select lang, source, term, n, df from more")
            db.unregister("more")
        yield from counts.take(
            f"""select lang, term, list(struct_pack(source := source, n := n::bigint)) as places from ({counts.merged})
            group by lang, term having sum(df) >= {least}""",
            _KEPT,
        )

    return run


_SCORED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _share(n: str, total: str) -> str:
    return f"(1 + ({SCALE}::hugeint * ({n} + 1)) // ({total}))::bigint"


def _score(groups: pa.Table, best: int):
    """Sums of pairs and the best terms of the rows of kept terms in a task. groups: (lang, source, total, all_total), totals
    of a source and of its language with the number of kept terms added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connect()
        db.register("given", groups)
        _done(db, f"create table g as select *, {_share('0', 'total')} as p0 from given")
        _done(db, "create macro f(p, q) as ((p - q) * (p - q)) // q")
        pairs = Sums(db, "pairs", "lang varchar, source varchar, item varchar", ("v",))
        alone = Sums(db, "alone", "lang varchar, source varchar, p bigint, p0 bigint", ("k",))
        _done(db, "create table top (lang varchar, source varchar, item varchar, v bigint)")
        ranked = f"select * from top qualify row_number() over (partition by lang, source order by v desc, item) <= {best}"
        for batch in batches:
            db.register("kept", pa.Table.from_batches([batch]))
            _done(db, 
                f"""create or replace table k as select lang, term, source, n, p0, {_share('n', 'total')} as p, {_share('all_n', 'all_total')} as q
                from (select lang, term, list_sum(list_transform(places, lambda x: x.n)) as all_n, unnest(places, recursive := true) from kept) join g using (lang, source)"""
            )
            pairs.put(
                """select a.lang, a.source, b.source, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))
                from k a join k b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all"""
            )
            alone.put("select lang, source, p, p0, count(*) from k group by all")
            _done(db, "insert into top select lang, source, term, f(p, q) from k where p > q")
            _done(db, f"create or replace table top as {ranked}")
            db.unregister("kept")
        pairs.put(
            f"""select x.lang, x.source, y.source, sum(k * f(x.p, y.p0)) from ({alone.merged}) x join g y on x.lang = y.lang and x.source <> y.source group by all
            union all select x.lang, y.source, x.source, sum(k * f(y.p0, x.p)) from ({alone.merged}) x join g y on x.lang = y.lang and x.source <> y.source group by all"""
        )
        yield from pairs.take(f"select lang, source, 'pair' as part, item, v::bigint as value from ({pairs.merged})", _SCORED)
        yield from _batches(db, "select lang, source, 'term' as part, item, v as value from top", _SCORED)

    return run


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): partial counts of every task, and a row of the term '' for each group."""
    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return said.mapInArrow(_count, "lang string, source string, term string, n long, df long")


def audit(docs: DataFrame, least: int = 3, best: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the divergence from every other source of its language
    (part ``pair``, all ranks), and its ``best`` terms that are more frequent than in the language (part ``term``)."""
    spark = docs.sparkSession
    counted = materialize(counts(docs))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // SHARD_ROWS))
    dealt = counted.filter("term <> ''").repartition(shards, "lang", "term")
    kept = materialize(dealt.mapInArrow(_keep(least), "lang string, term string, places array<struct<source:string,n:long>>"))

    used = kept.select("lang", F.explode("places").alias("x")).groupBy("lang", F.col("x.source").alias("source"))
    used = used.agg(F.sum("x.n").alias("n"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("all_n"))
    groups = counted.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.na.fill(0))
    # A row a group: about the square root of the rows of the result.
    totals = groups.filter("v > 0").select("lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.col("all_n") + F.col("v")).alias("all_total")).toArrow()

    scored = kept.mapInArrow(_score(totals, best), "lang string, source string, part string, item string, value long")
    scored = materialize(scored)
    missing = lambda g: 1 + F.expr(f"{SCALE} div greatest({g}.n + {g}.v, 1)")
    a, b = groups.alias("a"), groups.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    both = both.select("a.lang", "a.source", F.col("b.source").alias("item"), (F.col("a.v") - F.col("a.terms") - F.col("b.terms")).alias("rest"), missing("a").alias("p"), missing("b").alias("q"))
    sums = scored.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    value = F.coalesce("value", F.lit(0)) + F.expr("rest * ((p - q) * (p - q) div q)")
    pairs = both.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = scored.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= best)
    return pairs.withColumn("rank", place).unionByName(terms)
