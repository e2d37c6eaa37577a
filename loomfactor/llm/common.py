"""Helpers that the corpus operators share: input tables, scratch tables, row limits of Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id given, inside the operators, to rows whose id is null: such a row comes after every other row.
NO_ID = 2**63 - 1

#: Scopes entered and not yet left; the innermost owns the tables that are written meanwhile.
_scopes: list["Scope"] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets a folder of
    its own and any other is an error: executors elsewhere could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scope:
    """Owns the scratch tables written inside it, and only those, until release()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scope":
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)

    def release(self) -> None:
        """Delete the tables. Call it only when no DataFrame that reads them is needed."""
        for p in self.paths:
            discard_path(self.spark, p)
        self.paths.clear()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    # The plans behind df are done with: once their objects are collected, Spark drops their shuffle files.
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() returned and no later step reads."""
    discard_path(df.sparkSession, df.scratch_path)
    for scope in _scopes:
        if df.scratch_path in scope.paths:
            scope.paths.remove(df.scratch_path)


def discard_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a Python worker holds few texts at a time, however long they are."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def id_or_last(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))
