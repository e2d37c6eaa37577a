"""Small files on whatever file system a path names, through Hadoop: listings, markers, deletions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets
    one of its own and any other is an error: executors elsewhere could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/f-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none if there is no such folder."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    names = [f.getPath().getName() for f in system.listStatus(where)]
    return sorted(n for n in names if n[0] not in "._")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    where, system = _at(spark, path)
    begun = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(begun, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(begun, where):
        system.delete(begun, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)
