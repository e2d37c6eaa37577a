"""The result store: one row per run and canonical expression, kept as Parquet partitioned by run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.sources import files


def run_id(config: dict) -> str:
    """Names a run by everything that decides its results."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def latest(rows: DataFrame) -> DataFrame:
    """The last written row of each run and canonical expression."""
    last = Window.partitionBy("run_id", "canonical").orderBy(F.desc("created_at"))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


class ResultStore:
    """Upserts append versions to a log. A compaction writes the latest of each key as one file and then a marker that names
    it and the files of the log it stands for: the marker appears whole or not at all, so a reader sees the state before
    or after, never part of one. What a marker replaces is deleted by the compaction after it, so readers that have
    begun may end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upsert(self, rows: DataFrame) -> None:
        stamped = rows.withColumn("created_at", F.current_timestamp())
        stamped.write.mode("append").partitionBy("run_id").parquet(f"{self.path}/log")

    def _marker(self, run: str) -> tuple[int, dict]:
        """(number of the last compaction, what it says); 0 before the first."""
        names = files.listing(self.spark, f"{self.path}/commits/run_id={run}")
        if not names:
            return 0, {"base": None, "log": []}
        return int(names[-1]), json.loads(files.read_text(self.spark, f"{self.path}/commits/run_id={run}/{names[-1]}"))

    def files(self, run: str) -> list[str]:
        """The data files that hold a run: its last compaction and the log since."""
        _, said = self._marker(run)
        folder = f"{self.path}/log/run_id={run}"
        fresh = [f"{folder}/{n}" for n in files.listing(self.spark, folder) if n not in set(said["log"])]
        return ([said["base"]] if said["base"] else []) + fresh

    def _versions(self, run: str) -> DataFrame | None:
        paths = self.files(run)
        if not paths:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*paths)
        return rows.withColumn("run_id", F.lit(run))

    def all(self, run: str) -> DataFrame:
        rows = self._versions(run)
        if rows is None:
            raise FileNotFoundError(f"no results of run {run} under {self.path}")
        return latest(rows).orderBy(F.desc_nulls_last("score"), "canonical")

    def compact(self, run: str) -> None:
        """One file for all that the run has; nothing changes for readers."""
        number, said = self._marker(run)
        folder = f"{self.path}/log/run_id={run}"
        seen = files.listing(self.spark, folder)
        if not set(seen) - set(said["log"]):
            return
        rows = self._versions(run)
        base = f"{self.path}/base/run_id={run}/v={number + 1:08d}"
        latest(rows).drop("run_id").coalesce(1).write.mode("overwrite").parquet(base)
        marker = json.dumps({"base": base, "log": seen})
        files.write_text(self.spark, f"{self.path}/commits/run_id={run}/{number + 1:08d}", marker)
        for name in said["log"]:
            files.delete(self.spark, f"{folder}/{name}")
        if number > 1:
            files.delete(self.spark, f"{self.path}/base/run_id={run}/v={number - 1:08d}")
            files.delete(self.spark, f"{self.path}/commits/run_id={run}/{number - 1:08d}")

    def remaining(self, run: str, wanted: DataFrame) -> DataFrame:
        """Rows of wanted whose canonical key the run has not done; expressions that failed count as done."""
        rows = self._versions(run)
        return wanted if rows is None else wanted.join(rows.select("canonical").distinct(), "canonical", "left_anti")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("score"), "canonical").limit(k)
