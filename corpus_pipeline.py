"""A corpus pipeline from the operators of loomfactor.llm: each stage takes the documents its predecessor kept.

A stage owns the scratch tables it writes. They are released when the next stage begins: by then its output has been
written. Tables of other queries are left alone.

Every stage takes null ids and texts, repeated rows and ids, empty tables and further columns; it returns COLUMNS, and
the last one tokens and rate beside them. Rows that repeat an id with different texts are different documents.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfactor.llm import decontaminate, mixing, simhash, suffix_array, toxicity
from loomfactor.llm.common import Scope, discard_path, scratch_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scopes of stages that STAGES ran and whose tables may still be read.
_open: list[Scope] = []


def staged(stage):
    """A stage that owns its scratch tables and releases those of the stage before it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _open:
            _open.pop().release()
        with Scope(spark) as own:
            out = stage(spark, docs, sf_dir)
        _open.append(own)
        return out

    return run_stage


def text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs.select(COLUMNS), model).filter("score < 0.5").select(COLUMNS)


@staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if its five-word shingles have a Jaccard similarity of 0.8 with those of a document that stays: of a
    group the one that most are near to, of equals that of the smallest id. What is only alike by way of others stays."""
    heads = simhash.representatives(docs).select(F.col("doc_id").alias("head"), "tk")
    rows = docs.select(COLUMNS).withColumn("tk", text_key())
    kept = rows.join(heads, (rows.tk == heads.tk) & rows.doc_id.eqNullSafe(heads["head"]), "left_semi")
    # Rows that repeat both id and text are one document; copies are merged before the shuffle.
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    return kept.groupBy("doc_id", "tk").agg(F.first("text").alias("text"), rest).select("doc_id", "text", "rest.*")


@staged
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand in more than one place go; a document left with nothing goes."""
    cut = suffix_array.remove_repeats(docs.select(COLUMNS), keep=["lang", "source", "n_chars"], keep_text=True)
    cut = cut.filter("n_removed = 0 or length(trim(kept)) > 0")
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


@staged
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("tk").distinct()
    return docs.withColumn("tk", text_key()).join(found, "tk", "left_anti").select(COLUMNS)


@staged
def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets the rate at which the mix draws it; one that is never drawn goes."""
    mixed = mixing.mix(docs.select(COLUMNS), mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)
    return mixed.filter("rate > 0").select(*COLUMNS, "tokens", "rate")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", weigh),
]

#: No stage after the first scoring can be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the table documents. The output of a stage is deleted once the next one's is
    written; the last one's is what the caller reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with Scope(spark) as own:
            out = stage.__wrapped__(spark, docs, sf_dir)
            path = f"{scratch_dir(spark)}/stage-{uuid.uuid4().hex}"
            out.write.parquet(path)
        own.release()
        if before:
            discard_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
