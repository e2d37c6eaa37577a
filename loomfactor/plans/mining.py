"""A mining run: expressions are checked, scored batch by batch, merged into the result store, and written out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfactor.functions.features import PUBLIC
from loomfactor.operators import metrics
from loomfactor.operators.panel import densify, forward_return
from loomfactor.plans.compile import evaluate
from loomfactor.plans.expressions import Expr, Limits, Validator, canonical, parse
from loomfactor.plans.shared import MOST, Store, choose
from loomfactor.sources import panels
from loomfactor.sources.store import ResultStore, run_id, top_k
from loomfactor.sources.tables import write_report

#: Figures of a result, in the order of the store.
FIGURES = (
    "coverage usable_days mean_ic icir mean_rank_ic rank_icir positive_rank_ic_ratio turnover_proxy quantile_spread "
    "train_mean_rank_ic train_rank_icir test_mean_rank_ic test_rank_icir score"
).split()


@dataclass(frozen=True)
class Config:
    fields: tuple[str, ...] = tuple(PUBLIC)
    windows: tuple[int, ...] = (10, 20, 30, 40, 50)
    limits: Limits = Limits()
    horizon: int = 5
    least: int = 30
    least_spread: int = 50
    train_end: str | None = None
    test_start: str | None = None
    batch: int = 64
    checkpoint: float = 0.05
    top_checkpoint: int = 50
    top: int = 100
    #: Columns of sub-expressions that are kept for later batches at most.
    shared: int = MOST


@dataclass(frozen=True)
class Planned:
    """An expression, its key, and why it will not be scored, or OK."""

    expr: str
    key: str
    status: str
    tree: Expr | None = None


def plan(expressions: list[str], config: Config) -> list[Planned]:
    """Every expression once by its key. One that cannot be read is a row like any other, under its own text."""
    validator, seen = Validator(set(config.fields), config.windows, config.limits), {}
    for text in expressions:
        try:
            tree = parse(text)
            found = Planned(text, canonical(tree), validator.check(tree), tree)
        except ValueError as e:
            found = Planned(text, text.strip(), str(e))
        seen.setdefault(found.key, found)
    return list(seen.values())


def base_panel(features: DataFrame, config: Config) -> DataFrame:
    """The dense panel that all batches start from, with forward returns."""
    fields = [f for f in config.fields if f in features.columns]
    return densify(features, [*fields, "close"]).withColumn("fwd", forward_return(config.horizon))


def score(base: DataFrame, planned: list[Planned], config: Config, given: dict[str, str] | None = None, days: int = metrics.DAYS) -> DataFrame:
    """(expr, canonical, status, figures) of valid expressions, compiled together and scored in one pass over their values.
    An expression whose figures cannot be computed has the error as its status. days: dates of a group, of which a task holds one at a time."""
    names = {f"e{i:05d}": p for i, p in enumerate(planned)}
    wide = evaluate(base, {n: p.tree for n, p in names.items()}, ["fwd"], given)
    scored = metrics.cross_sections(wide, list(names), config.least, days=days)
    found = metrics.summarise(scored, config.least, config.train_end, config.test_start, config.least_spread)
    known = base.sparkSession.createDataFrame([(n, p.expr, p.key) for n, p in names.items()], "expr_id string, expr string, canonical string")
    failed = F.col("error").isNotNull()
    status = F.when(failed, F.concat(F.lit("EVAL_ERROR:"), F.substring("error", 1, 200))).otherwise("OK")
    figures = [F.when(~failed, F.col(c)).alias(c) for c in FIGURES]
    return F.broadcast(known).join(found, "expr_id").select("expr", "canonical", status.alias("status"), *figures)


def refused(spark: SparkSession, planned: list[Planned]) -> DataFrame:
    """Rows of expressions that are not scored."""
    rows = spark.createDataFrame([(p.expr, p.key, p.status) for p in planned], "expr string, canonical string, status string")
    return rows.select("*", *[F.lit(None).cast("long" if c == "usable_days" else "double").alias(c) for c in FIGURES])


def results(features: DataFrame, expressions: list[str], config: Config) -> DataFrame:
    """One row for each distinct expression: its figures, or the status that says why it has none."""
    planned = plan(expressions, config)
    bad = [p for p in planned if p.status != "OK"]
    good = [p for p in planned if p.status == "OK"]
    out = refused(features.sparkSession, bad)
    return out.unionByName(score(base_panel(features, config), good, config)) if good else out


#: Times a batch is tried again when executors, and not its expressions, were lost.
RETRIES = 2
#: What Spark says of failures that come from the cluster. Fixed values.
_LOST = re.compile(r"ExecutorLostFailure|FetchFailed|executor \S+ exited|Executor heartbeat timed out|Worker lost|decommission|No space left on device|OutOfMemoryError")


def lost(error: Exception) -> bool:
    """Whether a job failed with the machines it ran on, so that the same batch may well succeed later."""
    return _LOST.search(str(error)) is not None


def _said(error: Exception) -> str:
    """The first line that names the cause."""
    cause = getattr(error, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    text = (str(cause.getMessage()) if cause is not None else str(error)).strip()
    name = str(cause.getClass().getSimpleName()) if cause is not None else type(error).__name__
    return f"{name}:{(text.splitlines() or [''])[0][:200]}"


def _store(
    keep: Callable[[DataFrame], None], panel: Callable[[list[Planned]], tuple[DataFrame, dict[str, str]]], planned: list[Planned], config: Config
) -> None:
    """Score a batch and keep it. If its job fails for what its expressions are, its halves are tried, so that only what fails
    gets an error row; if machines were lost, it is tried again and, failing that, the error is raised: no row says that
    an expression failed that did not. A later run takes up what is left."""
    if not planned:
        return
    base, given = panel(planned)
    for left in range(RETRIES, -1, -1):
        try:
            return keep(score(base, planned, config, given))
        except (PySparkException, Py4JJavaError) as e:
            if lost(e):
                if not left:
                    raise
                continue
            if len(planned) > 1:
                for half in (planned[: len(planned) // 2], planned[len(planned) // 2 :]):
                    _store(keep, panel, half, config)
                return
            failed = Planned(planned[0].expr, planned[0].key, f"EVAL_ERROR:{_said(e)}")
            return keep(refused(base.sparkSession, [failed]))


def _marks(total: int, batch: int, step: float) -> Iterator[tuple[int, float | None]]:
    """(end of each batch, share at which a checkpoint is due after it): first at 2 %, then at multiples of step."""
    due = 0.02
    for end in range(min(batch, total), total + batch, batch):
        end = min(end, total)
        share = end / total
        yield end, share if share >= due else None
        if share >= due:
            due = max(step, (int(share / step) + 1) * step)
        if end == total:
            return


def _sources(features: DataFrame) -> list[str]:
    """Names of the files that the features are read from: other data is another run."""
    return sorted(features.inputFiles())


def run(features: DataFrame, expressions: list[str], config: Config, out: str, **named: object) -> dict:
    """Score all expressions that the store under ``out`` has not got yet, and write raw rows, expressions, results, the
    best of them, checkpoints and a summary. The run is named by its configuration, by the files its features come from and by
    what named says of the data; the same run goes on where it was stopped.

    The dense panel is kept as a table bucketed by code, and beside it the sub-expressions that several batches read: each of
    them is computed once in a run."""
    spark = features.sparkSession
    name = run_id(asdict(config) | {"files": _sources(features)} | named)
    store = ResultStore(spark, f"{out}/results")
    features.write.mode("overwrite").parquet(f"{out}/raw")
    raw = spark.read.parquet(f"{out}/raw")
    sizes = raw.agg(F.count("*").alias("n_raw_rows"), F.countDistinct("trade_date").alias("n_dates"), F.countDistinct("code").alias("n_codes")).first()
    planned = plan(expressions, config)
    _lines(spark, [p.expr for p in planned], f"{out}/expressions")
    wanted = spark.createDataFrame([(p.key,) for p in planned], "canonical string")
    left = {r.canonical for r in store.remaining(name, wanted).collect()}
    todo = [p for p in planned if p.key in left]
    keep = lambda rows: store.upsert(rows.withColumn("run_id", F.lit(name)))
    if bad := [p for p in todo if p.status != "OK"]:
        keep(refused(spark, bad))
    marks = list(_marks(len(todo), config.batch, config.checkpoint)) if todo else []
    ends = [0, *(end for end, _ in marks)]
    batches = [[p for p in todo[i:j] if p.status == "OK"] for i, j in zip(ends, ends[1:])]
    held = f"panel_{uuid.uuid4().hex}"
    with panels.co_located(spark):
        try:
            # Written once: the batches read the dense panel, not the features.
            base = panels.save(base_panel(raw, config), held, f"{out}/kept/{held}")
            shared = Store(base, f"{out}/kept").build(choose([[p.tree for p in batch] for batch in batches], config.shared))
            for (_, share), batch in zip(marks, batches):
                _store(keep, lambda some: shared.panel([p.tree for p in some]), batch, config)
                if share is not None:
                    write_report(top_k(store.all(name), config.top_checkpoint), f"{out}/checkpoints/top{config.top_checkpoint}_pct_{share:.0%}")
            shared.release()
        finally:
            panels.drop(spark, held, f"{out}/kept/{held}")
    store.compact(name)
    found = store.all(name)
    write_report(found, f"{out}/factor_results")
    write_report(top_k(found, config.top), f"{out}/top{config.top}")
    summary = sizes.asDict() | {"run_id": name, "n_exprs": len(planned), "n_results": found.count(), "n_resumed": len(planned) - len(todo), "features": list(config.fields)}
    spark.createDataFrame([summary]).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return summary


def _lines(spark: SparkSession, texts: list[str], path: str) -> None:
    rows = spark.createDataFrame([(i, f"{i}\t{e}") for i, e in enumerate(texts, 1)], "i int, value string")
    rows.orderBy("i").select("value").coalesce(1).write.mode("overwrite").text(path)
