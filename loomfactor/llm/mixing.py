"""Mixing to target weights: soft domain membership and document rates by projected-gradient least squares.

A naive Bayes classifier, counted over at most ``max_rows`` labelled documents in hashed word buckets, gives each document a
posterior over domains from its mean log-likelihood (sharpened by ``sharp`` words, so membership stays soft).
Rates r >= 0 then minimise the squared distance between the expected domain totals sum_i r_i m_i p_i (m: share of
all tokens, p: posterior) and the targets, starting from r = 1. A step moves every rate against the gradient
p_i . (G^-1 residual), G the Gram matrix of the posteriors, and projects it on r >= 0. As a rate is a function of
its document's posterior and the residuals so far, a step is one aggregation that returns one number a domain.
If the residual is not below the tolerance after ``steps`` steps, or grows, proximal Newton steps on the dual go on from
the best one, which have the same form, until it is or no longer falls: targets that no rates can meet are met as nearly
as possible, with a warning that gives the residual left. Texts are read and scored once.

Defined results: a null or empty text has no tokens and the prior as its posterior; ids labelled more than once
count each label; domains without labelled rows get no target; with no labels at all every rate is 1 and posteriors are
empty; repeated rows each return a row; an empty table returns no rows; other columns are passed on, but those named
tokens, p or rate, which are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.common import materialize, small_batches
from loomfactor.llm.toxicity import word_hashes

BUCKETS = 1 << 15


def _words_of(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for text in batch.column(column).to_pylist():
        yield (word_hashes(text) % BUCKETS).astype(np.int64)


def sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows labelled ids, those of the smallest hashes: few enough to be broadcast, so no text moves."""
    return labels.select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_rows)


def bucket_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(domain, bucket, n) over the documents labelled: at most domains * BUCKETS rows."""
    labelled = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            domains = batch.column(0).to_pylist()
            sums: dict[str, np.ndarray] = {}
            for d, w in zip(domains, _words_of(batch, 1)):
                sums.setdefault(d, np.zeros(BUCKETS, np.int64))
                sums[d] += np.bincount(w, minlength=BUCKETS)
            for d, n in sums.items():
                at = np.flatnonzero(n)
                cols = [pa.array([d] * len(at), pa.string()), pa.array(at), pa.array(n[at])]
                yield pa.RecordBatch.from_arrays(cols, ["domain", "bucket", "n"])

    return labelled.mapInArrow(run, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each bucket by domain, log prior)."""
    counts = np.ones((len(domains), BUCKETS))
    known = labels.filter(F.col("domain").isin(domains))
    rows = bucket_counts(docs, sample(known, max_rows)).toArrow()
    for d, b, n in zip(*(c.to_pylist() for c in rows.columns)):
        counts[domains.index(d), b] += n
    seen = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = np.log(np.array([seen.get(d, 0) + 1.0 for d in domains]))
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return logs, prior - np.logaddexp.reduce(prior)


def with_posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], sharp: float) -> DataFrame:
    """docs with tokens (long) and p (array of posteriors in the order of domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields]
    names = [f.name for f in fields] + ["tokens", "p"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens long, p array<double>"
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = shared.value
        for batch in small_batches(batches, "text"):
            sizes, p = [], []
            for w in _words_of(batch, text_at):
                x = prior + (sharp * logs[:, w].mean(axis=1, dtype=np.float64) if len(w) else 0.0)
                sizes.append(len(w))
                p.append(np.exp(x - np.logaddexp.reduce(x)).tolist() if len(x) else [])
            extra = [pa.array(sizes, pa.int64()), pa.array(p, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names)

    return docs.mapInArrow(run, schema)


#: Domains of the query and the pipeline are pairs of labels; weights that the mix of tokens should have.
TARGETS = {"q1t0": 0.90, "q0t0": 0.08, "q1t1": 0.015, "q0t1": 0.005}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled rows."""
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    return labels.select("doc_id", name.alias("domain"))


def _moved(rate, y: np.ndarray):
    """A rate after one step, projected on r >= 0."""
    return F.greatest(F.lit(0.0), rate - sum((F.col("p")[i] * float(v) for i, v in enumerate(y)), F.lit(0.0)))


def _rate(history: list[np.ndarray]):
    """The rate of a document after the steps so far."""
    return reduce(_moved, history, F.lit(1.0))


def finish(rows: DataFrame, want: np.ndarray, tolerance: float, rounds: int = 30) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, residual) that bring rows (tokens, p, rate) to the least squared residual from their present rates.

    Each step y makes a rate max(0, rate - p . y), where y minimises a convex function whose gradient is want -
    totals + eps y. Newton's method with halved steps finds it, one aggregation for each y that is tried. Rates that have not
    settled after so many rounds are those of the round with the least residual.
    """
    k = len(want)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    all_tokens = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    if not all_tokens:
        return [], np.zeros(k)

    def at(rate, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(half the squared rates, totals, Gram matrix of the rows with a rate above zero) after y."""
        read = rows.select("tokens", "p", _moved(rate, y).alias("r"))
        t = F.col("tokens") / all_tokens
        sums = [F.sum(t * F.col("r") * F.col("p")[i]) for i in range(k)]
        gram = [F.sum(F.when(F.col("r") > 0, t * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)) for i, j in pairs]
        half, *out = read.agg(F.sum(t * F.col("r") * F.col("r")) / 2, *sums, *gram).first()
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, out[k:]):
            h[i, j] = h[j, i] = v
        return half, np.array(out[:k]), h

    rate, history, before = F.col("rate"), [], None
    best, left, nearest = 0, np.inf, np.zeros(k)
    half, got, h = at(rate, np.zeros(k))
    eps = 1e-6 * max(np.trace(h) / k, 1e-3)
    for _ in range(rounds):
        residual = got - want
        if np.abs(residual).max() < left:
            best, left, nearest = len(history), np.abs(residual).max(), residual
        still = before is not None and np.abs(residual - before).max() < tolerance
        if still or np.abs(residual).max() < tolerance:
            return history[:best], nearest
        before, y = residual, np.zeros(k)
        for _ in range(60):
            g = want - got + eps * y
            if np.abs(g).max() < tolerance / 10:
                break
            step, value = -np.linalg.solve(h + eps * np.eye(k), g), half + y @ want + eps * (y @ y) / 2
            size = 1.0
            while True:
                tried = y + size * step
                half, got, h = at(rate, tried)
                now = half + tried @ want + eps * (tried @ tried) / 2
                if now <= value + 1e-4 * size * (g @ step) + 1e-12 * (1 + abs(value)) or size < 1e-6:
                    break
                size /= 2
            y = tried
        history.append(y)
        rate = _moved(rate, y)
    if np.abs(got - want).max() < left:
        return history, got - want
    return history[:best], nearest


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    sharp: float = 20.0,
    steps: int = 30,
    tolerance: float = 1e-6,
    max_rows: int = 16_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of docs (its columns named by keep, or all) with tokens, p and rate: expected domain totals of tokens * rate * p
    match the targets.

    labels: (doc_id, domain). targets: domain -> weight, of those that have labelled rows; they are scaled to sum
    to 1, and the mix keeps the number of tokens of docs.
    """
    keep = [c for c in keep or docs.columns if c not in ("tokens", "p", "rate")]
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(list(targets)))
    domains = sorted(r.domain for r in labels.select("domain").distinct().collect())
    model = fit(docs, labels, domains, max_rows) if domains else (np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    rows = docs.drop("tokens", "p", "rate")
    scored = materialize(with_posteriors(rows, model, sharp).select(*keep, "tokens", "p"))
    if not domains:
        return scored.withColumn("rate", F.lit(1.0))
    k = len(domains)
    want = np.array([targets[d] for d in domains])
    want = want / want.sum()

    def totals(history: list[np.ndarray]) -> np.ndarray:
        read = scored.select("tokens", "p", _rate(history).alias("r"))
        out = read.agg(*[F.sum(F.col("tokens") * F.col("r") * F.col("p")[i]) for i in range(k)]).first()
        return np.array([x or 0.0 for x in out]) / tokens

    gram = [F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
    tokens, *gram = (float(x or 0) for x in scored.agg(F.sum("tokens"), *gram).first())
    if not tokens:
        return scored.withColumn("rate", F.lit(1.0))
    inverse = np.linalg.inv(np.array(gram).reshape(k, k) / tokens + 1e-9 * np.eye(k))
    history: list[np.ndarray] = []
    best, left = 0, np.inf
    for _ in range(steps):
        residual = totals(history) - want
        if np.abs(residual).max() >= left:  # a step that gains nothing ends the descent
            break
        best, left = len(history), np.abs(residual).max()
        if left < tolerance:
            break
        history.append(inverse @ residual)
    history = history[:best]
    if left >= tolerance:
        start = materialize(scored.select("tokens", "p", _rate(history).alias("rate")))
        more, residual = finish(start, want, tolerance)
        history += more
        if np.abs(residual).max() >= tolerance:
            warnings.warn(f"no rates meet the targets of {domains}; residual {residual.tolist()}", stacklevel=2)
    return scored.withColumn("rate", _rate(history))
