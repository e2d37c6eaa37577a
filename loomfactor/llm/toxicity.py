"""Toxicity by two class-conditional Kneser-Ney bigram models with a shared backoff.

Discounted bigram counts back off to continuation counts of single words, the number of distinct words (or the
start of a text) that stand before each in any document, labelled or not; discounts and backoff weights come from
counts pooled over both classes, so a rare expression is judged by what both know of it. How a single word's mass is
dealt to the classes is told by counts of documents: numbers of distinct words before it saturate in the larger class
first. A text's evidence is the difference of the two log-likelihoods over its number of words (plus a constant, so
that a few words prove little), and a logistic curve, fitted on texts held out from the counts, turns it into a score
from 0 to 1.

The models learn labels from a sample of at most ``max_rows`` rows and ``max_chars`` characters of each class, taken
in the order of a hash of the id; its words bound what is broadcast. Continuation counts of these words are taken over
the whole texts of all documents, by sketches with a standard error of CONTEXT_ERROR, and are never less than the exact
counts of the sample. Every text is scored whole.

Defined results: a null or empty text has no words and gets the score of no evidence; rows with a null id
or label are not learnt from; ids labelled both ways are learnt as toxic; with no labelled row of one of the
classes every score is the share of toxic rows (0.5 with no rows at all); repeated rows each return a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.common import materialize, small_batches

DISCOUNT = 0.75
#: Standard deviations by which a class's count must differ from its expected share to count at all.
NOISE = 3.0
#: Documents a class that stand for the rates of the level below.
SHRINK = 5.0
#: Standard error of the number of distinct words before a word in all documents.
CONTEXT_ERROR = 0.05
#: Words added to a text's length when its evidence is normalised.
PRIOR_WORDS = 10.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
#: Stands before the first word of a text, and for "any word" in counts of words and of contexts.
_START = xxhash.xxh64_intdigest(b"", 1)
_ALONE = np.uint64(xxhash.xxh64_intdigest(b"", 2))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, lower-cased and without ASCII punctuation."""
    words = (text or "").encode().translate(_WORDS).split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def _before(words: np.ndarray) -> np.ndarray:
    return np.concatenate((np.array([_START], dtype=np.uint64), words[:-1])) if len(words) else words


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first * _MIX ^ second
        return (x ^ (x >> np.uint64(29))) * _MIX


class KneserNey:
    """log P(toxic) - log P(ordinary) of words in context, from counts of documents by class.

    Counts are of documents, not of places, so a document that repeats itself has one voice. The pooled count
    n of a pair is discounted (all of it if 1, else DISCOUNT) and the rest backs off to single words. What is
    left is dealt to the classes by rate: their counts are first discounted towards the share that the pooled
    count makes expected, by NOISE standard deviations, and SHRINK more documents stand for the level below.
    """

    def __init__(self, h: np.ndarray, w: np.ndarray, counts: np.ndarray, joint: np.ndarray | None = None):
        """counts: one row for each (h, w), the documents of class 0 and of class 1. joint: in the rows of single
        words, the number of distinct words before each (without it, documents stand for them)."""
        counts = counts.astype(float)
        pooled = counts.sum(axis=1)
        alone, any_w = h == _ALONE, w == _ALONE
        pair = ~alone & ~any_w & (pooled > 1)
        order = np.argsort(w[alone])
        self.words, single = w[alone][order], counts[alone][order]
        rates = _rates(single, 1.0)
        n = single.sum(axis=1) if joint is None else joint[alone][order].astype(float)
        total = max(n.sum(), 1.0)
        uniform = DISCOUNT * len(self.words) / total / (len(self.words) + 1)
        self.unigram = np.maximum(n - DISCOUNT, 0)[:, None] / total * rates + uniform
        order = np.argsort(h[any_w])
        self.contexts, sums = h[any_w][order], pooled[any_w][order]
        key = _pair(h[pair], w[pair])
        order = np.argsort(key)
        self.pairs, h, w, n = key[order], h[pair][order], w[pair][order], pooled[pair][order]
        at = np.searchsorted(self.contexts, h)
        self.backoff = 1 - np.bincount(at, n - DISCOUNT, len(sums)) / np.maximum(sums, 1)
        below = rates[np.minimum(np.searchsorted(self.words, w), len(rates) - 1)] if len(w) else 1.0
        self.high = ((n - DISCOUNT) / sums[at])[:, None] * _rates(counts[pair][order], below)

    def log_ratio(self, words: np.ndarray) -> float:
        """Sum over the words of a text. A word that neither class has seen says nothing."""
        if not len(words) or not len(self.words):
            return 0.0
        before = _before(words)
        i, known = _find(self.words, words)
        j, met = _find(self.pairs, _pair(before, words))
        k, followed = _find(self.contexts, before)
        p = np.where(followed, self.backoff[k], 1.0)[:, None] * self.unigram[i]
        if len(self.pairs):
            p += np.where(met[:, None], self.high[j], 0.0)
        return float(np.where(known, np.log(p[:, 1] / p[:, 0]), 0.0).sum())

    def evidence(self, text: str | None) -> float:
        words = word_hashes(text)
        return self.log_ratio(words) / (len(words) + PRIOR_WORDS)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def _rates(counts: np.ndarray, below: np.ndarray | float) -> np.ndarray:
    """How much likelier than overall each row is in class 0 and in class 1."""
    total = counts.sum()
    share = counts.sum(axis=0) / max(total, 1.0)
    pooled = counts.sum(axis=1)
    expected = pooled[:, None] * share
    off = counts[:, 1] - expected[:, 1]
    off = np.sign(off) * np.maximum(np.abs(off) - NOISE * np.sqrt(pooled * share[0] * share[1]), 0)
    return (expected + off[:, None] * np.array([-1, 1]) + SHRINK * below) / (expected + SHRINK)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method; targets are drawn in a little so that the slope stays finite."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = x.std() or 1.0
    z, a, b = x / scale, 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0) / scale, float(b)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """(text, label, fold) of the rows to learn from. The ids are bounded by max_rows a class, so they may be
    held by the driver and broadcast; the texts stay on the executors."""
    one = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    spark = docs.sparkSession
    ids = None
    for c in (0, 1):
        part = one.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        ids = part if ids is None else ids.union(part)
    chosen = [(r.doc_id, r.label) for r in ids.collect()]
    wanted = spark.createDataFrame(chosen, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter("doc_id is not null and text is not null").join(F.broadcast(wanted), "doc_id")
    sizes = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.sum(F.length("text")).alias("n")).collect()
    kept, used = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (zlib.crc32(b"%d" % r.doc_id), r.doc_id)):
        if used[r.label] + r.n <= max_chars:
            used[r.label] += r.n
            kept.append((r.doc_id, len(kept) % 2))
    folds = spark.createDataFrame(kept, "doc_id long, fold int")
    return texts.join(F.broadcast(folds), "doc_id").select("text", "label", "fold")


def _distinct(words: np.ndarray) -> np.ndarray:
    """The distinct words and word pairs of a text as (word before, word), and each pair's context."""
    alone = np.unique(words)
    pairs = np.unique(np.stack([_before(words), words], axis=1), axis=0)
    contexts = np.stack([pairs[:, 0], np.full(len(pairs), _ALONE)], axis=1)
    return np.concatenate([np.stack([np.full(len(alone), _ALONE), alone], axis=1), pairs, contexts])


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        texts, label, fold = (c.to_pylist() for c in batch.columns)
        for t, c, k in zip(texts, label, fold):
            words = word_hashes(t)
            if len(words):
                found = _distinct(words)
                cols = [pa.array(found[:, i].copy().view(np.int64)) for i in (0, 1)]
                group = pa.array(np.full(len(found), 2 * k + c, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([group, *cols], ["part", "h", "w"])


def continuations(pairs: DataFrame) -> DataFrame:
    """(h, w, n0 to n3) -> w and the number of distinct words before it in fold 0, in fold 1 and in both."""
    folds = ["n0 + n1", "n2 + n3", "n0 + n1 + n2 + n3"]
    return pairs.groupBy("w").agg(*[F.count_if(F.expr(x) > 0).cast("int").alias(f"c{i}") for i, x in enumerate(folds)])


def corpus_continuations(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(w, n) for each of words (sorted) that occurs: about the number of distinct words before it in all texts. What is
    shuffled is a sketch for each word and task, however often the word occurs; distinct pairs would outgrow the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            said = [word_hashes(t) for t in batch.column(0).to_pylist()]
            w, h = np.concatenate(said), np.concatenate([_before(x) for x in said])
            known = _find(shared.value, w)[1]
            h, w = h[known], w[known]
            once = np.unique(_pair(h, w), return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[once].view(np.int64)) for x in (h, w)], ["h", "w"])

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    pairs = texts.mapInArrow(run, "h long, w long")
    return pairs.groupBy("w").agg(F.approx_count_distinct("h", CONTEXT_ERROR).cast("int").alias("n"))


class Model:
    def __init__(self, kn: KneserNey, slope: float, intercept: float):
        self.kn, self.slope, self.intercept = kn, slope, intercept

    def score(self, text: str | None) -> float:
        x = self.slope * self.kn.evidence(text) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 6_000_000) -> Model:
    """Count on the executors, bring back at most the bigrams of the bounded sample and a continuation count of
    each of its words, calibrate across folds."""
    rows = sample(docs, labels, max_rows, max_chars)
    counted = materialize(
        rows.mapInArrow(_bigrams, "part int, h long, w long")
        .groupBy("h", "w")
        .agg(*[F.count_if(F.col("part") == k).cast("int").alias(f"n{k}") for k in range(4)])
    )
    any_w = F.lit(int(_ALONE.view(np.int64)))
    known = counted.filter((F.expr("n0 + n1 + n2 + n3") > 1) | any_w.isin(F.col("h"), F.col("w"))).toArrow()
    before = continuations(counted.filter(~any_w.isin(F.col("h"), F.col("w")))).select("w", F.col("c2").alias("n"))
    h, w, *parts = (c.to_numpy() for c in known.columns)
    h, w, n = h.view(np.uint64), w.view(np.uint64), np.stack(parts, axis=1)
    # One row for each word of the sample, however many documents are counted.
    everywhere = corpus_continuations(docs, np.sort(w[h == _ALONE]))
    most = before.union(everywhere).groupBy("w").agg(F.max("n").alias("n")).toArrow()
    word, contexts = (c.to_numpy() for c in most.columns)
    order = np.argsort(word.view(np.uint64))
    at, met = _find(word.view(np.uint64)[order], w)
    joint = np.where((h == _ALONE) & met, contexts[order][at], 0) if len(word) else np.zeros(len(w))

    def model(counts: np.ndarray) -> KneserNey:
        seen = counts.sum(axis=1) > 0
        return KneserNey(h[seen], w[seen], counts[seen], joint[seen])

    halves = docs.sparkSession.sparkContext.broadcast([model(n[:, 2:]), model(n[:, :2])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts, _, k = (c.to_pylist() for c in batch.columns)
            x = [halves.value[f].evidence(t) for t, f in zip(texts, k)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.float64())], ["label", "x"])

    y, x = (c.to_numpy() for c in rows.mapInArrow(judge, "label int, x double").toArrow().columns)
    halves.unpersist()
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Model(KneserNey(h[:0], w[:0], n[:0, :2]), 0.0, float(np.log(share / (1 - share))))
    return Model(model(n[:, :2] + n[:, 2:]), *fit_logistic(x, y))


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a column score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), [*docs.columns, "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            s = [shared.value.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(rows, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
