"""Toxicity by maximum-scoring segments (operator 6).

Token weights are log-odds of toxic against other labelled documents, with an
informative Dirichlet prior proportional to the tokens' joint frequency; tokens
that pass a z-threshold keep their weight, all
others count 0. Less a constant drift, the weights of a text form a walk whose
maximal segments (Ruzzo and Tompa, linear time) are its toxic passages. Under
the tokens of clean documents a segment's score has an extreme-value law with
parameter lambda, the positive root of E[exp(lambda s)] = 1; a passage counts
with its log-evidence over ln(K n), n words being searched. A logistic curve of
the summed evidence, fitted on labelled documents, is the score.

Learning uses at most TRAIN_ROWS labelled documents, the first in a hash order;
scoring reads whole texts of all documents.

Edge cases: null and empty texts have no evidence and get the curve's base score.
Repeated label rows count once, the higher label wins; labels without a document
are ignored. Without labels of both kinds every score is 0. Repeated documents
are scored each by itself. An empty table gives no rows. Only key and text are
read, so that other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.llm import folds
from siftgram.functions import kernels as K
from siftgram.functions.sharing import share
from siftgram.llm.shared import materialised, with_types

TRAIN_ROWS = 50_000
PRIOR = 0.2  # pseudo-tokens of the Dirichlet prior, as a share of all tokens counted
DRIFT = 0.5
GUMBEL_K = 0.1
MIN_Z = 3.5


class Lexicon:
    """Weights of informative tokens, sorted by hash, with the null model and the curve."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, decay: float, curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.decay, self.curve = hashes[order], weights[order], decay, curve

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.weights[at], 0.0)


def decay_rate(scores: np.ndarray, p: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; 1.0 where no score is positive."""
    if not (scores[p > 0] > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    while f(hi) < 0:
        hi *= 2
    lo = 1e-6
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def segments(scores: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a walk of positive steps
    `scores` with the (negative) sums `gaps` before each; indices into `scores`."""
    total, parts = 0.0, []  # parts: [first, last, left sum, right sum]
    for i, (s, g) in enumerate(zip(scores, gaps, strict=True)):
        total += g
        part = [i, i, total, total + s]
        total += s
        while True:
            j = len(parts) - 1
            while j >= 0 and parts[j][2] >= part[2]:
                j -= 1
            if j < 0 or parts[j][3] >= part[3]:
                parts.append(part)
                break
            part = [parts[j][0], part[1], parts[j][2], part[3]]
            del parts[j:]
    return [(a, b, r - left) for a, b, left, r in parts]


def passages(words: K.Words, lexicon: Lexicon, drift: float = DRIFT) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word, end word, score) of every maximal segment in a piece."""
    steps = lexicon.of(words.hash) - drift
    sums = np.concatenate([[0.0], np.cumsum(steps)])
    up = np.flatnonzero(steps > 0)
    doc = words.doc[up]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for group in np.split(up, cuts) if len(up) else []:
        d = int(words.doc[group[0]])
        before = np.concatenate([[words.first[d]], group[:-1] + 1])
        gaps = sums[group] - sums[before]
        for a, b, score in segments(steps[group].tolist(), gaps.tolist()):
            yield d, int(group[a]), int(group[b]) + 1, score


def evidence(words: K.Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(summed log-evidence of significant passages, their number) per document."""
    out, n = np.zeros(words.n_docs), np.zeros(words.n_docs)
    floor = np.log(np.maximum(GUMBEL_K * words.counts(), 1.0))
    for d, _, _, score in passages(words, lexicon):
        e = lexicon.decay * score - floor[d]
        if e > 0:
            out[d] += e
            n[d] += 1
    return out, n


def _chance(e: np.ndarray, n: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * np.log1p(e) + curve[2] * np.log1p(n), -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve by iteratively reweighted least squares with a little ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """Learns weights and curve from labelled documents that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~folds.held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).orderBy(folds.order(F.col("k")), "k").limit(rows)
    # bounded by `rows`: two numbers a row
    known = spark.createDataFrame(known.toPandas(), "k " + known.schema["k"].dataType.simpleString() + ", y int")
    read = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k").select("t", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            y = batch.column(1).to_numpy()
            hashes, toxic = [], []
            for i, j, data, offs in K.pieces(batch.column(0)):
                words = K.Words(data, offs, pows)
                hashes.append(words.hash)
                toxic.append(y[i:j][words.doc] > 0)
            if not hashes:
                continue
            h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            t = np.bincount(inverse, weights=np.concatenate(toxic), minlength=len(h)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t), pa.array(n - t)], names=["h", "t", "c"])

    counts = materialised(read.mapInArrow(count, "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "tokens")
    nt, nc = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if not nt or not nc:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    a = PRIOR * (F.col("t") + F.col("c"))
    mass = PRIOR * (nt + nc)
    t, c = F.col("t") + a, F.col("c") + a
    delta = F.log(t / (nt + mass - t)) - F.log(c / (nc + mass - c))
    z = delta / F.sqrt(1 / t + 1 / c)
    # only informative tokens leave the executors
    known = counts.select("h", "c", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= MIN_Z).toArrow()
    h, clean, weight = known["h"].to_numpy().view(np.uint64), known["c"].to_numpy().astype(float), known["delta"].to_numpy()
    p = np.append(clean, nc - clean.sum()) / nc
    lexicon = Lexicon(h, weight, decay_rate(np.append(weight, 0.0) - DRIFT, p))
    shared = share(spark, lexicon)

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, own = K.Powers(), shared()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(0)):
                e, n = evidence(K.Words(data, offs, pows), own)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(n), batch.column(1).slice(i, j - i)], names=["e", "n", "y"])

    got = read.mapInArrow(feature, "e double, n double, y int").toArrow()
    e, n, y = (got[c].to_numpy() for c in ("e", "n", "y"))
    lexicon.curve = _fit(np.column_stack([np.log1p(e), np.log1p(n)]), (y > 0).astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), n_passages, evidence for every document."""
    shared = share(docs.sparkSession, lexicon)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, own = K.Powers(), shared()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                e, n = evidence(K.Words(data, offs, pows), own)
                chance = _chance(e, n, own.curve) if len(own.hashes) else np.zeros(len(e))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(chance), pa.array(n.astype(np.int64)), pa.array(e)], names=["k", "score", "n_passages", "evidence"])

    return narrow.mapInArrow(scan, with_types(narrow, ["k"], "score double, n_passages long, evidence double")).withColumnRenamed("k", key)


def toxic_passages(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, begin, end (characters of the UTF-8 bytes), passage, evidence: every significant passage."""
    shared = share(docs.sparkSession, lexicon)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, own = K.Powers(), shared()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                words = K.Words(data, offs, pows)
                floor = np.log(np.maximum(GUMBEL_K * words.counts(), 1.0))
                found = [(d, int(words.starts[a]), int(words.ends[b - 1]), own.decay * s - floor[d]) for d, a, b, s in passages(words, own)]
                found = [f for f in found if f[3] > 0]
                ks = batch.column(0).slice(i, j - i).take(pa.array([f[0] for f in found], pa.int64()))
                base = [int(offs[f[0]]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [ks, pa.array([f[1] - b for f, b in zip(found, base, strict=True)], pa.int64()), pa.array([f[2] - b for f, b in zip(found, base, strict=True)], pa.int64()),
                     pa.array([data[f[1] : f[2]].tobytes().decode() for f in found], pa.string()), pa.array([f[3] for f in found], pa.float64())],
                    names=["k", "begin", "end", "passage", "evidence"],
                )

    return narrow.mapInArrow(scan, with_types(narrow, ["k"], "begin long, end long, passage string, evidence double")).withColumnRenamed("k", key)
