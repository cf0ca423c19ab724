"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], the interactions of all pairs of
features in time linear in their number. Features of a document: its distinct words, hashed, each with
x = 1 / sqrt(number of distinct words); and one feature for each structure statistic (shares of character
kinds, repetition of words, words of a line, marks at word ends, ...) and for the text's size as metadata:
the interval, between quantiles of the sample, that the statistic lies in, with x = 1. So pairs of intervals,
and of intervals and words, have weights of their own.

Fitted with Adagrad on the logistic loss over the bounded sample of labelled.sample; a logistic function of
the machine's raw score, fitted on a part that the machine did not see, makes scores probabilities.

Defined cases: a text without words has no word features and lies in the intervals of its zeros; null counts
as empty; without labels of both kinds every document gets the same score, the smoothed share of good labels;
repeated documents get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, texts, work

THRESHOLD = 0.3
BITS, RANK, BINS = 17, 6, 12
SCORES = "doc_id long, score double"

_KINDS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (32, 9),
    "line": (10, 13),
    "stop": (33, 46, 63),
    "comma": (44, 58, 59),
    "bar": (124, 95, 61, 126),
    "sign": (35, 36, 37, 38, 42, 43, 64, 94),
    "bracket": (40, 41, 60, 62, 91, 93, 123, 125, 47, 92),
    "high": range(128, 256),
}
_CLASS = np.zeros((len(_KINDS), 256), np.float32)
for _k, _bytes in enumerate(_KINDS.values()):
    _CLASS[_k, list(_bytes)] = 1


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def statistics(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, word: np.ndarray, distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(documents, statistics) of one run of documents."""
    docs = len(off) - 1
    size, n = np.diff(off), np.diff(first)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
    doc_of_byte = np.repeat(np.arange(docs), size)
    histogram = np.bincount(doc_of_byte * 256 + buf, minlength=docs * 256).reshape(docs, 256).astype(np.float32)
    shares = (histogram @ _CLASS.T) * per_byte[:, None]
    p = histogram * per_byte[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-9))).sum(1)
    long = (ends - starts).astype(np.float64)
    same = np.zeros(len(word))
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][n > 0]] = 0
    second = np.zeros(len(word))
    second[2:] = word[2:] == word[:-2]
    mean = _sums(long, first) * per_word
    spread = np.sqrt(np.maximum(_sums(long * long, first) * per_word - mean * mean, 0))
    lines = histogram[:, 10]
    return np.column_stack([shares, entropy, np.log1p(size), np.log1p(n), mean, spread, _sums(same, first) * per_word, _sums(second, first) * per_word, distinct * per_word, most * per_word, n / (lines + 1), histogram.max(1) * per_byte, (histogram > 0).sum(1)])


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed distinct words of all documents, where each document's begin, and the statistics."""
    _, starts, ends, first = texts.words(buf, off)
    word = texts.hashes(texts.WORD[buf], starts, ends)
    docs = len(off) - 1
    key = (np.repeat(np.arange(docs, dtype=texts.U), np.diff(first)) << texts.U(BITS)) | (word >> texts.U(64 - BITS))
    own, count = np.unique(key, return_counts=True)
    doc = (own >> texts.U(BITS)).astype(np.int64)
    begin = np.searchsorted(doc, np.arange(docs + 1))
    most = np.zeros(docs)
    some = begin[1:] > begin[:-1]
    if some.any():
        most[some] = np.maximum.reduceat(count, begin[:-1][some])
    stats = statistics(buf, off, starts, ends, first, word, np.diff(begin), most)
    return (own & texts.U((1 << BITS) - 1)).astype(np.int64), begin, stats


@dataclass
class Machine:
    edges: np.ndarray  # (statistics, BINS - 1)
    bias: float
    weights: np.ndarray  # words, then the intervals of each statistic
    vectors: np.ndarray  # (the same, RANK)
    slope: np.ndarray  # logistic function of the raw score
    constant: float | None = None

    def intervals(self, stats: np.ndarray) -> np.ndarray:
        """Table index of each statistic's interval."""
        base = (1 << BITS) + BINS * np.arange(stats.shape[1])
        return np.stack([np.searchsorted(e, stats[:, k]) + base[k] for k, e in enumerate(self.edges)], 1)

    def raw(self, words: np.ndarray, begin: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums of vectors that their interactions come from."""
        x = 1 / np.sqrt(np.maximum(np.diff(begin), 1))
        docs = len(x)
        linear, both, squares = np.zeros(docs), np.zeros((docs, RANK)), np.zeros((docs, RANK))
        some = begin[1:] > begin[:-1]
        if some.any():
            v = self.vectors[words]
            linear[some] = np.add.reduceat(self.weights[words], begin[:-1][some]) * x[some]
            both[some] = np.add.reduceat(v, begin[:-1][some]) * x[some, None]
            squares[some] = np.add.reduceat(v * v, begin[:-1][some]) * (x * x)[some, None]
        u = self.vectors[bins]
        linear += self.weights[bins].sum(1)
        both += u.sum(1)
        squares += (u * u).sum(1)
        return self.bias + linear + 0.5 * (both * both - squares).sum(1), both

    def probability(self, words: np.ndarray, begin: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(begin) - 1, self.constant)
        raw, _ = self.raw(words, begin, self.intervals(stats))
        return 1 / (1 + np.exp(-np.clip(self.slope[0] + self.slope[1] * raw, -30, 30)))


def fit(sample: pd.DataFrame, epochs: int = 12, batch: int = 128) -> Machine:
    """Fit on the driver, on the bounded sample."""
    label = sample["label"].to_numpy(np.int64)
    n = np.bincount(label, minlength=2)[:2]
    size = 1 << BITS
    if n.min() < 5:
        return Machine(np.zeros((0, 0)), 0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(2), float((n[1] + 0.5) / (n.sum() + 1)))
    buf, off = texts.buffer(pa.array(sample["text"], pa.string()))
    parts = [_features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in texts.slices(off)]
    words = np.concatenate([p[0] for p in parts])
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    stats = np.concatenate([p[2] for p in parts])
    docs = np.arange(len(label))
    seen, rest = docs[docs % 5 != 4], docs[docs % 5 == 4]
    edges = np.quantile(stats[seen], np.arange(1, BINS) / BINS, axis=0).T
    rng = np.random.default_rng(7)
    total = size + BINS * stats.shape[1]
    m = Machine(edges, float(np.log(n[1] / n[0])), np.zeros(total), rng.normal(0, 0.02, (total, RANK)), np.array([0.0, 1.0]))
    bins = m.intervals(stats)
    sw, sv, rate, ridge = np.full(total, 1e-2), np.full((total, RANK), 1e-2), 0.08, 2e-3
    for _ in range(epochs):
        order = rng.permutation(seen)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            count = begin[own + 1] - begin[own]
            b = np.concatenate([[0], np.cumsum(count)])
            w = words[np.repeat(begin[own] - b[:-1], count) + np.arange(b[-1])]
            raw, both = m.raw(w, b, bins[own])
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[own]
            x = np.concatenate([np.repeat(1 / np.sqrt(np.maximum(count, 1)), count), np.ones(len(own) * bins.shape[1])])
            doc = np.concatenate([np.repeat(np.arange(len(own)), count), np.repeat(np.arange(len(own)), bins.shape[1])])
            idx = np.concatenate([w, bins[own].reshape(-1)])
            flat, inv = np.unique(idx, return_inverse=True)
            gx = g[doc] * x
            gw = np.bincount(inv, gx, len(flat)) / len(own) + ridge * m.weights[flat] / len(docs) * len(own)
            pull = gx[:, None] * (both[doc] - m.vectors[idx] * x[:, None])
            gv = np.stack([np.bincount(inv, pull[:, k], len(flat)) for k in range(RANK)], 1) / len(own) + ridge * m.vectors[flat] / len(docs) * len(own)
            sw[flat] += gw * gw
            sv[flat] += gv * gv
            m.weights[flat] -= rate * gw / np.sqrt(sw[flat])
            m.vectors[flat] -= rate * gv / np.sqrt(sv[flat])
            m.bias -= rate * g.mean()
    if len(np.unique(label[rest])) == 2:
        count = begin[rest + 1] - begin[rest]
        b = np.concatenate([[0], np.cumsum(count)])
        raw = np.clip(m.raw(words[np.repeat(begin[rest] - b[:-1], count) + np.arange(b[-1])], b, bins[rest])[0], -15, 15)
        x, w = np.stack([np.ones(len(raw)), raw], 1), np.array([0.0, 1.0])
        for _ in range(50):  # Newton steps, pulled towards leaving the raw score as it is
            q = 1 / (1 + np.exp(-x @ w))
            hess = (x * (q * (1 - q))[:, None]).T @ x + np.eye(2)
            w = w + np.clip(np.linalg.solve(hess, x.T @ (label[rest] - q) - (w - [0.0, 1.0])), -1, 1)
        m.slope = w
    return m


def scores(column: pa.Array, machine: Machine) -> np.ndarray:
    buf, off = texts.buffer(column)
    out = [machine.probability(*_features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in texts.slices(off)]
    return np.concatenate([np.zeros(0), *out])


def fitted(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(labelled.sample(docs, labels, "quality"))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score: the probability that a document's label is 1."""
    small = Machine(machine.edges, machine.bias, machine.weights.astype(np.float32), machine.vectors.astype(np.float32), machine.slope, machine.constant)
    work.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(small)  # 4 MB, fixed by BITS and RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), shared.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.documents(spark, sf_dir)
    found = score(docs, fitted(docs, work.table(spark, sf_dir, "labels")))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
