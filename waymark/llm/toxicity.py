"""Toxicity by a linear-chain conditional random field: spans from marginals, documents from their spans.

Two tags, toxic or not, over a text's words. A word's emission is the sum of the weights of its hashed
features (the word, its beginnings of 3 to 6 bytes, its last 4); tags are chained by learnt transitions.
Forward-backward gives each word's marginal; a document's score is a logistic function of the expected number
of toxic words, the largest marginal and the length; words at or over 0.5 are reported as spans.

Labels are given for documents, so words are labelled first: a word of a toxic document is toxic if one of its
features occurs in far more toxic than other documents. The field is fitted to these tags, words are labelled
anew from its marginals, and it is fitted again. A part of the sample that the field did not see fits the
logistic function.

Forward-backward runs over all documents of a batch at once: texts are cut into blocks of words whose 2 x 2
transfer matrices are multiplied in parallel, blocks are stitched along each text, and a second pass fills in
the words; results are exact for texts of any length.

Defined cases: a text without words has expectation and marginal 0 and gets the score of such a text; null
counts as empty; without labels of both kinds every document gets the same score, the smoothed share of toxic
labels; repeated documents get equal scores; an empty table gives no rows; other columns are kept by `clean`.
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

BITS = 20
THRESHOLD = 0.5
_BLOCK = 32
_CLIP = 12.0
SCORES = "doc_id long, score double, starts array<int>, ends array<int>"


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, words) table indexes; number of words before each document; starts and ends of words in bytes."""
    low, starts, ends, first = texts.words(buf, off)
    up, down = texts.powers(len(low) + 1)
    total = np.zeros(len(low) + 1, texts.U)
    np.cumsum((low.astype(texts.U) + texts.U(1)) * up[: len(low)], out=total[1:])
    spans = [(starts, ends)] + [(starts, np.minimum(starts + k, ends)) for k in (3, 4, 5, 6)] + [(np.maximum(ends - 4, starts), ends)]
    rows = []
    for kind, (a, b) in enumerate(spans):
        h = (total[b] - total[a]) * down[a] + texts.U(kind * 0x51ED270B + 1)
        rows.append((texts.mixed(h) >> texts.U(64 - BITS)).astype(np.int32))
    return np.stack(rows), first, starts, ends


@dataclass
class Field:
    """A fitted field and the logistic function over its documents."""

    weights: np.ndarray  # 2**BITS
    transitions: np.ndarray  # 2 x 2, logs
    logistic: np.ndarray  # of (1, log expected number, logit of the largest marginal, log words)
    constant: float | None = None

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[feats].sum(0, dtype=np.float64), -_CLIP, _CLIP)

    def documents(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each document from the marginals of its words."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(summary(p, first) @ self.logistic, -30, 30)))


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(p)])
    most = np.zeros(len(n))
    if len(p):
        some = n > 0
        most[some] = np.maximum.reduceat(p, first[:-1][some])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(n)), np.log1p(np.maximum(total[first[1:]] - total[first[:-1]], 0)), np.log(most / (1 - most)), np.log1p(n)], 1)


def marginals(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Probability of the toxic tag for each word; with `pairs`, also the expected number of each transition."""
    a00, a01, a10, a11 = np.exp(transitions).reshape(-1)
    n = np.diff(first)
    if not len(e):
        return (e, np.zeros((2, 2))) if pairs else e
    per = -(-n // _BLOCK)
    b_first = np.concatenate([[0], np.cumsum(per)])
    b_doc = np.repeat(np.arange(len(n)), per)
    b_start = first[:-1][b_doc] + (np.arange(b_first[-1]) - b_first[b_doc]) * _BLOCK
    b_len = np.minimum(_BLOCK, first[1:][b_doc] - b_start)
    where = b_start[None, :] + np.minimum(np.arange(_BLOCK)[:, None], b_len - 1)
    real = np.arange(_BLOCK)[:, None] < b_len
    psi = np.exp(e)[where]
    # Transfer matrices of whole blocks.
    blocks = len(b_doc)
    m00, m01, m10, m11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(_BLOCK):
        on = real[t]
        x00, x01 = m00 * a00 + m01 * a10, (m00 * a01 + m01 * a11) * psi[t]
        x10, x11 = m10 * a00 + m11 * a10, (m10 * a01 + m11 * a11) * psi[t]
        m00, m01, m10, m11 = np.where(on, x00, m00), np.where(on, x01, m01), np.where(on, x10, m10), np.where(on, x11, m11)
    # Stitched along each document: state before each block, and what follows after it.
    f0, f1, g0, g1 = np.ones(blocks), np.zeros(blocks), np.ones(blocks), np.ones(blocks)
    order = np.argsort(-per, kind="stable")
    live = [int((per > k).sum()) for k in range(1, int(per.max()))]
    for k, count in enumerate(live, 1):
        to = b_first[:-1][order[:count]] + k
        at = to - 1
        x0, x1 = f0[at] * m00[at] + f1[at] * m10[at], f0[at] * m01[at] + f1[at] * m11[at]
        s = x0 + x1
        f0[to], f1[to] = x0 / s, x1 / s
    ends = b_first[1:][order] - 1
    for k, count in enumerate(live, 1):
        at = ends[:count] - k
        up = at + 1
        x0, x1 = m00[up] * g0[up] + m01[up] * g1[up], m10[up] * g0[up] + m11[up] * g1[up]
        s = x0 + x1
        g0[at], g1[at] = x0 / s, x1 / s
    # Inside the blocks.
    alpha = np.empty((2, _BLOCK, blocks))
    c0, c1 = f0, f1
    for t in range(_BLOCK):
        x0, x1 = c0 * a00 + c1 * a10, (c0 * a01 + c1 * a11) * psi[t]
        s = x0 + x1
        c0, c1 = np.where(real[t], x0 / s, c0), np.where(real[t], x1 / s, c1)
        alpha[0, t], alpha[1, t] = c0, c1
    p = np.empty((_BLOCK, blocks))
    count = np.zeros((2, 2))
    d0, d1 = g0, g1
    for t in range(_BLOCK - 1, -1, -1):
        on = real[t]
        x0, x1 = alpha[0, t] * d0, alpha[1, t] * d1
        p[t] = x1 / (x0 + x1)
        if pairs:
            q0, q1 = (alpha[0, t - 1], alpha[1, t - 1]) if t else (f0, f1)
            j = np.stack([q0 * a00 * d0, q0 * a01 * psi[t] * d1, q1 * a10 * d0, q1 * a11 * psi[t] * d1])[:, on]
            count += (j / j.sum(0)).sum(1).reshape(2, 2)
        y0, y1 = a00 * d0 + a01 * psi[t] * d1, a10 * d0 + a11 * psi[t] * d1
        s = y0 + y1
        d0, d1 = np.where(on, y0 / s, d0), np.where(on, y1 / s, d1)
    out = np.empty(len(e))
    out[where[real]] = p[real]
    return (out, count) if pairs else out


def _fit_field(feats: np.ndarray, first: np.ndarray, tags: np.ndarray, use: np.ndarray, start: Field | None, epochs: int = 4, batch: int = 128) -> Field:
    """Adagrad on the log-likelihood of the tags, over the documents in `use`."""
    field = Field(np.zeros(1 << BITS, np.float32), np.array([[0.0, -4.0], [0.0, -2.0]]), np.zeros(4)) if start is None else start
    squares, squares_t = np.full(1 << BITS, 1e-2), np.full((2, 2), 1.0)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(use)
        for lo in range(0, len(order), batch):
            docs = np.sort(order[lo : lo + batch])
            n = first[docs + 1] - first[docs]
            words = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.concatenate([[0], np.cumsum(n)])
            f, y = feats[:, words], tags[words]
            p, expected = marginals(field.emissions(f), own, field.transitions, pairs=True)
            g = y - p
            flat, inverse = np.unique(f, return_inverse=True)
            grad = np.bincount(inverse.reshape(-1), np.tile(g, len(f)), len(flat)) - 1e-3 * field.weights[flat]
            squares[flat] += grad * grad
            field.weights[flat] += (0.5 * grad / np.sqrt(squares[flat])).astype(np.float32)
            before = np.zeros(len(y), np.int64)
            before[1:] = y[:-1]
            before[own[:-1][n > 0]] = 0
            seen = np.bincount(before * 2 + y, minlength=4).reshape(2, 2)
            grad_t = (seen - expected) / max(1, len(docs))
            squares_t += grad_t * grad_t
            field.transitions = np.clip(field.transitions + 0.1 * grad_t / np.sqrt(squares_t), -5, 3)
    return field


def _first_tags(feats: np.ndarray, first: np.ndarray, label: np.ndarray, use: np.ndarray) -> np.ndarray:
    """A word of a toxic document is tagged if one of its features is in far more toxic than other documents."""
    doc = np.repeat(np.arange(len(label)), np.diff(first))
    ok = np.isin(doc, use)
    df = np.zeros((2, 1 << BITS))
    for row in feats:
        key = np.unique(doc[ok].astype(np.int64) << BITS | row[ok])
        for kind in (0, 1):
            df[kind] += np.bincount((key & ((1 << BITS) - 1))[label[key >> BITS] == kind], minlength=1 << BITS)
    n = np.bincount(label[use], minlength=2)
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    strong = (df[1] >= 3) & (odds > 2.5)
    return (strong[feats].any(0) & (label[doc] == 1)).astype(np.int64)


def _in_parts(field: Field, feats: np.ndarray, first: np.ndarray, docs: int = 256) -> np.ndarray:
    """Marginals of all documents, some of them at a time."""
    out = np.empty(feats.shape[1])
    for lo in range(0, len(first) - 1, docs):
        own = first[lo : lo + docs + 1]
        out[own[0] : own[-1]] = marginals(field.emissions(feats[:, own[0] : own[-1]]), own - own[0], field.transitions)
    return out


def fit(sample: pd.DataFrame) -> Field:
    """Fit on the driver, on the bounded sample of labelled.sample."""
    label = sample["label"].to_numpy(np.int64)
    n = np.bincount(label, minlength=2)[:2]
    if n.min() < 5:
        return Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.zeros(4), float(n[1] / (n.sum() + 1)))  # nothing known: nothing is toxic
    buf, off = texts.buffer(pa.array(sample["text"], pa.string()))
    parts = [features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[:2] for lo, hi in texts.slices(off)]
    feats = np.concatenate([f for f, _ in parts], 1)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in parts]))])
    del parts, buf
    docs = np.arange(len(label))
    use = docs[docs % 4 != 3]
    tags = _first_tags(feats, first, label, use)
    doc = np.repeat(docs, np.diff(first))
    field = None
    for _ in range(2):
        has = np.bincount(doc, tags, len(docs)) > 0
        field = _fit_field(feats, first, tags, use[(label[use] == 0) | has[use]], field)
        p = _in_parts(field, feats, first)
        tags = ((p >= 0.5) & (label[doc] == 1)).astype(np.int64)
    x = summary(p, first)
    rest = docs[docs % 4 == 3]
    if len(np.unique(label[rest])) < 2:
        rest = docs
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x[rest] @ w, -30, 30)))
        hess = (x[rest] * (q * (1 - q))[:, None]).T @ x[rest] + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hess, x[rest].T @ (label[rest] - q) - 0.05 * w), -2, 2)
    field.logistic = w
    return field


def _scored(column: pa.Array, field: Field):
    """For runs of documents: first, scores, and of words at or over 0.5 the document and code-point spans."""
    buf, off = texts.buffer(column)
    for lo, hi in texts.slices(off):
        own, part = off[lo : hi + 1] - off[lo], buf[off[lo] : off[hi]]
        feats, first, starts, ends = features(part, own)
        p = marginals(field.emissions(feats), first, field.transitions) if field.constant is None else np.zeros(feats.shape[1])
        hot = np.flatnonzero(p >= 0.5)
        doc = np.searchsorted(first, hot, "right") - 1
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)]) if len(hot) else np.zeros(len(part) + 1, np.int64)
        base = points[own[doc]] if len(hot) else hot
        yield lo, field.documents(p, first), doc, points[starts[hot]] - base, points[ends[hot]] - base


def fitted(docs: DataFrame, labels: DataFrame) -> Field:
    return fit(labelled.sample(docs, labels, "toxic"))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, starts, ends: the toxic words' places in code points, ends exclusive."""
    work.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 4 MB, fixed by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, scores, doc, starts, ends in _scored(batch.column("text"), shared.value):
                cut = pa.array(np.searchsorted(doc, np.arange(len(scores) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(scores)), pa.array(scores), *lists], names=["doc_id", "score", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORES)


def clean(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all columns."""
    work.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [scores < threshold for _, scores, *_ in _scored(batch.column("text"), shared.value)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.documents(spark, sf_dir)
    found = score(docs, fitted(docs, work.table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws(":", s["starts"], s["ends"])), ",")
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), spans.alias("spans"))
