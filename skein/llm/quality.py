"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed, with the square root of their share as value; and statistics of its form (word
length, repetition, symbols, capitals, digits, lines) and its length as metadata, each put into a bin. The score adds a linear
part and low-rank interactions of all pairs, taken in linear time as half of (square of the sum - sum of the squares).

Only text goes into a score. Null texts count as empty; the empty text has its statistics' bins alone and gets a score like any
other. Without training labels every score is 0.5. Repeated rows come back one each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow, segment_sums, word_table
from .labelled import collect_features, held_out, logistic, training_labels

#: Bins of hashed words, bins of each statistic, rank of the interactions, passes over the sample.
WORD_BINS, STAT_BINS, RANK, EPOCHS = 1 << 16, 24, 4, 6

FEATURE = np.dtype([("bin", "<u4"), ("value", "<f4")])

_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    (_BYTES == 10),
    ((_BYTES > 32) & (_BYTES < 48)) | ((_BYTES > 57) & (_BYTES < 65)) | ((_BYTES > 90) & (_BYTES < 97)) | ((_BYTES > 122) & (_BYTES < 127)),
    (_BYTES == 32) | (_BYTES == 9),
    (_BYTES >= 128),
])


def statistics(column: pa.Array, offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array, pairs: np.ndarray) -> np.ndarray:
    """One row of numbers per text; pairs counts the distinct words of each text."""
    text = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = text.buffers()
    at = np.frombuffer(places, dtype="<i8")[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    size = np.diff(at).astype(float)
    share = [segment_sums(c[raw], at) / np.maximum(size, 1) for c in _CLASSES]
    n = np.diff(offsets).astype(float)
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(float) if len(distinct) else np.zeros(1)
    bare = pc.binary_length(pc.ascii_trim(distinct, "!#$%&*|.,")).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(1)
    marked = (length - bare >= 2).astype(float)
    same = np.concatenate([[0.0], (codes[1:] == codes[:-1]).astype(float)]) if len(codes) else np.zeros(0)
    per_word = [segment_sums(x, offsets) / np.maximum(n, 1) for x in (length[codes], marked[codes], same, (bare[codes] == 0).astype(float))]
    squared = segment_sums(length[codes] ** 2, offsets) / np.maximum(n, 1) - per_word[0] ** 2
    lines = share[2] * size + 1
    return np.stack([*(np.sqrt(s) for s in share), per_word[0] / 16, np.sqrt(np.maximum(squared, 0)) / 12, *(np.sqrt(x) for x in per_word[1:]), pairs / np.maximum(n, 1), np.log2(1 + n) / 16, np.log2(1 + size) / 20, np.log2(1 + n / lines) / 12], axis=1)


def extract(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's features, features) of a batch."""
    offsets, codes, distinct = word_table(column)
    n, words = len(offsets) - 1, max(len(distinct), 1)
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) for w in distinct.to_pylist()), dtype=np.int64, count=len(distinct)) % WORD_BINS
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keys, counts = np.unique(owner * WORD_BINS + hashed[codes], return_counts=True) if len(codes) else (np.zeros(0, np.int64), np.zeros(0))
    mine = keys // WORD_BINS
    each = np.bincount(mine, minlength=n)
    distinct_words = np.bincount(np.unique(owner * words + codes) // words, minlength=n) if len(codes) else np.zeros(n)
    stats = np.clip((statistics(column, offsets, codes, distinct, distinct_words) * STAT_BINS).astype(np.int64), 0, STAT_BINS - 1)
    k = stats.shape[1]
    ends = np.cumsum(each + k)
    out = np.empty(ends[-1] if n else 0, dtype=FEATURE)
    base = np.concatenate([[0], ends])
    at = np.arange(len(keys)) + np.repeat(np.arange(n) * k, each)
    out["bin"][at] = keys % WORD_BINS
    out["value"][at] = np.sqrt(counts / np.diff(offsets)[mine]) if len(keys) else 0
    tail = (ends[:, None] - k + np.arange(k)).ravel()
    out["bin"][tail] = (WORD_BINS + np.arange(k) * STAT_BINS + stats).ravel()
    out["value"][tail] = 1.0 / np.sqrt(k)
    return base, out


def split(column: pa.Array) -> list[np.ndarray]:
    base, out = extract(column)
    return [out[a:z] for a, z in zip(base[:-1], base[1:], strict=True)]


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, base: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of many texts: sums of their features' weights and the sum-of-squares identity, linear in the features."""
        value = x["value"].astype(np.float64)
        parts = np.empty((len(x), 1 + 2 * self.factors.shape[1]))
        vx = self.factors[x["bin"]] * value[:, None]
        k = vx.shape[1]
        parts[:, 0], parts[:, 1 : 1 + k], parts[:, 1 + k :] = self.linear[x["bin"]] * value, vx, vx * vx
        s = segment_sums(parts, base)
        return self.bias + s[:, 0] + 0.5 * (s[:, 1 : 1 + k] ** 2 - s[:, 1 + k :]).sum(axis=1)


def fit(base: np.ndarray, features: np.ndarray, y: np.ndarray, seed: int = 1) -> FactorisationMachine:
    """Stochastic gradient steps on the log loss with a step size for each weight (AdaGrad)."""
    rng = np.random.default_rng(seed)
    n = WORD_BINS + STAT_BINS * 64
    linear, factors = np.zeros(n), rng.normal(0, 0.05, (n, RANK))
    seen_l, seen_f = np.full(n, 1e-2), np.full((n, RANK), 1e-2)
    if not len(y):
        return FactorisationMachine(0.0, linear, np.zeros((n, RANK)))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias, rate_step, shrink = float(np.log(rate / (1 - rate))), 0.1, 2e-5
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            x = features[base[i] : base[i + 1]]
            b, v = x["bin"], x["value"].astype(np.float64)
            f = factors[b]
            vx = f * v[:, None]
            s = vx.sum(axis=0)
            g = logistic(bias + linear[b] @ v + 0.5 * (s @ s - (vx * vx).sum())) - y[i]
            gl = g * v + shrink * linear[b]
            gf = g * (v[:, None] * s - f * (v * v)[:, None]) + shrink * f
            seen_l[b] += gl * gl
            seen_f[b] += gf * gf
            linear[b] -= rate_step * gl / np.sqrt(seen_l[b])
            factors[b] -= 0.5 * rate_step * gf / np.sqrt(seen_f[b])
            bias -= 0.01 * g
    return FactorisationMachine(bias, linear.astype(np.float32), factors.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    model = fit(*collect_features(docs, training_labels(labels, "quality"), split, FEATURE))
    give_back()
    return model


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. No shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = logistic(model.margins(*extract(b.column("text"))))
        return pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
