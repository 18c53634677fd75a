"""Quality of texts by ordinal cumulative-link regression on graded ratings.

Method: one weight vector over hashed byte trigrams (and a few shape features) gives a
text's position on a line; ordered thresholds cut the line into grades:
P(grade <= g) = 1 / (1 + exp(position - threshold_g)). Weights and thresholds are fitted
together, by maximum likelihood with a ridge, on a bounded sample (``max_rows``) of rated
training rows. Every text is then scored whole: its expected grade and the probability of
the upper grades, which selection uses.

Grades from ``labels``: 2 * quality + (1 - toxic), that is 0 to 3; grades of 2 or more are
those of good quality.

Defined cases: a null or empty text has no trigrams and is scored as such; a null doc_id
counts as '' in the split; ratings that are null are not learned from; repeated rows are
scored each; without two different grades every text gets the mean grade; an empty table
gives an empty result. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textnum import Words, mix64, slices
from tidemark.llm.toxicity import remainder, sample_labelled

BINS = 4096
GRADES = 4
TAIL = 2
_SHAPE = 6
#: Rows of features in memory at once.
_ROWS = 1024
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram weights (unit length) and shape features of each text."""
    n = len(offsets) - 1
    x = np.zeros((n, BINS + _SHAPE), np.float32)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    if len(data) > 2:
        three = (data[:-2].astype(_U) << _U(16)) | (data[1:-1].astype(_U) << _U(8)) | data[2:]
        same = row[:-2] == row[2:]
        with np.errstate(over="ignore"):
            bins = (mix64((three[same] + _U(1)) * _U(0x9E3779B97F4A7C15)) % _U(BINS)).astype(np.int64)
        tf = np.log1p(np.bincount(row[:-2][same] * BINS + bins, minlength=n * BINS).reshape(n, BINS)).astype(np.float32)
        norm = np.sqrt((tf**2).sum(axis=1, keepdims=True))
        x[:, :BINS] = tf / np.maximum(norm, 1e-6)
    w = Words(data, offsets)
    length = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=mask, minlength=n) / length

    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.doc[order][1:] != w.doc[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n)
    x[:, BINS:] = np.stack(
        [
            np.log1p(w.n) / 8,
            distinct / np.maximum(w.n, 1),
            share((data >= 65) & (data <= 90)),
            share((data > 32) & (data < 128) & ~((data >= 48) & (data <= 57)) & ~((data | 32 >= 97) & (data | 32 <= 122))),
            share((data >= 48) & (data <= 57)),
            share(data == 10),
        ],
        axis=1,
    )
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    prior: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of ``TAIL`` or more) of each text."""
        n = len(offsets) - 1
        if not len(self.thresholds):
            return np.full(n, self.prior), np.full(n, float(self.prior >= TAIL))
        position = features(data, offsets) @ self.weights
        above = 1 - _sigmoid(self.thresholds[None, :] - position[:, None])
        return above.sum(axis=1), above[:, TAIL - 1]


def fit(x: np.ndarray, grade: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 2e-4) -> Model:
    """Maximum likelihood by Adam; thresholds stay ordered, as their gaps are exponentials."""
    prior = float(grade.mean()) if len(grade) else 0.0
    if len(np.unique(grade)) < 2:
        return Model(np.zeros(BINS + _SHAPE, np.float32), np.zeros(0), prior)
    n = len(grade)
    below = np.clip([(grade <= g).mean() for g in range(GRADES - 1)], 0.5 / n, 1 - 0.5 / n)
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-2 * np.arange(GRADES - 1))
    params = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros(len(params)), np.zeros(len(params))
    d = x.shape[1]
    for k in range(1, steps + 1):
        w, cut = params[:d].astype(np.float32), np.cumsum(np.concatenate([params[d : d + 1], np.exp(params[d + 1 :])]))
        position = x @ w
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        upper, lower = _sigmoid(edge[grade + 1] - position), _sigmoid(edge[grade] - position)
        p = np.maximum(upper - lower, 1e-9)
        by_position = (1 - upper - lower) / n  # of the negative log-likelihood
        by_cut = np.bincount(grade, -upper * (1 - upper) / p / n, GRADES)[:-1] + np.bincount(grade, lower * (1 - lower) / p / n, GRADES)[1:]
        by_first = by_cut.sum()
        by_gaps = np.array([by_cut[i:].sum() for i in range(1, GRADES - 1)]) * np.exp(params[d + 1 :])
        g = np.concatenate([x.T @ by_position.astype(np.float32) + ridge * params[:d], [by_first], by_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(params[:d].astype(np.float32), np.cumsum(np.concatenate([params[d : d + 1], np.exp(params[d + 1 :])])), prior)


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Model:
    table = sample_labelled(docs, labels, ["quality", "toxic"], remainder(F.col("rated_id"), 3) != 1, max_rows)
    batch = pa.record_batch([table.column("text").combine_chunks()], names=["text"])
    parts = [features(data, offsets) for _, data, offsets in slices(iter([batch]), most=_ROWS)]
    x = np.concatenate(parts) if parts else np.zeros((0, BINS + _SHAPE), np.float32)
    grade = 2 * table.column("quality").to_numpy().astype(np.int64) + (1 - table.column("toxic").to_numpy().astype(np.int64))
    return fit(x, np.clip(grade, 0, GRADES - 1))


def _scores(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, most=_ROWS):
            expected, tail = model.score(data, offsets)
            yield pa.record_batch([rows.column(0).cast(pa.int64()), pa.array(expected.astype(float)), pa.array(tail.astype(float))], names=["doc_id", "expected_grade", "tail_probability"])

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability and selected of every document."""
    scored = docs.select("doc_id", "text").mapInArrow(_scores(model), "doc_id long, expected_grade double, tail_probability double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least).cast("int").alias("selected"))
