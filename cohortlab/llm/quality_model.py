"""Quality classifier: regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics of its whole text. Each class has its own mean
and covariance, from sums that Spark adds up over all labelled rows (no sample); the covariance is
shrunk towards the pooled one and that towards its diagonal. A score is the logistic of the difference
of the two Mahalanobis log densities plus the log prior, with Cholesky factors computed once.

Defined cases: null, empty and word-free texts have all statistics zero and get a score like any other;
labels of unknown documents are ignored and a document labelled twice counts twice; without labels of
both classes every score is the prior of class 1 (0.5 without any label); other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import held_out, lists, map_arrow, stored
from cohortlab.llm.words import GRAM, SPACED, Roll, bounds, pieces, same_row

#: Shares of the pooled covariance in a class's, and of the diagonal in the result.
POOL, DIAGONAL = 0.1, 0.05
#: Least variance, in squared units of the transformed statistics.
FLOOR = 1e-4
THRESHOLD = 0.7

_KINDS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 blank, 2 lower or non-ASCII, 3 upper, 4 digit, 5 sentence mark, 6 symbol
_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_KINDS[97:123] = 2
_KINDS[128:] = 2
_KINDS[65:91] = 3
_KINDS[48:58] = 4
_KINDS[[33, 44, 46, 63]] = 5
_KINDS[[35, 36, 37, 38, 42, 60, 62, 64, 92, 94, 95, 123, 124, 125, 126]] = 6
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False
_LINE = Roll(61)

NAMES = ("words", "word_length", "upper", "digits", "marks", "bangs", "symbols", "symbol_words", "lines", "line_words", "repeated_lines",
         "repeated_words", "variety", "entropy", "short_words")


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of each row, positions that repeat an earlier equal value of their row)."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.ones(len(r), dtype=bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[fresh], minlength=n), order[~fresh]


def statistics(texts: pa.Array):
    """Yields (first row, rows x statistics)."""
    for p in pieces(texts, SPACED):
        n, size = p.rows, np.maximum(np.diff(p.offsets), 1).astype(float)
        owner = np.repeat(np.arange(n), np.diff(p.offsets))
        kinds = np.bincount(owner * 7 + _KINDS[p.data], minlength=n * 7).reshape(n, 7).astype(float)
        words = p.count.astype(float)
        some = np.maximum(words, 1)
        length = (p.ends - p.starts).astype(float)
        h = p.hashes()
        distinct, _ = _distinct(p.row, h, n)
        ends_odd = np.bincount(p.row, weights=np.isin(_KINDS[p.data[p.ends - 1]], (6,)), minlength=n)
        bangs = np.bincount(owner, weights=p.data == 33, minlength=n)
        short = np.bincount(p.row, weights=length <= 3, minlength=n)
        start = np.flatnonzero(same_row(p.row, 3))
        gram = GRAM.windows(h, 3)
        _, again = _distinct(p.row[start], gram[start], n) if len(start) else (None, start)
        twice = np.bincount(p.row[start[again]], minlength=n) if len(start) else np.zeros(n)
        ls, le = bounds(_NOT_NEWLINE[p.data], p.offsets)
        lrow = np.searchsorted(p.offsets, ls, side="right") - 1
        lines = np.bincount(lrow, minlength=n).astype(float)
        unlike, _ = _distinct(lrow, _LINE.slices(_LINE.byte[p.data], ls, le), n)
        letters = np.bincount(owner * 64 + (p.data & 63), minlength=n * 64).reshape(n, 64) / size[:, None]
        entropy = -(letters * np.log(np.maximum(letters, 1e-12))).sum(axis=1)
        yield p.first, np.column_stack([
            np.log1p(words), np.log1p(np.bincount(p.row, weights=length, minlength=n) / some), np.sqrt(kinds[:, 3] / size), np.sqrt(kinds[:, 4] / size),
            np.sqrt(kinds[:, 5] / size), np.sqrt(bangs / size), np.sqrt(kinds[:, 6] / size), np.sqrt(ends_odd / some), np.log1p(lines),
            np.log1p(words / np.maximum(lines, 1)), np.sqrt((lines - unlike) / np.maximum(lines, 1)), np.sqrt(twice / some), distinct / some, entropy, short / some])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (the statistics, in the order of NAMES)."""

    def run(batch: pa.RecordBatch):
        for first, x in statistics(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(first, len(x)), lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())], ["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x array<double>")


def _flat(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy().reshape(len(values), len(NAMES))


class Discriminant:
    """Two class densities and the log prior odds."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        self.prior = math.log((n[1] + 1) / (n[0] + 1))
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        if not (n[0] and n[1]):
            return
        mean = {c: sums[c][1] / n[c] for c in (0, 1)}
        scatter = {c: sums[c][2] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        for c in (0, 1):
            cov = (1 - POOL) * scatter[c] / n[c] + POOL * pooled
            cov = (1 - DIAGONAL) * cov + (DIAGONAL + 1e-9) * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts[c] = (mean[c], np.linalg.inv(factor).T, float(np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        for c, (mean, whiten, half_log_det) in self.parts.items():
            distance = (((x - mean) @ whiten) ** 2).sum(axis=1)
            odds += (1 if c else -1) * (-0.5 * distance - half_log_det)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """labelled: x, quality. Each batch gives one row of sums per class."""
    width = len(NAMES)

    def run(batch: pa.RecordBatch):
        x, y = _flat(batch, 0), batch.column(1).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            if len(own):
                sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.record_batch([pa.array(np.full(len(sums), c)), pa.array(np.arange(len(sums))), pa.array(sums)], ["quality", "place", "value"])

    rows = map_arrow(labelled.select("x", F.col("quality").cast("long").alias("quality")).where("quality IN (0, 1)"), run, "quality long, place long, value double")
    table = rows.groupBy("quality", "place").agg(F.sum("value").alias("value")).collect()  # 2 x (1 + 15 + 225) at most
    sums = {}
    for c in sorted({r["quality"] for r in table}):
        flat = np.zeros(1 + width + width * width)
        for r in table:
            if r["quality"] == c:
                flat[r["place"]] = r["value"]
        sums[int(c)] = (flat[0], flat[1 : 1 + width], flat[1 + width :].reshape(width, width))
    return Discriminant(sums)


def scored(drawn: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score."""

    def run(batch: pa.RecordBatch):
        yield pa.record_batch([batch.column(0), pa.array(model.score(_flat(batch, 1)))], ["doc_id", "score"])

    return map_arrow(drawn.select("doc_id", "x"), run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted of every document; labels (doc_id, quality) of the held-out fold are not used."""
    drawn = stored(document_statistics(docs), "statistics")
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    model = fit(drawn.join(learn, "doc_id").select("x", "quality"))
    return scored(drawn, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
