"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics of its whole text. Each class has a mean
and a covariance that is shrunk towards the pooled covariance and then towards its own diagonal;
the score is the logistic function of the difference of the two log densities (Mahalanobis distance
through a Cholesky factor that is computed once) plus the log prior odds.

Moments are sums over all training rows: a few hundred numbers for each task and class, added up in
Spark. So the model has seen every labelled row, and its size depends on the number of statistics
alone.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm import bloom
from loomstone.llm.common import ROWS_AT_ONCE, arrow_map, texts, written

STATISTICS = (
    "log_words", "word_length", "upper", "symbols", "bangs", "bars", "digits", "adjacent_repeats", "distinct", "line_repeats",
    "commas_stops", "entropy", "short_words", "long_words", "line_length", "markup",
)

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "symbols": b"#$%&*+=@\\^_~`",
    "markup": b"<>{}[]/",
    "digits": b"0123456789",
    "stops": b".,;:",
}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}
_HIGH = np.arange(256) >= 128


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; an empty text has defined values too."""
    words = text.split()
    n, size = len(words), len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    count = lambda k: float(hist[_MASKS[k]].sum())
    # shares carry pseudo-counts, so that a few words don't look like extreme prose
    share = lambda x, of, more, prior=0.0: ((x + prior * more) / (of + more)) ** 0.5
    letters = count("upper") + count("lower") + float(hist[_HIGH].sum())
    p = hist[hist > 0] / max(size, 1)
    entropy = float(-(p * np.log2(p)).sum())
    lines = [x for x in text.split(b"\n") if x]
    lengths = list(map(len, words))
    return [
        np.log1p(n),
        np.log1p((sum(lengths) + 5 * 20) / (n + 20)),
        share(count("upper"), letters, 100, 0.03),
        share(count("symbols"), size, 20),
        share(float(hist[33]), size, 20),
        share(float(hist[124]), size, 20),
        share(count("digits"), size, 100),
        share(sum(map(operator.eq, words, words[1:])), n, 5),
        np.log1p(len(set(words)) + 20) / np.log1p(n + 20),
        share(len(lines) - len(set(lines)), len(lines), 20),
        share(count("stops"), size, 100, 0.02),
        (size * entropy + 500 * 4.2) / (size + 500),
        share(sum(x <= 3 for x in lengths), n, 20, 0.3),
        share(sum(x > 15 for x in lengths), n, 20, 0.02),
        (np.log1p(max(map(len, lines), default=0)) - np.log1p(size)) * size / (size + 500),
        share(count("markup"), size, 100),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior odds."""

    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, inverse, log_det in zip(self.means, self.inverses, self.log_dets, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * ((z * z).sum(axis=1) + log_det))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pool: float, diagonal: float) -> Model:
    """n: rows of class 0 and 1; sums: of the statistics; products: of their outer products.

    A class without rows takes the mean and covariance of the other; without any row, all scores
    are one half."""
    d = len(STATISTICS)
    total = n.sum()
    every_mean = sums.sum(axis=0) / max(total, 1)
    every_cov = products.sum(axis=0) / max(total, 1) - np.outer(every_mean, every_mean)
    floor = np.diag(1e-3 * np.diag(every_cov) + 1e-6)
    means, covs = [], []
    for k in (0, 1):
        mean = sums[k] / n[k] if n[k] else every_mean
        means.append(mean)
        covs.append(products[k] / n[k] - np.outer(mean, mean) if n[k] else every_cov)
    within = (n[0] * covs[0] + n[1] * covs[1]) / total if total else np.eye(d)
    inverses, log_dets = [], []
    for c in covs:
        c = (1 - pool) * c + pool * within
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + floor
        factor = np.linalg.cholesky(c)
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(inverses), np.array(log_dets), float(np.log((n[1] + 1) / (n[0] + 1))))


def measured(docs: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """_id, _x: the statistics of each row's text. only: one column of ids; then other rows are left out but for a few
    that a Bloom filter of 32 MB at most takes for them."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(id_col).alias("_h"))
    sent = None
    if only is not None:
        hashes = written(only.select(F.xxhash64(only.columns[0]).alias("_h")))
        sent = bloom.filter_of(hashes, hashes.count())

    def each(b: pa.RecordBatch) -> dict:
        if sent is not None:
            hit = bloom.has(np.frombuffer(sent.value, np.uint8), b.column(2).to_numpy().view(np.uint64))
            b = b.filter(pa.array(hit))
        return {"_id": b.column(0), "_x": [statistics(t) for t in texts(b, "_t")]}

    return arrow_map(src, each, T.StructType([src.schema["_id"], T.StructField("_x", T.ArrayType(T.DoubleType()))]))


def train(rows: DataFrame, *, pool: float = 0.2, diagonal: float = 0.1) -> Model:
    """rows: _x and _y (0 or 1; other rows are left out)."""
    d = len(STATISTICS)

    def moments(b: pa.RecordBatch) -> dict | None:
        x = np.array(b.column(0).to_pylist(), float).reshape(-1, d)
        y = np.array(b.column(1).to_pylist())
        out = [(k, float((y == k).sum()), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)]
        return {"k": [o[0] for o in out], "m": [np.r_[o[1], o[2], o[3].ravel()].tolist() for o in out]}

    part = arrow_map(rows.filter("_y IN (0, 1)").select("_x", F.col("_y").cast("int").alias("_y")), moments, "k int, m array<double>")
    summed = part.groupBy("k").agg(F.array(*(F.sum(F.col("m")[i]) for i in range(1 + d + d * d))).alias("m"))
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in summed.collect():  # two rows
        m = np.array(r.m)
        n[r.k], sums[r.k], products[r.k] = m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)
    return fit(n, sums, products, pool, diagonal)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    d = len(STATISTICS)

    def each(b: pa.RecordBatch) -> dict:
        return {"_id": b.column(0), "score": pa.array(model.score(np.array(b.column(1).to_pylist(), float).reshape(-1, d)))}

    return arrow_map(stats, each, T.StructType([stats.schema["_id"], T.StructField("score", T.DoubleType())]))


def learn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_on=None, every: bool = True
) -> tuple[Model, DataFrame]:
    """The model of all labelled rows that meet train_on, and the statistics of all rows of docs; with every=False of
    those that are labelled, and maybe some more."""
    known = labels.select(F.col(id_col).alias("_of"), F.col(label_col).alias("_y")).filter("_y IN (0, 1)")
    if train_on is not None:
        known = known.filter(train_on("_of"))
    stats = written(measured(docs, id_col, text_col, None if every else known.select("_of")))
    return train(stats.join(known, stats["_id"] == known["_of"]).select("_x", "_y")), stats


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores at least the threshold. Texts are
    scored where they are read, so nothing is shuffled. Null texts are scored as empty ones; repeated rows stay or go
    together; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, ROWS_AT_ONCE) for x in batches for i in range(0, x.num_rows, ROWS_AT_ONCE)):
            good = model.score(np.array([statistics(t) for t in texts(b, text_col)])) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_on=None,
    threshold: float = 0.7,
) -> DataFrame:
    """Score every row of ``docs`` with a model fitted to ``labels`` (id, 0 or 1).

    train_on: a condition on the id; rows of labels that don't meet it are never looked at. Labels,
    ids and any column but the text are never inputs of a score.
    Returns id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold),
    one row for each row of docs. A null text counts as empty; empty texts get the score of an
    empty text's statistics. Null labels, other values and labels without a document teach nothing;
    an id that is repeated in labels or docs teaches once for each pair. Without training rows every
    score is one half. An empty table gives an empty table.
    """
    model, stats = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, train_on=train_on)
    out = scored(stats, model)
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
