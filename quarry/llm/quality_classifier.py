"""Quality classifier: naive Bayes support vectors.

N-gram indicators of a text are scaled by the log ratio of their smoothed frequencies in the two classes, and a linear model with
hinge loss is fitted to them by dual coordinate descent. N-grams are of bytes and of word shapes, hashed to a fixed width.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, mix64, table

WIDTH = 1 << 18
#: Labelled documents that the model is fitted on, at most about so many; they are drawn by hash of doc_id.
TRAIN_ROWS = 6000
#: Feature lists of training rows, all together, in bytes.
TRAIN_BYTES = 1 << 28
FOLDS = 5
THRESHOLD = 0.3
COST = 0.1
EPOCHS = 12
SALT = {k: np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in range(1, 9)}

_ENDING = re.compile(r"[^\w\s]+$")


class _Shapes(dict):
    """Word -> a small code of its case, ending and length."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        ending = _ENDING.search(word)
        stem = word[: ending.start()] if ending else word
        tail = ending[0] if ending else ""
        case = 0 if not stem else 1 if stem.islower() else 2 if stem.istitle() and len(stem) > 1 else 3 if stem.isupper() and len(stem) > 1 else 4 if stem.isdigit() else 5
        end = 0 if not tail else 1 if tail in (".", "?", "!") else 2 if tail in (",", ";", ":") else 3 if len(tail) == 1 else 4 if len(set(tail)) == 1 else 5
        size = min(4, len(stem) // 4)
        self[word] = out = ((case * 6 + end) * 5 + size) * 2
        return out


_SHAPES = _Shapes()


def indicators(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    found = [np.zeros(1, np.uint64)]  # a feature that every text has: the bias
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    for k in (2, 3, 4):
        if len(data) >= k:
            gram = data[: len(data) - k + 1].copy()
            for j in range(1, k):
                gram = gram * np.uint64(256) + data[j : len(data) - k + 1 + j]
            found.append(_distinct(gram, k))
    words = text.split()
    if words:
        codes = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
        codes[1:] += np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.uint64, len(words) - 1)
        for k in (1, 2, 3):
            if len(codes) >= k:
                gram = codes[: len(codes) - k + 1].copy()
                for j in range(1, k):
                    gram = gram * np.uint64(512) + codes[j : len(codes) - k + 1 + j]
                found.append(_distinct(gram, 4 + k))
    return np.unique(np.concatenate(found)).astype(np.uint32)


def _distinct(gram: np.ndarray, k: int) -> np.ndarray:
    return np.unique(mix64(gram + SALT[k]) % np.uint64(WIDTH - 1)) + np.uint64(1)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (share of a feature among the good class's) / (among the bad class's), smoothed by alpha."""
    p, q = np.full(WIDTH, alpha), np.full(WIDTH, alpha)
    for own, good in zip(rows, y, strict=True):
        (p if good else q)[own] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model on the scaled indicators; classes weigh alike in the loss."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([max(1, (y <= 0).sum()), max(1, (y > 0).sum())]) / max(1, len(y))
    upper = cost * 0.5 / share[(y > 0).astype(int)]
    # a row's values are looked up each time: held, they would take twice the memory of the features
    norm = np.array([v @ v for v in (scale[own] for own in rows)]) + 1e-12
    w, a = np.zeros(WIDTH), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            own, v = rows[i], scale[rows[i]]
            grad = sign[i] * (w[own] @ v) - 1
            new = min(max(a[i] - grad / norm[i], 0.0), upper[i])
            if new != a[i]:
                w[own] += (new - a[i]) * sign[i] * v
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-6:
            break
    return w * scale


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), with smoothed targets and a kept above zero."""
    hi, lo = ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2)
    t, z, theta = np.where(y > 0, hi, lo), np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - t))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


class Model:
    def __init__(self, weights: np.ndarray, a: float, b: float):
        self.weights, self.a, self.b = weights.astype(np.float32), a, b

    def score(self, text: str) -> float:
        margin = float(self.weights[indicators(text)].sum(dtype=np.float64))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * margin + self.b))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The margins that the probabilities are fitted to come from models that have not seen those rows."""
    if len(set(y.tolist())) < 2:
        # one class or no labels at all: its share, smoothed, for every text
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(WIDTH), 1.0, math.log(share / (1 - share)))
    fold = np.arange(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        train, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        own = [rows[i] for i in train]
        w = dual_coordinate_descent(own, y[train], log_count_ratios(own, y[train]))
        margin[rest] = [w[rows[i]].sum() for i in rest]
    a, b = platt(margin, y)
    return Model(dual_coordinate_descent(rows, y, log_count_ratios(rows, y)), a, b)


def fold_of(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo FOLDS; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % FOLDS, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> Model:
    """Fitted on labelled documents outside fold 0, about rows of them, and fewer where their features exceed about TRAIN_BYTES. Repeated labels of a document count by majority; null ones don't count."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold_of() != 0).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n > rows:
        # a hash threshold: about rows of them
        known = known.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")  # about rows ids at most

    def run(batches):
        for batch in batches:
            found = [indicators(x.as_py() or "").tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], names=["id", "y", "found"])

    # rows that repeat an id count once, by the least of their feature lists
    found = texts.select("id", "y", "text").mapInArrow(run, "id long, y int, found binary").groupBy("id").agg(F.min("y").alias("y"), F.min("found").alias("found"))
    found = (scratch or Scratch(docs.sparkSession, "train")).keep(found, "features")
    size = found.agg(F.coalesce(F.sum(F.length("found")), F.lit(0))).first()[0]
    if size > TRAIN_BYTES:
        found = found.where(F.pmod(F.xxhash64("id", F.lit("bytes")), F.lit(1 << 30)) < int((1 << 30) * TRAIN_BYTES / size))
    got = found.toArrow()
    order = sorted(range(got.num_rows), key=got["id"].to_pylist().__getitem__)
    y = got["y"].to_pylist()
    # the lists are views of what has arrived, not copies: the driver holds the features once
    model = fit([np.frombuffer(got["found"][i].as_buffer(), np.uint32) for i in order], np.array([y[i] for i in order], int))
    del got
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= threshold). Only the text is read for it."""
    plain = docs.drop("score", "predicted")
    fields = plain.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        for batch in batches:
            score = [model.score(x.as_py() or "") for x in batch.column("text")]
            kept = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return plain.mapInArrow(run, fields)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones; repeated rows get repeated results; with one class or no labels every score is the
    class's smoothed share; an empty table gives no rows; other columns play no part.
    """
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels, rows), threshold).select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
