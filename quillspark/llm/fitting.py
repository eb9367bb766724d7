"""Weighted ridge logistic regression by Newton steps, for the bounded samples the classifiers are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import portion


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12, empty: float = 0.5) -> np.ndarray:
    """Coefficients, the intercept (free of the penalty) last. A label that all rows share gives its smoothed rate, no rows `empty`."""
    x = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else empty
    beta[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return beta
    pull = np.full(len(beta), ridge)
    pull[-1] = 1e-6

    def loss(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + (pull * b * b).sum() / 2

    now = loss(beta)
    for _ in range(steps):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * beta)
        while (new := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        beta, gain, now = beta + step, now - new, new
        if gain < 1e-6 * max(1.0, now):
            break
    return beta


def labelled(rows: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """The rows (did, th, ...) that have a label, with `y`: `bound` of them at most, by a hash of id and text.

    Ids are sampled before the join, so what is broadcast is about 2 * bound ids, and rows after it, as one id may stand
    on many rows. Ids with two labels take the greater; null ids and null labels count as none.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("y")).where("__id is not null and y is not null")
    y = y.groupBy("__id").agg(F.max("y").alias("y"))
    n = y.count()
    if n > 2 * bound:
        y = y.where(portion(F.xxhash64("__id"), 2 * bound / n))
    found = rows.join(F.broadcast(y), F.col("did") == F.col("__id")).drop("__id")
    return found.orderBy(F.xxhash64("did", "th"), "did", "th").limit(bound)
