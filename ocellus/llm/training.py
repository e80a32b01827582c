"""Bounded labelled samples and small calibrations for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int) -> DataFrame:
    """doc_id, text, y of at most about `per_class` labelled training documents of each class, one row per id.

    Training rows are those whose crc32(doc_id) mod `modulus` is not 0; rows with a null id or label aren't used.
    The sample is those ids of a class whose hash is in the lowest fraction that holds per_class of them, so it
    doesn't depend on partitioning; of the rows of one id the text with the smallest digest counts. Texts of any
    length are taken whole. Only the sampled ids are broadcast: about 2 * per_class longs, whatever the tables' size.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), modulus) != 0))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.countDistinct("doc_id").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.when(F.col("y") == 1, int((1 << 20) * min(1.0, per_class / max(1, counts.get(1, 0))))).otherwise(int((1 << 20) * min(1.0, per_class / max(1, counts.get(0, 0)))))
    chosen = known.filter(place < limit).groupBy("doc_id").agg(F.max("y").alias("y"))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("doc_id", "text", "y")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (the last one is the intercept) by Newton's method; class 1 alone or no data give a constant."""
    x = np.c_[x, np.ones(len(x))]
    weight = weight / max(weight.sum(), 1e-12)
    w = np.zeros(x.shape[1])
    penalty = np.full(w.size, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, p) of a rising curve: neighbours are pooled until their weighted shares of class 1 rise with x. The
    curve starts at (least, 0) and ends at (most, 1); between knots it is straight."""
    at, pooled = np.unique(x, return_inverse=True)
    stack: list[list[float]] = []  # weight, weighted sum of x, weighted sum of y
    for w, wx, wy in np.stack([np.bincount(pooled, v * weight, at.size) for v in (np.ones_like(x), x, y)], axis=1).tolist():
        stack.append([w, wx, wy])
        while len(stack) > 1 and stack[-2][2] * stack[-1][0] >= stack[-1][2] * stack[-2][0]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    w, wx, wy = np.array(stack).reshape(-1, 3).T
    few = 0.5 * weight.sum() / max(1, len(x))  # half a row of either class, so that no knot is 0 or 1
    return np.r_[least, wx / w, most], np.r_[0.0, np.maximum.accumulate((wy + few) / (w + 2 * few)), 1.0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
