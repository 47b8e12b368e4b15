"""Bounded samples of labelled documents, and a sparse logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, text: str = "text",
             key: str = "doc_id") -> DataFrame:
    """(k, text, y): the documents of at most ``per_class`` labelled keys of each
    class, chosen by a hash of the key. The keys, at most twice that number, are
    broadcast; each text comes along with its key."""
    known = labels.filter(train & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(
        F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("k")
    chosen = [known.filter(F.col("y") == y).orderBy(order, "k").limit(per_class) for y in (0, 1)]
    keys = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(keys), "k")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus ``penalty``
    times the sum of absolute weights, by accelerated proximal steps."""
    n, m = x.shape
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    weight, bias = np.zeros(m), float(np.log(share / (1 - share)))
    if m == 0:
        return weight, bias
    # Largest eigenvalue of x'x / 4n bounds the curvature.
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(30):
        u = x @ v[:-1] + v[-1]
        v = np.append(x.T @ u, u.sum())
        norm = np.linalg.norm(v)
        v /= norm
    step = 4.0 * n / (1.05 * norm)
    at, at_bias, t = weight.copy(), bias, 1.0
    for _ in range(rounds):
        wrong = (sigmoid(x @ at + at_bias) - y) / n
        new = at - step * (x.T @ wrong)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0.0)
        new_bias = at_bias - step * wrong.sum()
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_bias = new + (t - 1) / nxt * (new - weight), new_bias + (t - 1) / nxt * (new_bias - bias)
        weight, bias, t = new, new_bias, nxt
    return weight, float(bias)
