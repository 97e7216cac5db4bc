"""Bounded training samples, a small logistic regression, and folds by document id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(n))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, per_class: int, max_chars: int,
) -> list[tuple[str, int]]:
    """At most ``per_class`` whole texts of each label, in the order of a hash of the id.

    Ids are picked from the label table alone, outside the fold ``left_out``; texts over ``max_chars``
    characters take no part in training. Several labels of an id count as the greatest, several of its texts as the smallest, and
    the bounds hold before anything comes to the driver, so that is bounded by both parameters.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.col("y").isin(0, 1) & (fold(F.col("id"), folds) != left_out)).groupBy("id").agg(F.max("y").alias("y"))
    picked = [own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * per_class) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), common.text_or_empty().alias("text")).filter(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))  # of at most 2 * per_class rows
    rows = found.withColumn("place", place).filter(F.col("place") <= per_class).toPandas()
    rows = rows.assign(h=[hash_of(i) for i in rows["id"]]).sort_values(["h", "id"])
    kept = [rows[rows["y"] == y] for y in (0, 1)]
    return [(t, int(y)) for k in kept for t, y in zip(k["text"], k["y"])]


def hash_of(i: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(i).encode())


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression on soft labels, by damped Newton steps on scaled columns."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(weight @ (np.logaddexp(0, m) - y * m) + 0.5 * penalty @ (v * v))

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        size = 1.0
        while size > 1e-6 and not loss(w - size * step) <= now:
            size /= 2
        w, before, now = w - size * step, now, min(now, loss(w - size * step))
        if before - now < 1e-7 * (1 + abs(now)):
            break
    plain = w[:-1] / scale
    return np.r_[plain, w[-1] - plain @ mean]


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))
