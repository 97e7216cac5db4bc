"""Compression classifier of text quality.

Two zstandard dictionaries are built from a bounded sample of good and of bad labelled texts. A text's
chunks are compressed with either one; the difference of the compressed sizes over the raw size tells which kind
it resembles. A logistic calibration on the same sample's second half (difference, mean compressed ratio, length, and their
products) turns it into the probability of a good text.

Sample: at most ``per_class`` texts of each label, up to ``max_chars`` characters each; scoring is over whole texts.
Cases: a null or empty text scores as the shortest text; without labels of both kinds the score is the share of
good labels (0.5 without any); a null ``doc_id`` is scored like any other and is not held out; repeated rows get a
row each; labels are looked up only for training, and other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .training import fit_logistic, fold, labelled_sample, sigmoid

CHUNK = 4096


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float


def dictionary(texts: list[str], size: int = 112_640) -> bytes:
    """A trained dictionary; of raw content where there is too little to train on."""
    import zstandard

    samples = [c for t in texts for c in chunks(t) if c]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def chunks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


class Sizer:
    """Compressed sizes under both dictionaries."""

    def __init__(self, model: Model):
        import zstandard

        self.own = []
        for data in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=3)
            self.own.append(zstandard.ZstdCompressor(level=3, dict_data=d))

    def features(self, text: str) -> list[float]:
        pieces = chunks(text)
        raw = max(1, sum(map(len, pieces)))
        good, bad = (sum(len(c.compress(p)) for p in pieces) / raw for c in self.own)
        # a frame's fixed cost weighs on short texts: ratios over 1 say nothing more
        return [bad - good, min(1.0, (good + bad) / 2), float(np.log(raw))]


def expand(f: np.ndarray) -> np.ndarray:
    d, r, n = f.T
    return np.column_stack([d, r, n, d * r, d * n, r * n, r * r, d * d, n * n, d / (r + 0.02)])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, left_out: int = 0, per_class: int = 3000,
    max_chars: int = 32_768,
) -> Model:
    sample = labelled_sample(docs, labels, label, folds, left_out, per_class, max_chars)
    by = {y: [t for t, own in sample if own == y] for y in (0, 1)}
    share = labels.filter(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != left_out)).agg(F.avg(F.col(label))).first()[0]
    prior = 0.5 if share is None else float(share)
    if min(len(by[0]), len(by[1])) < 8:
        return Model(b"", b"", [], prior)
    model = Model(dictionary(by[1][::2]), dictionary(by[0][::2]), [], prior)
    sizer = Sizer(model)
    x = np.array([sizer.features(t) for y in (0, 1) for t in by[y][1::2]])
    y = np.repeat([0.0, 1.0], [len(by[0][1::2]), len(by[1][1::2])])
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.weights = fit_logistic(expand(x), y, weight, ridge=0.2).tolist()
    return model


def scorer(model: Model):
    """A function from texts to scores."""
    if not model.weights:
        return lambda texts: np.full(len(texts), model.prior)
    sizer, w = Sizer(model), np.array(model.weights)
    return lambda texts: sigmoid(expand(np.array([sizer.features(t) for t in texts]).reshape(len(texts), 3)) @ w[:-1] + w[-1])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""

    def work(slices):
        of = scorer(model)
        for rows in slices:
            s = of(rows["text"])
            yield {"doc_id": rows["doc_id"], "score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

    return common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")),
        {"doc_id": pa.int64(), "score": pa.float64(), "predicted": pa.int32()}, "doc_id long, score double, predicted int", work)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose text reaches the threshold, all columns as they are."""

    def make():
        of = scorer(model)
        return lambda texts: (of(texts) >= threshold).tolist()

    return common.filter_texts(docs, make)
