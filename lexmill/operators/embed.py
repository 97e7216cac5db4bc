"""Embedding hook: any batch encoder over any table of texts, plus a lexical default."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ..functions import constants as K

# An encoder takes a batch of texts and returns (dense matrix, list of {token id: weight}).
Encoder = Callable[[Sequence[str]], tuple[np.ndarray, list[dict[int, float]]]]
LEXICAL_DIM = 64
# Words whose ids a task keeps at hand.
KNOWN_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")


def keep_strong(weights: dict[int, float], threshold: float) -> dict[int, float]:
    strong = {t: w for t, w in weights.items() if w > threshold}
    top = max(strong.values(), default=1.0)
    return {t: w / top for t, w in strong.items()}


def lexical_encoder(dim: int = LEXICAL_DIM) -> Callable[[], Encoder]:
    """Words hashed to 32-bit token ids, weight ``tf / (tf + 3)``; dense = unit sum per bucket."""

    def load() -> Encoder:
        ids: dict[str, int] = {}

        def token(word: str) -> int:
            if word not in ids:
                if len(ids) >= KNOWN_WORDS:
                    ids.clear()
                ids[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            return ids[word]

        def encode(texts):
            dense, sparse = np.zeros((len(texts), dim)), []
            for i, text in enumerate(texts):
                counts = Counter(map(token, _WORD.findall(text.lower())))
                weights = {t: n / (n + 3.0) for t, n in sorted(counts.items())}
                for t, w in weights.items():
                    dense[i, t % dim] += w
                sparse.append(weights)
            norm = np.linalg.norm(dense, axis=1, keepdims=True)
            return dense / np.where(norm == 0, 1, norm), sparse

        return encode

    return load


def embed(
    df: DataFrame, text_col: str = "text", load: Callable[[], Encoder] | None = None,
    threshold: float = K.SPARSE_THRESHOLD, batch_size: int = 256,
) -> DataFrame:
    """Append ``dense``, ``idx`` and ``val``. The encoder is loaded once per task and gets ``batch_size`` texts at a time.

    Row-preserving, so a text can neither lose nor gain an embedding. Filters belong before it:
    they are not pushed through Python.
    """
    load = load or lexical_encoder()
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("dense", "idx", "val")])
    names = schema.fieldNames()
    for name, element in (("dense", T.DoubleType()), ("idx", T.LongType()), ("val", T.DoubleType())):
        schema = schema.add(name, T.ArrayType(element))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for whole in batches:
            # one batch of texts at a time goes out, so their weights as Python objects are few at once
            for batch in (whole.slice(at, batch_size) for at in range(0, whole.num_rows, batch_size)):
                dense, sparse = encode([t or "" for t in batch.column(text_col).to_pylist()])
                sparse = [keep_strong(s, threshold) for s in sparse]
                columns = [batch.column(n) for n in names]
                columns += [
                    pa.array(list(dense), pa.list_(pa.float64())),
                    pa.array([list(s) for s in sparse], pa.list_(pa.int64())),
                    pa.array([list(s.values()) for s in sparse], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names + ["dense", "idx", "val"])

    return df.mapInArrow(run, schema)
