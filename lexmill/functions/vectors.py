"""Sparse and dense vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K


def sparse_weights(raw: Column, threshold: float = K.SPARSE_THRESHOLD) -> Column:
    """Drop weights at or below the threshold and scale the largest one to 1."""
    kept = F.map_filter(raw, lambda _, w: w > threshold)
    # the maximum travels as a map value of the fold, so it is computed once per row
    top = F.array_max(F.map_values(kept))
    scaled = F.zip_with(
        F.map_keys(kept),
        F.array_repeat(top, F.size(kept)),
        lambda k, m: F.struct(k.alias("k"), m.alias("m")),
    )
    pairs = F.zip_with(scaled, F.map_values(kept), lambda km, w: F.struct(km["k"].alias("k"), (w / km["m"]).alias("w")))
    return F.map_from_entries(pairs)


def namespace_of_user(user: Column) -> Column:
    return F.concat(F.lit(K.USER_NAMESPACE_PREFIX), user.cast("string"))


def round4(score: Column) -> Column:
    """Round the binary value to 4 places, halves to even."""
    return F.rint(score * 10000) / 10000
