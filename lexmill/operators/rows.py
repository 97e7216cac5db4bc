"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def explode_positions(df: DataFrame, keep: Sequence[str | Column], array: Column, pos: str, item: str) -> DataFrame:
    """One row per element with its position.

    The outer form is used on purpose: for the inner one the optimizer infers a filter on the array's
    size, which would compute an expensive array a second and third time below the explode.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
