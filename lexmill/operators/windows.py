"""Ordered access to neighbours and recent rows that survives a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def lag_by_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key, computed per (key, block) so that one key can use many tasks.

    ``block`` must not decrease along ``order`` (a time bucket, a turn range). Inside a block a plain
    window answers; the first row of a block takes the last row of the nearest earlier block, found
    on a summary of one row per (key, block) that is pre-aggregated before its shuffle.
    """
    part = [*keys, "_block"]
    inside = Window.partitionBy(*part).orderBy(*order)
    rows = df.withColumn("_block", block).withColumn("_near", F.lag(F.struct(value)).over(inside))
    tails = (
        df.withColumn("_block", block).groupBy(*part)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_tail"))
    )
    carried = tails.select(
        *part, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    return (
        rows.join(carried, part, "left")
        .withColumn(out, F.coalesce("_near", "_carry")[value])
        .drop("_block", "_near", "_carry")
    )


def look_back(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, values: Sequence[str], n: int, out: str
) -> DataFrame:
    """The ``n`` rows before each row of its key, oldest first, as an array of structs.

    Blocks as in ``lag_by_blocks``. Each block passes on its last ``n`` rows; since a block holds at
    least one row, the ``n`` blocks before one are enough to fill its first rows' look-back.
    """
    part = [*keys, "_block"]
    item = F.struct(order, *values)
    rows = df.withColumn("_block", block)
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(-n, -1)
    near = rows.withColumn("_near", F.collect_list(item).over(inside))
    tails = most_recent(rows, part, [F.desc(order)], n).groupBy(*part).agg(
        F.sort_array(F.collect_list(item)).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-n, -1)
    carried = tails.select(*part, F.flatten(F.collect_list("_tail").over(across)).alias("_carry"))
    every = F.concat(F.coalesce("_carry", F.filter("_near", lambda _: F.lit(False))), F.col("_near"))
    return (
        near.join(carried, part, "left").withColumn(out, every)
        .withColumn(out, F.when(F.size(out) > n, F.slice(out, -n, n)).otherwise(F.col(out)))
        .drop("_block", "_near", "_carry")
    )


def most_recent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "recency") -> DataFrame:
    """The n newest rows per key. The rank filter prunes each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row (lowest unique ``order``) of every group of equal ``key``.

    Copies are reduced to one id before the shuffle; rows then meet the surviving ids on
    ``order``, which is unique, so a group of copies never gathers in one task.
    """
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")
