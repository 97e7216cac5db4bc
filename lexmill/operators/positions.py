"""Positions of rows in an order, without a global window.

Rows are written once, range-partitioned and sorted; each range numbers its own rows, and ranges learn how many rows
come before them from a prefix sum over one count per range (and group). So no task holds more than a range, the
input is computed once, and an order with very many equal keys still spreads over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

#: Bits that ``monotonically_increasing_id`` keeps for the row number inside a partition.
_ROW_BITS = 33


def positions(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "position", ranges: int | None = None) -> DataFrame:
    """``df`` with ``name`` (long, from 0): a row's place in ``order`` among the rows with equal ``by`` columns.

    ``order`` are sort orders over ``df``; rows equal in all of them get different places, as they were written.
    Null groups are groups. An empty table gives no row.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart by a number that is fixed in the written table, so a repeated task places them alike
    rows = staged(df.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    keys = [F.asc_nulls_first(F.col(f"`{c}`")) for c in by] + order + [F.asc("_tie")]
    ordered = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_tie")
    ordered = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftrightunsigned("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    groups = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    counts = ordered.select(part.alias("_part"), at.alias("_row"), *groups).groupBy("_part", *names).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col("_part").alias("_p"), *names, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    met = (part == F.col("_p"))
    for i, c in enumerate(by):
        met = met & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    place = (at + F.col("_shift")).alias(name)
    return ordered.join(offsets, met).select(*[F.col(f"`{c}`") for c in df.columns], place)
