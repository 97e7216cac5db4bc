"""Audit of how filters interact: every order of the filters at once, by min-plus removal ranks.

Documents are reduced to counts per part and *mask*, the set of filters that they fail; with five filters a part has at most
32 masks, however many documents it holds. For all orders together, the step that removes a mask is a min-plus product:
the mask matrix has 0 where the mask fails a filter and infinity elsewhere, the position matrix (one inverse permutation an
order) has the step at which an order applies a filter, and the minimum over filters of their sums is the step (infinity:
kept). Counts weighted by documents are scattered to (order, step) by that matrix: what a step removes, what
fails its filter but is gone already (redundant), what is lost of the good and of the toxic documents.

One filter compares documents: E fails where a smaller ``doc_id`` of the whole table has an identical text. Rows meet by the SHA-256 of
the text in counts per (text, part, labels), not row by row, so a text that a third of all rows share is a few
sums per part.

Cases: a null text is empty (it fails A; empty texts are identical); a null source and an empty one are the same part; a null ``doc_id`` is no smaller id
and has none, so it never fails E; rows that repeat an id count each, and fail E only for a smaller id; of several labels
of one id the greatest counts; a missing or null label is 0; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def row_filters(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text (never null)."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and set of failed filters (bit i: ``FILTERS[i]``)."""
    text = common.text_or_empty()
    own = row_filters(text)
    bits = sum((F.when(own[f], 1 << FILTERS.index(f)).otherwise(0) for f in own), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("hash"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    known = known.filter("id is not null").groupBy("id").agg(
        F.coalesce(F.max("q") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("t") == 1, F.lit(False)).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    named = rows.join(known, F.col("doc_id") == F.col("id"), "left").select("doc_id", "part", "mask", "hash", flag("good"), flag("toxic"))
    # the rows of an id lie together, so counting them needs no exchange; then counts per text meet, not rows
    group = ("hash", "part", "mask", "good", "toxic")
    ids = named.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    sums = ids.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    first = F.min("least").over(Window.partitionBy("hash"))
    spared = F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    split = sums.withColumn("spared", spared).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("spared").alias("n")),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))).alias("x"))
    counted = split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"))
    lost = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return counted.agg(F.sum("x.n").alias("n"), lost("good"), lost("toxic"))


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orders, their position matrix, and the step (1 to n_filters, or infinity) at which each order removes each mask."""
    orders = np.array(list(permutations(range(n_filters))))
    position = np.argsort(orders, axis=1) + 1.0  # the inverse permutation
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1 == 1
    mask = np.where(fails, 0.0, np.inf)
    return orders, position, (mask[:, None, :] + position[None, :, :]).min(axis=2)


def tally(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> pd.DataFrame:
    """The audit of one part from its counts per mask: a row for every order and step."""
    k = len(filters)
    orders, position, step = removal_steps(k)
    row, gone = np.broadcast_to(np.arange(len(orders)), step.shape), np.isfinite(step)
    place = (row[gone], step[gone].astype(int) - 1)

    def scatter(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), k), np.int64)
        np.add.at(out, place, np.broadcast_to(weight[:, None], step.shape)[gone])
        return out

    removed = scatter(n)
    fails = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    failing = (n[:, None] * fails).sum(axis=0)[orders]  # by (order, step): all that fail the step's filter
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, orders, removed)
    columns = dict(
        kept=n.sum() - removed.cumsum(axis=1), removed=removed, redundant=failing - removed, unique_fails=n[1 << np.arange(k)][orders],
        good_lost=scatter(good), toxic_lost=scatter(toxic), shapley=shapley[orders])
    names = ["".join(filters[f] for f in o) for o in orders]
    return pd.DataFrame({
        "filter_order": np.repeat(names, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        **{c: v.reshape(-1) for c, v in columns.items()}})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts of ``COUNTS``: 600 rows per part, zeros included."""

    def one(part: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
        counts[:, part["mask"]] = part[["n", "good", "toxic"]].to_numpy().T
        return tally(*counts).assign(part=part["part"].iloc[0])[["part", "filter_order", "step", *COUNTS]]

    return masks(docs, labels).groupBy("part").applyInPandas(
        one, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
