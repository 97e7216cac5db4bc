"""Mixing sources to target weights: exact block quotas, dealt to output shards by a splitting tree.

Every source's documents fall into blocks by a hash; each whole pass over a source permutes its blocks anew.
A source's quota is a number of block draws: its whole passes, then the blocks of a last pass up to the target,
the last of them in part (documents in hash order, then others that fit, close to the word count). The quotas of all sources are
split down a binary tree over the output shards: a node deals its vector of quotas to its halves by a
multivariate hypergeometric draw, so every shard gets exact quotas and every draw goes to one shard. Draws of a
source are numbered, shards take disjoint ranges of numbers, and documents are shuffled inside their shard.

Only narrow rows (id, size, hash) and one row per block are grouped; a source of any share spreads over its
blocks, at most ``max_blocks`` of them, and a block's documents are ordered only where the target ends.
Random draws are seeded by tree node, so reruns and repeated tasks agree.

Cases: a null or empty text has size 0 and goes along with its block; a null source is a source of its own, last in order; sources of size 0
have target 0; equal rows are drawn together; an empty table gives no row. Input columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common


@dataclass
class Mix:
    """``rows``: one per document (doc_id, size, source_size, target, copies). ``blocks``: the draws of every block."""

    rows: DataFrame
    sources: DataFrame
    blocks: DataFrame
    shards: int


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sid, source, source_size, target`` from one row per source (source, source_size).

    Weights repeat over the sources in code-point order, null last. A target stops at ``most`` times the size,
    and the excess goes to the others by weight: sources in the order of (cap / weight) are capped as long as
    their share of what the earlier ones left is above their cap.
    """
    everything, order = Window.partitionBy(), Window.orderBy(F.asc_nulls_last("source"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("sid", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    ).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, all_weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = ranked.withColumn("capped", F.col("weight") * left > F.col("cap") * left_weight)
    free = lambda c: F.sum(F.when(~F.col("capped"), F.col(c)).otherwise(0)).over(everything)
    rest = total - (F.sum("cap").over(everything) - free("cap"))
    share = F.try_divide(F.col("weight") * rest.cast("double"), free("weight"))
    return capped.select(
        "sid", "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def plan(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: tuple[int, int] = (20_000, 200_000),
    max_blocks: int = 16_384, shard_words: int = 20_000_000, seed: int = 17,
) -> Mix:
    """Decide how often, and to which shards, every document goes.

    There are as many shards as the session has shuffle partitions, or more by ``shard_words``; a block has an eighth of
    a shard's words within the bounds of ``block_words``, and a source at most ``max_blocks`` blocks.
    """
    rows = common.stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _size().alias("size"), _hash(F.lit(seed), "doc_id", "text").alias("h")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), round(total / shard_words))
    words = min(max(total // (8 * shards), block_words[0]), block_words[1])
    sources = common.stage(
        source_targets(sizes, weights, most)
        .withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(max_blocks), F.ceil(F.col("source_size") / words))).cast("int"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("part_words", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")
    placed = place(rows, sources)
    blocks = placed.groupBy("sid", "block").agg(F.sum("size").alias("words"))

    each = Window.partitionBy("sid", "epoch").orderBy(_hash(F.lit(seed), "sid", "block", "epoch"), "block")
    draws = (
        blocks.join(sources.select("sid", "n_blocks", "passes", "part_words"), "sid")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        .withColumn("rank", F.row_number().over(each) - 1)
        .withColumn("upto", F.sum("words").over(each.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("room", F.when(F.col("epoch") < F.col("passes"), F.col("words")).otherwise(F.col("part_words") - (F.col("upto") - F.col("words"))))
        .filter((F.col("room") > 0) & (F.col("words") > 0))
        .select("sid", "block", "epoch", "room", "words",
                F.row_number().over(Window.partitionBy("sid").orderBy("epoch", "rank")).alias("draw"))
    )
    draws = common.stage(draws.withColumn("partial", F.col("room") < F.col("words")), "mix-draws")

    ends = draws.filter("partial").select("sid", "block", "room")
    inside = placed.join(ends, ["sid", "block"]).groupBy("sid", "h").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    cuts = inside.groupBy("sid").applyInPandas(_fill, "sid int, cut long, extras array<long>")
    quotas = draws.groupBy("sid").agg(F.count("*").alias("quota"))
    ranges = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = (
        split_quotas(quotas, shards, seed).withColumn("to", F.sum("quota").over(ranges)).filter("quota > 0")
        .select("sid", "shard", F.explode(F.sequence(F.col("to") - F.col("quota") + 1, F.col("to"))).alias("draw"))
    )
    per_block = common.stage(
        draws.join(dealt, ["sid", "draw"]).join(cuts, "sid", "left").groupBy("sid", "block")
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "partial", "cut", "extras"))).alias("draws")), "mix-blocks")
    counted = placed.join(per_block, ["sid", "block"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce(F.size(_taken()), F.lit(0)).alias("copies"))
    return Mix(counted, sources, per_block, shards)


#: Documents that may fill a last block's rest, and steps into which its words are divided for that.
FILLERS, STEPS = 64, 1 << 17


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Take a block's documents in hash order up to a few documents' words below the room, then those of the next that fill it best.

    Returns the last hash of the run and the hashes of the others: small documents behind a large one that ended the run, as far
    as they fit, and of the next ``FILLERS`` those whose sum is nearest. Sums of sizes are kept as bits of one number of two times
    ``STEPS`` bits: exactly while the rest is up to ``STEPS`` words, else in steps of its ``STEPS``-th part. Documents of
    more than twice the rest cannot come near it and are left out, so work does not depend on sizes.
    """
    block = block.sort_values("h")
    room, h, size = float(block["room"].iloc[0]), block["h"].to_numpy(), block["size"].to_numpy()
    spare = min(room, 32 * size[size <= room].mean()) if (size <= room).any() else room
    run = int((np.cumsum(size) <= room - spare).sum())
    left, extras, rest = max(0, round(room - size[:run].sum())), [], []
    for x, n in zip(h[run:].tolist(), size[run:].tolist()):
        if 0 < n <= min(left - spare, spare):
            extras.append(x)
            left -= n
        elif n:
            rest.append((x, n))
    unit = -(-left // STEPS) or 1
    rest = [(x, n) for x, n in rest if n <= 2 * left][:FILLERS]
    inside, sums = (1 << 2 * (left // unit) + 1) - 1, [1]  # bit s: some of the rest so far have s steps together
    for _, n in rest:
        sums.append((sums[-1] | sums[-1] << round(n / unit)) & inside)
    s = _nearest(sums[-1], left // unit)
    for (x, n), before in zip(reversed(rest), reversed(sums[:-1])):
        if not before >> s & 1:
            extras.append(x)
            s -= round(n / unit)
    first = int(h[run - 1]) if run else None
    return pd.DataFrame({"sid": [block["sid"].iloc[0]], "cut": pd.array([first], dtype="Int64"), "extras": [extras]})


def _nearest(bits: int, at: int) -> int:
    """The place of the set bit nearest to ``at``, the lower of two; bit 0 is set."""
    below = (bits & ((1 << at + 1) - 1)).bit_length() - 1
    above = bits >> at
    up = at + (above & -above).bit_length() - 1 if above else None
    return below if up is None or at - below <= up - at else up


def _size() -> Column:
    return F.regexp_count(common.text_or_empty(), F.lit(common.SPACE_WORD)).cast("long")


def _taken() -> Column:
    """The draws of a document's block that take the document itself."""
    return F.filter("draws", lambda d: ~d["partial"] | F.coalesce(F.col("h") <= d["cut"], F.lit(False)) | F.coalesce(F.array_contains(d["extras"], F.col("h")), F.lit(False)))


def place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row's source number and block."""
    known = sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "n_blocks")
    return rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(1), "h"), F.col("n_blocks")).cast("int"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``sid, shard, quota``: quotas (sid, quota) split down a binary tree over the shards.

    A node holds one row per source. Its left half takes as many draws as its shards' share, by source as a
    multivariate hypergeometric draw: one without replacement from all draws of the node.
    """

    def split(node: pd.DataFrame, low: int, high: int, depth: int):
        if high - low == 1 or not depth:
            yield node.assign(low=low, high=high)
            return
        middle, total = (low + high) // 2, int(node["quota"].sum())
        rng, left, want, pool = np.random.default_rng([seed, low, high]), [], total * (middle - low) // (high - low), total
        for q in node["quota"]:
            pool -= q
            got = int(rng.hypergeometric(q, pool, want)) if want and q else 0
            left.append(got)
            want -= got
        yield from split(node.assign(quota=left), low, middle, depth - 1)
        yield from split(node.assign(quota=node["quota"] - left), middle, high, depth - 1)

    def descend(key: tuple, node: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(split(node.sort_values("sid"), int(key[0]), int(key[1]), levels))

    levels = 6  # of the tree, that a task goes down at a time
    tree = quotas.select("sid", F.col("quota").cast("long"), F.lit(0).alias("low"), F.lit(shards).alias("high"))
    for _ in range(0, (shards - 1).bit_length(), levels):
        tree = tree.groupBy("low", "high").applyInPandas(descend, tree.schema)
    return tree.select("sid", F.col("low").alias("shard"), "quota")


def mix(docs: DataFrame, keep: Mix | None = None, seed: int = 17, **options) -> DataFrame:
    """The mixed documents themselves: the input's columns, a row per copy, shard by shard in shuffled order."""
    decided = keep or plan(docs, seed=seed, **options)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"),
        _hash(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("h"))
    drawn = (
        place(rows, decided.sources).join(decided.blocks, ["sid", "block"])
        .select("row", "h", F.explode(_taken()).alias("draw"))
        .select("row", "draw.shard", _hash(F.lit(seed), "h", "draw.epoch").alias("place"))
    )
    return drawn.repartitionById(decided.shards, F.col("shard")).sortWithinPartitions("shard", "place").select("row.*")
