"""Exact top-k search by inner product over integer-coded vectors, pruned by segment statistics.

Coarse to fine: for a segment of L components with means m and deviations s, the inner product of two
vectors over it is at most L (m m' + s s'). Summed over segments this bounds the score (equivalently, bounds the
distance from below); a pair goes on to the next, finer segmentation only while its bound reaches the query's
k-th best score so far, and survivors are computed exactly.

Queries are cut into blocks and vectors into stripes; a task streams the vectors of one stripe past one block of
queries, holding that block and k results per query, and sends on at most k rows per query. Number of blocks:
queries / ``block``; stripes are only as many as the cores need, so copies of queries stay few. The best k over
stripes are then ranked per query, which Spark prunes before the shuffle. No cross join, no pairs in the plan.

Cases: a vector that is null or empty, holds a null or non-finite component, or has no id takes no part. Components
of any size are scored exactly; where a code or a score among the best leaves the long range, the job fails and says so. Vectors of different
lengths are never compared. Repeated candidate rows all count; a repeated query id is one query (its smallest
vector) and never its own candidate. Ties go to the smaller id. An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENTS = (4, 16)


def codes(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as longs; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    ok = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    held = lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale).cast("long")).otherwise(
        F.raise_error(F.lit("a component's code does not fit in a long")).cast("long"))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(x, held))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, cells: int | None = None,
    segments: tuple[int, ...] = SEGMENTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two tables (id long, codes array<long>)."""
    spark = vectors.sparkSession
    asked = queries.groupBy("id").agg(F.min("codes").alias("codes"))
    n_blocks = max(1, math.ceil(queries.select("id").count() / block))
    cells = cells or 4 * max(6, spark.sparkContext.defaultParallelism)
    stripes = max(1, math.ceil(cells / n_blocks))
    cell = lambda b, s: (b * stripes + s).cast("int").alias("cell")
    spread = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n))
    left = asked.select("id", "codes", F.lit(0).alias("side"), spread("id", n_blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("s"))
    right = vectors.select("id", "codes", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), spread("id", stripes, 2).alias("s"))
    grid = left.unionByName(right).select("id", "codes", "side", cell(F.col("b"), F.col("s")), F.size("codes").alias("dim"))
    ordered = grid.repartitionById(n_blocks * stripes, F.col("cell")).sortWithinPartitions("cell", "dim", "side")
    found = ordered.mapInArrow(_scan(k, segments), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(k: int, segments: tuple[int, ...]):
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        state = None
        for batch in batches:
            cell, dim, side = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "dim", "side"))
            if not len(cell):
                continue
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(dim) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cell)]):
                part = batch.slice(lo, hi - lo)
                ids = part.column(part.schema.get_field_index("id")).to_numpy()
                rows = part.column(part.schema.get_field_index("codes")).flatten().to_numpy().reshape(hi - lo, dim[lo])
                where = (cell[lo], dim[lo])
                if state is None or state.where != where:
                    if state:
                        yield from state.results(shape)
                    state = _Best(where, k, segments)
                if side[lo] == 0:
                    state.add_queries(ids, rows)
                else:
                    for at in range(0, hi - lo, 1024):
                        state.see(ids[at:at + 1024], rows[at:at + 1024])
        if state:
            yield from state.results(shape)

    return run


class _Best:
    """The k best so far of the queries of one cell."""

    def __init__(self, where, k: int, segments: tuple[int, ...]):
        self.where, self.k, self.segments = where, k, segments
        self.parts: list = []
        self.ids = None

    def add_queries(self, ids, rows) -> None:
        self.parts.append((ids, rows))

    def _ready(self) -> None:
        self.ids = np.concatenate([p[0] for p in self.parts])
        self.rows = np.concatenate([p[1] for p in self.parts])
        self.stats = [_stats(self.rows, n) for n in self.segments if n < self.rows.shape[1]]
        self.floor = np.full(len(self.ids), -np.inf)
        self.q, self.v, self.score = (np.empty(0, np.int64) for _ in range(3))

    def see(self, ids, rows) -> None:
        if not self.parts:
            return
        if self.ids is None:
            self._ready()
        qs, vs = np.arange(len(self.ids)), np.arange(len(ids))
        alive = None
        for own, n in zip(self.stats, [n for n in self.segments if n < rows.shape[1]]):
            theirs = _stats(rows, n)[vs]
            error = 1e-12 * np.outer(np.linalg.norm(own[qs], axis=1), np.linalg.norm(theirs, axis=1))  # of rounding, terms may cancel
            reach = own[qs] @ theirs.T + 0.5 + error >= self.floor[qs, None]
            alive = reach if alive is None else alive & reach
            keep_q, keep_v = alive.any(axis=1), alive.any(axis=0)
            qs, vs, alive = qs[keep_q], vs[keep_v], alive[keep_q][:, keep_v]
            if not len(qs) or not len(vs):
                return
        score = _products(self.rows[qs], rows[vs])
        hit = (score >= self.floor[qs, None]) & (self.ids[qs, None] != ids[None, vs])
        if alive is not None:
            hit &= alive
        a, b = np.nonzero(hit)
        if score.dtype == object and any(not -(2**63) <= x < 2**63 for x in score[a, b]):
            raise OverflowError("a score does not fit in a long")
        self.q, self.v = np.concatenate([self.q, qs[a]]), np.concatenate([self.v, ids[vs[b]]])
        self.score = np.concatenate([self.score, score[a, b].astype(np.int64)])
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.v, -self.score, self.q))
        q = self.q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        order = order[place < self.k]
        self.q, self.v, self.score = self.q[order], self.v[order], self.score[order]
        full = place[place < self.k] == self.k - 1
        self.floor[self.q[full]] = self.score[full]

    def results(self, shape):
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[self.q], self.v, self.score)], schema=shape)


def _stats(rows: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of n segments, scaled so that the inner product of two such rows is the bound."""
    pieces = np.array_split(rows.astype(np.float64), n, axis=1)
    size = np.sqrt([p.shape[1] for p in pieces])
    return np.concatenate([np.stack([p.mean(axis=1) for p in pieces], 1) * size, np.stack([p.std(axis=1) for p in pieces], 1) * size], 1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum stays below 2^53, in longs below 2^63, else in whole numbers of any size."""
    worst = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if worst < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T if worst < 2**62 else a.astype(object) @ b.astype(object).T
