"""Exact top-k retrieval by hybrid score, without a cross join.

A *target* is a question aimed at one key (a namespace, or an article inside one). A target meets only vectors of
its key and length. Both sides are packed into blocks with bounds and written once (``vector_blocks``); what meets by equality of key and length
are numbers of blocks. A task gets a band of target blocks and the numbers of the vector blocks of their key. It fetches its targets and the vector blocks'
summaries from the files, scores every target block against the few blocks with the highest bounds, and from then on knows a k-th best score of each target:
of the other blocks it fetches those whose bound reaches the least of them, a slice at a time. Blocks move through no shuffle, so what is written grows with the
input and not with the pairs; a task holds one band of targets and one slice of vectors, and at most k rows per target leave it. Where there are fewer
bands than cores, a band's vector blocks are shared out to several tasks.

Nothing is collected but a bounded sample of vectors for the cuts of large keys, and there is one plan for any number of targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import constants as K
from ..session import staged
from .vector_blocks import ROW_GROUP, BlockFiles, bands, blocks, bound_matrix

TARGET_BLOCK, VECTOR_BLOCK = 256, 256
#: Targets of a band, which one task holds.
BAND = 4096
#: Bands that begin among so many blocks go to one task: where keys are small, their vectors lie together too.
RUN = 16
#: Vector blocks that a task has at least where a band's are shared out to several tasks.
SHARE = 8
#: Vectors that are scored at once, and how many of their tokens at most are multiplied as a matrix: those that one vector in RARE or more holds.
SLICE, COMMON, RARE = 2048, 512, 32
#: Blocks of vectors that a block of targets meets before bounds decide.
FIRST_BLOCKS = 2
# Digits kept for ranking and gates: enough to tell scores apart, few enough that equal vectors stay ties
# whatever the order of summation.
SCORE_DIGITS = 12
_MATCH_SLICE = 4_000_000


def _sparse(rows: np.ndarray, tokens: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, weight) of a sparse side in the order of tokens."""
    order = np.argsort(tokens, kind="stable")
    return tokens[order], rows[order], weights[order]


class _Slice:
    """Some vector blocks, made ready to be scored against any number of target blocks."""

    def __init__(self, parts: list[dict], dim: int):
        sizes = [len(p["dense"]) // dim for p in parts]
        self.sizes = sizes
        self.ids = pa.concat_arrays([p["ids"] for p in parts])
        self.dense = np.concatenate([p["dense"] for p in parts]).reshape(-1, dim)
        starts = np.cumsum([0, *sizes[:-1]])
        rows = np.concatenate([p["rows"].astype(np.int64) + at for p, at in zip(parts, starts)])
        sparse = _sparse(rows, *(np.concatenate([p[c] for p in parts]) for c in ("tokens", "weights")))
        self.common, self.matrix, self.rare = _split(sparse, len(self.dense))


def _split(sparse, n: int):
    """(common tokens, their weights as a matrix, postings of the others). Weights that are no numbers stay postings."""
    tokens, rows, weights = sparse
    names, first, counts = np.unique(tokens, return_index=True, return_counts=True)
    usable = counts * RARE >= n
    if len(names):
        usable &= np.logical_and.reduceat(np.isfinite(weights), first)
    often = np.flatnonzero(usable)
    often = np.sort(often[np.argsort(-counts[often], kind="stable")[:COMMON]])
    common = names[often]
    place, is_common = _places(tokens, common)
    width = len(common)
    matrix = np.bincount(rows[is_common] * width + place[is_common], weights[is_common], n * width).reshape(n, width)
    return common, matrix, tuple(x[~is_common] for x in sparse)


def _places(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(common):
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    place = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    return place, common[place] == tokens


def _matches(score: np.ndarray, factor: float, targets, vectors) -> None:
    """Add the products of equal tokens of two postings."""
    (tok, owner, weight), (tokens, rows, values), width = targets, vectors, score.shape[1]
    lo, hi = np.searchsorted(tok, tokens, "left"), np.searchsorted(tok, tokens, "right")
    some = hi > lo
    lo, hi, rows, values = lo[some], hi[some], rows[some], values[some]
    ends, at = np.cumsum(hi - lo), 0
    while at < len(lo):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _MATCH_SLICE, "right")))
        n = (hi - lo)[at:to]
        rep = np.repeat(np.arange(at, to), n)
        hit = np.repeat(lo[at:to] - (np.cumsum(n) - n), n) + np.arange(len(rep))
        score += factor * np.bincount(owner[hit] * width + rows[rep], weight[hit] * values[rep], minlength=score.size).reshape(score.shape)
        at = to


def _scores(dense: np.ndarray, sparse, of: _Slice, alpha: float) -> np.ndarray:
    score = alpha * (dense @ of.dense.T)
    tokens, rows, weights = sparse
    place, is_common = _places(tokens, of.common)
    if not np.isfinite(weights[is_common]).all():  # no number times zero is no zero: matched one by one
        at, column = np.nonzero(of.matrix)
        order = np.argsort(column, kind="stable")
        _matches(score, 1.0 - alpha, sparse, (of.common[column[order]], at[order], of.matrix[at[order], column[order]]))
    elif is_common.any():
        width = len(of.common)
        own = np.bincount(rows[is_common] * width + place[is_common], weights[is_common], len(dense) * width).reshape(-1, width)
        score += (1.0 - alpha) * (own @ of.matrix.T)
    _matches(score, 1.0 - alpha, tuple(x[~is_common] for x in sparse), of.rare)
    return np.round(score, SCORE_DIGITS)


def _best(score: np.ndarray, vec_ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, vector) places of the best k per target: highest score, then lowest vector id."""
    width = score.shape[1]
    if width > k:  # every vector that reaches the k-th best score, ties included
        least = np.partition(score, width - k, axis=1)[:, width - k]
        row, col = np.nonzero(score >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(score.shape))
    kept = _first_of_each(row, score[row, col], vec_ids.take(pa.array(col)), k)
    return row[kept], col[kept]


def _first_of_each(row: np.ndarray, score: np.ndarray, vec_ids: pa.Array, k: int) -> np.ndarray:
    """Places of the best k of every row, by row: highest score, then lowest vector id."""
    by_id = pa.compute.rank(vec_ids, tiebreaker="dense").to_numpy()
    order = np.lexsort((by_id, -score, row))
    ordered = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered, "left") < k]


class _Target:
    """A target block and the best vectors found so far for each of its targets."""

    def __init__(self, row: dict, dim: int, k: int):
        self.ids, self.key, self.k = row["ids"], row["key"], k
        self.dense, self.sparse = row["dense"].reshape(-1, dim), _sparse(*(row[c] for c in ("rows", "tokens", "weights")))
        self.kth = np.full(len(self.dense), -np.inf)
        self.forget()

    def forget(self) -> None:
        """Drop what was found; its scores still rule others out."""
        self.place, self.vec_ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def meet(self, of: _Slice, wanted: np.ndarray, alpha: float) -> None:
        score, ids = _scores(self.dense, self.sparse, of, alpha), of.ids
        if not wanted.all():
            at = np.flatnonzero(np.repeat(wanted, of.sizes))
            score, ids = score[:, at], ids.take(pa.array(at))
        row, col = _best(score, ids, self.k)
        value = score[row, col]
        kept = np.flatnonzero(~(value < self.kth[row]))
        row, value, ids = row[kept], value[kept], ids.take(pa.array(col[kept]))
        if self.vec_ids is not None:
            row, value, ids = np.concatenate([self.place, row]), np.concatenate([self.score, value]), pa.concat_arrays([self.vec_ids, ids])
            kept = _first_of_each(row, value, ids, self.k)
            row, value, ids = row[kept], value[kept], ids.take(pa.array(kept))
        self.place, self.score, self.vec_ids = row, value, ids
        n = np.bincount(row, minlength=len(self.kth))
        full = np.flatnonzero(n >= self.k)
        self.kth[full] = np.maximum(self.kth[full], value[np.cumsum(n)[full] - 1])


def _scored(cells: DataFrame, targets: BlockFiles, vectors: BlockFiles, id_types: list, k: int, alpha: float, first: int) -> DataFrame:
    """``query_id, key, vec_id, score``: the best k of every cell for each of its targets.

    ``cells``: ``dim``, the target blocks ``own``, the vector blocks they ``meet``, and which one of how many ``shares`` of these the cell has.
    """
    payload = ("ids", "dense", "rows", "tokens", "weights")
    bounding = ("centre", "radius", "norm")
    schema = T.StructType([
        T.StructField("query_id", id_types[0]), T.StructField("key", T.StringType()), T.StructField("vec_id", id_types[1]), T.StructField("score", T.DoubleType())])

    def best(dim: int, own: list[int], meets: list[int], share: int, shares: int) -> list[_Target]:
        rows = list(targets.read(own, ("key", *bounding, "total", *payload)))
        others = list(vectors.read(meets, (*bounding, "top")))
        names = [x["block"] for x in others]
        at, bound = {b: i for i, b in enumerate(names)}, bound_matrix(rows, others, alpha)
        asked = [_Target(row, dim, k) for row in rows]
        del rows, others
        least = np.full(len(asked), -np.inf)

        def walk(todo: np.ndarray) -> None:
            open_ = lambda of: todo[:, of] & ~(bound[:, of] < (least if np.ndim(of) == 0 else least[:, None]))
            parts, n = [], 0

            def score() -> None:
                of, places = _Slice(parts, dim), [at[p["block"]] for p in parts]
                for i, wanted in enumerate(open_(places)):
                    if wanted.any():
                        asked[i].meet(of, wanted, alpha)
                        least[i] = asked[i].kth.min()

            for part in vectors.read([names[i] for i in np.flatnonzero(todo.any(axis=0))], payload, lambda b: open_(at[b]).any()):
                parts.append(part)
                n += len(part["dense"]) // dim
                if n >= SLICE:
                    score()
                    parts, n = [], 0
            if parts:
                score()

        todo = np.zeros(bound.shape, bool)
        for i, of in enumerate(bound):
            todo[i, np.lexsort((names, -of))[:first]] = True
        walk(todo)
        if shares > 1:  # the nearest blocks may belong to other shares: they count only as a measure
            for target in asked:
                target.forget()
            todo = np.ones(bound.shape, bool)
            todo[:, np.array_split(np.arange(len(names)), shares)[share]] = False
        walk(~todo)
        return asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                for target in best(**cell):
                    if target.vec_ids is not None:
                        yield pa.RecordBatch.from_arrays([
                            target.ids.take(pa.array(target.place)), pa.array([target.key] * len(target.place), pa.string()),
                            target.vec_ids, pa.array(target.score)], names=schema.names)

    return cells.mapInArrow(run, schema)


def pack(vectors: DataFrame, size: int = VECTOR_BLOCK, stage: bool = True) -> DataFrame:
    """Vectors (``vec_id, key, dense, idx, val``) as blocks that any number of searches read in place of the rows."""
    return blocks(vectors, "vec_id", size, compact=True, stage=stage)


def is_packed(vectors: DataFrame) -> bool:
    return "block" in vectors.columns


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = K.TOP_K, alpha: float = K.ALPHA, target_block: int = TARGET_BLOCK,
    vector_block: int = VECTOR_BLOCK, first: int = FIRST_BLOCKS, stage: bool = True,
) -> DataFrame:
    """``(query_id, key, vec_id, score, rank)``: the k best vectors of each target's key and length.

    Score: ``alpha * dense dot + (1 - alpha) * sparse dot``, kept to 12 decimals for ranks and gates; ties
    go to the lower vector id. Vectors and targets without a key or a dense side of finite numbers take no part
    (``vector_blocks.malformed`` lists them). ``vectors`` may be ``pack``ed before: then a search reads their summaries
    and the blocks whose bounds can matter. ``first`` blocks are met before bounds decide. ``stage=False``: both tables are cheap to read again.
    """
    packed = is_packed(vectors)
    asked, stored = blocks(queries, "query_id", target_block, stage=stage), vectors if packed else pack(vectors, vector_block, stage)
    if packed and not stored.inputFiles():
        stored = staged(stored, "vector-blocks", ROW_GROUP)
    spark, counts = queries.sparkSession, [df.count() for df in (asked, stored)]
    least_bands = max(1, -(-counts[0] * target_block // BAND))
    shares = max(1, min(2 * spark.sparkContext.defaultParallelism // least_bands, counts[1] // SHARE))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * shares * least_bands)
    meets = stored.groupBy("key", "dim").agg(F.collect_list("block").alias("meets"))
    shared = F.greatest(F.lit(1), F.least(F.lit(shares), F.floor(F.size("meets") / SHARE).cast("int")))
    cells = bands(asked, BAND).join(meets, ["key", "dim"]).withColumn("shares", shared).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    cells = cells.repartition(tasks, F.floor(F.col("band") / RUN), "share").sortWithinPartitions("band").select("dim", "own", "meets", "share", "shares")
    id_types = [df.schema["ids"].dataType.elementType for df in (asked, stored)]
    found = _scored(cells, BlockFiles(asked), BlockFiles(stored), id_types, k, alpha, first)
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
