"""Blocks of vectors with bounds, for scans that skip what cannot matter.

A block is one row of a few MB: vectors of one key and one length, packed into flat arrays, and a short summary of them. The summary
bounds the score of any vector of the block with any vector of another block:

* dense side: centroid and radius, so ``x . y <= c . d + |c| s + |d| r + r s`` for blocks (c, r) and (d, s);
* sparse side: the largest norm, and the weights in ``BUCKETS`` buckets of tokens, the largest weight and the largest sum
  of weights of a vector in each, so ``x . y <= sum over buckets of (largest sum in x) * (largest weight in y)``.

A key of many vectors is cut by the nearest of a few pivots (a bounded sample of its vectors' length), so that blocks are compact, and
then by a hash, so that none grows beyond its size: a key holding a third of all rows is many blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import staged

BUCKETS = 256
#: Pivots per vector length, and how many lengths (the most frequent) get some; blocks of others are cut by the hash alone.
PIVOTS, LENGTHS = 64, 8
#: Keys of more than so many blocks are cut by pivots.
MANY = 8
#: Keys of that many blocks in every partition are packed where they lie, if they need no pivots: without a shuffle, at the cost of one part-filled block each.
IN_PLACE = 4
#: Blocks are large rows: files hold few of them in a row group, which is what writers and readers keep in memory.
ROW_GROUP = {"parquet.block.row.count.limit": "16"}
SUMMARY = ("dim", "n", "centre", "radius", "norm", "top", "total")


def well_formed(rows: DataFrame) -> DataFrame:
    """Rows with a key and a dense side of finite numbers; the others take no part in a search (see ``malformed``)."""
    return rows.filter(_whole())


def malformed(rows: DataFrame) -> DataFrame:
    return rows.filter(~_whole())


def _whole():
    finite = F.forall("dense", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("key").isNotNull() & (F.size("dense") > 0) & finite, F.lit(False))


def blocks(rows: DataFrame, id_column: str, size: int, compact: bool = False, stage: bool = True) -> DataFrame:
    """One row per block of at most about ``size`` of ``rows`` (``id_column, key, dense, idx, val``), written once.

    Columns: ``block`` (its number), ``key``, the summary, and the packed ``ids, dense, rows, tokens, weights``. ``compact`` cuts large
    keys by pivots, which pays where many blocks are met by few others. ``stage=False``: ``rows`` are cheap to read again (stored
    or staged), so they are counted and packed without being written first.
    """
    rows = well_formed(rows).select(id_column, "key", "dense", "idx", "val").withColumn("dim", F.size("dense"))
    if stage:
        rows = staged(rows, "vectors")  # counted, sampled and packed: whatever makes the vectors runs once
    counts = rows.groupBy("key", "dim").agg(F.count("*").alias("rows"))
    large = counts.filter(F.col("rows") > MANY * size)
    cell, schema, here = ["key", "dim", "pivot", "part"], _packed_schema(rows.schema[id_column].dataType), None
    if not compact and not large.isEmpty():
        wide = counts.filter(F.col("rows") >= IN_PLACE * size * rows.rdd.getNumPartitions()).select("key", "dim")
        if not wide.isEmpty():
            here = rows.join(F.broadcast(wide), ["key", "dim"], "left_semi").mapInArrow(_pack_here(id_column, size), schema)
            rows, counts = (df.join(F.broadcast(wide), ["key", "dim"], "left_anti") for df in (rows, counts))
    if compact and not large.isEmpty():
        placed = _nearest(rows.join(large.select("key", "dim"), ["key", "dim"], "left_semi"), id_column, _pivots(rows, large))
        placed = placed.unionByName(rows.join(large.select("key", "dim"), ["key", "dim"], "left_anti").withColumn("pivot", F.lit(0)))
        counts = placed.groupBy("key", "dim", "pivot").agg(F.count("*").alias("rows"))
    else:
        placed = rows.withColumn("pivot", F.lit(0))
        counts = counts.withColumn("pivot", F.lit(0))
    parts = counts.select("key", "dim", "pivot", F.ceil(F.col("rows") / size).cast("int").alias("parts"))
    cut = placed.join(parts, ["key", "dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64(id_column, F.lit(23)), F.col("parts")).cast("int"))
    # sorted, not collected: the sort spills, and a task holds the rows of one block
    sorted_ = cut.select(*cell, id_column, "dense", "idx", "val").repartition(*cell).sortWithinPartitions(*cell)
    packed = sorted_.mapInArrow(_pack(id_column, cell), schema)
    if here is not None:
        packed = here.unionByName(packed)
    return staged(packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks", ROW_GROUP)


def _packed_schema(id_type: T.DataType) -> T.StructType:
    many = lambda t: T.ArrayType(t, False)
    return T.StructType([
        T.StructField("key", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("centre", many(T.DoubleType())), T.StructField("radius", T.DoubleType()), T.StructField("norm", T.DoubleType()),
        T.StructField("top", many(T.FloatType())), T.StructField("total", many(T.FloatType())),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("dense", many(T.DoubleType())), T.StructField("rows", many(T.IntegerType())),
        T.StructField("tokens", many(T.LongType())), T.StructField("weights", many(T.DoubleType())),
    ])


def _pivots(rows: DataFrame, large: DataFrame) -> dict[int, np.ndarray]:
    """A bounded sample of vectors per length: at most ``LENGTHS * PIVOTS`` vectors come to the driver."""
    lengths = [r["dim"] for r in large.groupBy("dim").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()]
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("dense")))
    some = rows.filter(F.col("dim").isin(lengths)).select("dim", "dense").withColumn("place", place).filter(F.col("place") <= PIVOTS)
    found: dict[int, list] = {}
    for r in some.collect():
        found.setdefault(r["dim"], []).append(r["dense"])
    return {dim: np.array(v, dtype=np.float64) for dim, v in found.items()}


def _nearest(rows: DataFrame, id_column: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            dense = batch.column(batch.schema.get_field_index("dense"))
            nearest = np.zeros(len(dim), np.int32)
            for d in np.unique(dim):
                if int(d) in pivots:
                    own, centres = np.flatnonzero(dim == d), pivots[int(d)]
                    x = flat(dense.take(pa.array(own))).reshape(len(own), d)
                    nearest[own] = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            yield batch.append_column("pivot", pa.array(nearest))

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField("pivot", T.IntegerType())]))


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _pack(id_column: str, cell: list[str]):
    """Rows sorted by ``cell`` to one row per cell."""
    block = _block(id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            codes = [pc.rank(batch.column(c), tiebreaker="dense").to_numpy() for c in cell]
            differs = np.any([x[1:] != x[:-1] for x in codes], axis=0)
            starts = [0, *(np.flatnonzero(differs) + 1), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(starts, starts[1:]):
                of = tuple(batch.column(c)[int(lo)].as_py() for c in cell)
                if of != now and held:
                    yield block(held, *now[:2])
                    held = []
                now = of
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield block(held, *now[:2])

    return run


def _pack_here(id_column: str, size: int):
    """Rows of a few keys, as they come, to rows of ``size`` vectors of one key and length; the last of each may hold fewer."""
    block = _block(id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        for batch in batches:
            codes = [pc.rank(batch.column(batch.schema.get_field_index(c)), tiebreaker="dense").to_numpy() for c in ("key", "dim")]
            for code in np.unique(np.stack(codes), axis=1).T:
                some = batch.take(pa.array(np.flatnonzero((codes[0] == code[0]) & (codes[1] == code[1]))))
                of = tuple(some.column(some.schema.get_field_index(c))[0].as_py() for c in ("key", "dim"))
                before = held.pop(of, [])
                while (room := size - sum(b.num_rows for b in before)) <= some.num_rows:
                    yield block([*before, some.slice(0, room)], *of)
                    before, some = [], some.slice(room)
                if before or some.num_rows:
                    held[of] = [*before, some]
        for of, some in held.items():
            yield block(some, *of)

    return run


def _block(id_column: str) -> Callable:
    """Batches of one key and length to one row."""
    names = [f.name for f in _packed_schema(T.LongType())]

    def block(parts: list[pa.RecordBatch], key: str, d: int) -> pa.RecordBatch:
        items = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids, n, dense, idx, val = items.column(id_column), items.num_rows, flat(items.column("dense")), items.column("idx"), items.column("val")
        dense = dense.reshape(n, d)
        lengths = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n, dtype=np.int32), lengths)
        tokens, weights = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat(val)
        centre = dense.mean(axis=0)
        size, bucket = np.abs(weights), (tokens % BUCKETS).astype(np.int64)
        sums = np.bincount(rows * np.int64(BUCKETS) + bucket, size, n * BUCKETS).reshape(n, BUCKETS)
        top = np.zeros(BUCKETS)
        np.maximum.at(top, bucket, size)
        up = lambda x: np.nextafter(x.astype(np.float32), np.float32(np.inf)) * (x > 0)  # noqa: E731  never below the double
        one = dict(
            key=key, dim=d, n=n, centre=centre, radius=float(np.sqrt(((dense - centre) ** 2).sum(axis=1).max())),
            norm=float(np.sqrt(np.bincount(rows, weights**2, n).max())), top=up(top), total=up(sums.max(axis=0)),
            ids=ids, dense=dense.ravel(), rows=rows, tokens=tokens, weights=weights)
        return pa.RecordBatch.from_arrays([_cell(one[c]) for c in names], names=names)

    return block


def _cell(v) -> pa.Array:
    """A column of one row."""
    if isinstance(v, (np.ndarray, pa.Array)):
        values = v if isinstance(v, pa.Array) else pa.array(v)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([v])


class BlockFiles:
    """A written block table whose tasks fetch the blocks they need themselves, a row group at a time, so that no block moves through a shuffle.

    Files are opened through ``pyarrow.fs`` by their URI. A block's number tells the task that wrote it, and so does its file's name: that file
    is looked into first, and the others only for blocks that are not in it.
    """

    def __init__(self, packed: DataFrame):
        self.paths = sorted(packed.inputFiles())
        self._parts: dict[int, list[str]] = {}
        for path in self.paths:
            if named := re.match(r"part-(\d+)", path.rsplit("/", 1)[-1]):
                self._parts.setdefault(int(named[1]), []).append(path)
        self._known: dict[str, tuple] = {}
        self._last: dict[tuple, tuple] = {}

    def read(self, blocks: Iterable[int], columns: tuple[str, ...], wanted: Callable[[int], bool] = lambda block: True) -> Iterator[dict]:
        """``block`` and ``columns`` of each, in the order of the files; ``wanted`` is asked again before a block is fetched."""
        for (path, group), rows in groupby(self._find(blocks), key=lambda at: at[:2]):
            rows = [at for at in rows if wanted(at[3])]
            if rows:
                column = self._group(path, group, columns)
                for _, _, row, block in rows:
                    if wanted(block):
                        yield {"block": block} | {c: _item(column[c][row], c) for c in columns}

    def _find(self, blocks: Iterable[int]) -> list[tuple]:
        left, found, looked = {int(b) for b in blocks}, [], set()
        likely = [path for part in sorted({b >> 33 for b in left}) for path in self._parts.get(part, [])]
        for path in (*likely, *self.paths):
            if not left:
                break
            if path not in looked:
                looked.add(path)
                at = self._file(path)[1]
                here = [b for b in left if b in at]
                found += [(path, *at[b], b) for b in here]
                left.difference_update(here)
        if left:
            raise ValueError(f"{len(left)} blocks are in none of their {len(self.paths)} files")
        return sorted(found)

    def _file(self, path: str) -> tuple:
        """(metadata, place of each block)."""
        if path not in self._known:
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                file = pq.ParquetFile(f)
                groups = [file.metadata.row_group(i).num_rows for i in range(file.metadata.num_row_groups)]
                numbers = file.read(columns=["block"], use_threads=False).column(0).to_pylist()
            places = ((group, row) for group, n in enumerate(groups) for row in range(n))
            self._known[path] = file.metadata, dict(zip(numbers, places))
        return self._known[path]

    def _group(self, path: str, group: int, columns: tuple[str, ...]) -> dict[str, pa.Array]:
        """One row group; the last one stays at hand, since the next cell often begins in it."""
        at, column = self._last.get(columns, (None, None))
        if at != (path, group):
            self._last.pop(columns, None)
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                table = pq.ParquetFile(f, metadata=self._file(path)[0]).read_row_group(group, columns=list(columns), use_threads=False)
            column = {c: table.column(c).combine_chunks() for c in columns}
            self._last[columns] = (path, group), column
        return column


def _item(value: pa.Scalar, column: str):
    if not isinstance(value, pa.ListScalar):
        return value.as_py()
    return value.values if column == "ids" else value.values.to_numpy(zero_copy_only=False)


def bands(packed: DataFrame, size: int) -> DataFrame:
    """``key, dim, band, own``: blocks of one key and length together in bands of about ``size`` vectors, named by their first block."""
    of = Window.partitionBy("key", "dim")
    before = F.sum("n").over(of.orderBy("block")) - F.col("n")
    placed = packed.select("block", "key", "dim", "n").withColumn("_band", F.floor(before / size))
    return placed.groupBy("key", "dim", "_band").agg(F.min("block").alias("band"), F.collect_list("block").alias("own")).drop("_band")


def summaries(packed: DataFrame, prefix: str) -> DataFrame:
    """The narrow side of a block table: its number, key and summary, names behind a prefix."""
    return packed.select(F.col("block").alias(f"{prefix}block"), "key", "dim", *[F.col(c).alias(f"{prefix}{c}") for c in SUMMARY if c != "dim"])


def bounds(pairs: DataFrame, alpha: float) -> DataFrame:
    """``a_block, b_block, bound`` of pairs of summaries (``a_...``, ``b_...``): no score of the two blocks is above ``bound``."""
    schema = "a_block long, b_block long, bound double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            number = lambda c: get(c).to_numpy()
            dim, bound = number("dim"), np.zeros(batch.num_rows)
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                c, e = (flat(get(x).take(pa.array(own))).reshape(len(own), d) for x in ("a_centre", "b_centre"))
                r, s, cn, en = number("a_radius")[own], number("b_radius")[own], np.linalg.norm(c, axis=1), np.linalg.norm(e, axis=1)
                t, w = (flat(get(x).take(pa.array(own))).reshape(len(own), BUCKETS) for x in ("a_total", "b_top"))
                bound[own] = _bound(alpha, (c * e).sum(axis=1), cn, r, en, s, (t * w).sum(axis=1), number("a_norm")[own] * number("b_norm")[own])
            yield pa.RecordBatch.from_arrays([get("a_block"), get("b_block"), pa.array(bound)], names=["a_block", "b_block", "bound"])

    return pairs.mapInArrow(run, schema)


def _bound(alpha: float, middle, cn, r, en, s, shared, norms):
    """From products of centres, their norms and radii, products of bucketed weights and of sparse norms; arrays that broadcast."""
    spread = cn * s + en * r + r * s
    dense = middle + spread if alpha >= 0 else middle - spread
    sparse = np.minimum(shared, norms)
    return alpha * dense + abs(1 - alpha) * sparse + 1e-9 * (1 + abs(alpha) * (cn + r) * (en + s) + abs(1 - alpha) * sparse)


def bound_matrix(own: list[dict], others: list[dict], alpha: float) -> np.ndarray:
    """``bounds`` of every pair of two lists of summaries."""
    stack = lambda rows, c: np.array([x[c] for x in rows], dtype=np.float64)
    c, e = stack(own, "centre"), stack(others, "centre")
    column = lambda x: x[:, None]
    with np.errstate(invalid="ignore"):  # weights that are no numbers make no bound, and a pair without one goes on
        return _bound(alpha, c @ e.T, column(np.linalg.norm(c, axis=1)), column(stack(own, "radius")), np.linalg.norm(e, axis=1), stack(others, "radius"),
                      stack(own, "total") @ stack(others, "top").T, column(stack(own, "norm")) * stack(others, "norm"))
