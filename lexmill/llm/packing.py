"""Hierarchical packing of documents into training sequences of several context sizes.

A task encodes the documents of its split, and packs them block by block (``block_tokens`` ids, a parameter
that bounds its memory; a longer document is a block). In a block every document is cut into full windows of
the longest size and a rest; a rest goes to the tier of the smallest context size that holds it. From the
longest tier down each rest opens a window, whose gap takes the longest rests of shorter tiers that fit and,
last, the head of a rest cut to measure. What remains at the end of a block is cut at powers of two, so no
sequence has padding. The sequences of a block are dealt to step groups of nearly equal numbers of ids.

Nothing is shuffled, no group of equal keys meets in a task, and a lost task is repeated with the same result:
sequence and group ids come from the number of the split and a count in it.

Cases: a null text is empty (its end id alone), a null ``doc_id`` stays null, repeated rows are packed each,
an empty table gives no piece. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common
from .tokens import Encoder

TIERS = (512, 1024, 2048, 4096)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier int, step_group long, ids binary"
)
_TYPES = dict(
    doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), doc_tokens=pa.int64(), sequence_id=pa.int64(),
    offset=pa.int64(), sequence_tokens=pa.int64(), tier=pa.int32(), step_group=pa.int64(), ids=pa.binary(),
)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, block_tokens: int = 2_000_000,
    step_tokens: int = 65_536, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document; ``with_ids`` adds its ids (little-endian unsigned 32-bit)."""
    end = end_id.to_bytes(4, "little")

    def work(slices):
        encoder, base, n_seq, n_group = Encoder.of(tokenizer), TaskContext.get().partitionId() << 40, 0, 0
        block, held = [], 0

        def close():
            nonlocal n_seq, n_group
            sequences = plan([len(ids) // 4 for _, ids in block], tiers)
            groups = deal([sum(n for _, _, n in s) for s in sequences], step_tokens)
            rows = {k: [] for k in _TYPES}
            for k, (pieces, group) in enumerate(zip(sequences, groups)):
                total, at = sum(n for _, _, n in pieces), 0
                tier = next(t for t in tiers if t >= total)
                for d, start, n in pieces:
                    doc_id, ids = block[d]
                    own = ids[4 * start:4 * (start + n)]
                    for name, v in zip(rows, (doc_id, start, n, zlib.crc32(own), len(ids) // 4, base + n_seq + k, at, total, tier, base + n_group + group, own if with_ids else None)):
                        rows[name].append(v)
                    at += n
            n_seq += len(sequences)
            n_group += max(groups, default=-1) + 1
            return rows

        for rows in slices:
            for doc_id, ids in zip(rows["doc_id"], encoder.encode(rows["text"])):
                block.append((doc_id, ids + end))
                held += len(ids) // 4 + 1
                if held >= block_tokens:
                    yield close()
                    block, held = [], 0
        if block:
            yield close()

    out = common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")), _TYPES, SCHEMA, work)
    return out if with_ids else out.drop("ids")


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length): all full at a tier's size, but for powers of two at the end."""
    longest, out, pool = tiers[-1], [], []
    for d, n in enumerate(lengths):
        full = n - n % longest
        out += [[(d, at, longest)] for at in range(0, full, longest)]
        if n > full:
            pool.append((n - full, d, full))
    pool.sort()
    last: list[tuple[int, int, int]] = []
    for size in reversed(tiers):
        floor = max((t for t in tiers if t < size), default=0)
        while pool and pool[-1][0] > floor:
            room, pieces = size, []
            while room and pool:
                k = bisect_right(pool, (room, len(lengths), 0)) - 1
                n, d, at = pool.pop(k) if k >= 0 else pool.pop(0)
                take = min(n, room)
                pieces.append((d, at, take))
                if take < n:
                    insort(pool, (n - take, d, at + take))
                room -= take
            if room:
                last += pieces  # the pool is empty
            else:
                out.append(pieces)
    rest = sum(n for _, _, n in last)
    while rest:
        room, pieces = 1 << (rest.bit_length() - 1), []
        rest -= room
        while room:
            d, at, n = last.pop(0)
            take = min(n, room)
            pieces.append((d, at, take))
            room -= take
            if take < n:
                last.insert(0, (d, at + take, n - take))
        out.append(pieces)
    return out


def deal(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence, the longest first to the group that has least."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    groups = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, g = heap[0]
        groups[k] = g
        heapq.heapreplace(heap, (load + sizes[k], g))
    return groups
