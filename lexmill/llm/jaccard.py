"""Exact Jaccard join of documents on word n-grams by universe partition and the pigeonhole principle.

Sets of 64-bit n-gram hashes fall into size classes; class c takes the sizes from L(c) up to those whose partner
may still have fewer than L(c+1), so every pair that can link shares a class. Two linked sets of a class differ in
at most H elements. The hash universe is cut into segments, and a segment's key is the sum of its elements' hashes.
A class has one of two allocations, whichever costs less by its number of keys and the weakness of short segments:

* H + 1 segments by their keys alone: linked sets agree in at least one whole segment;
* floor(H/2) + 1 larger segments by their keys and those of their one-deletion neighbourhoods (the sum less each
  element): linked sets differ by at most one element in at least one segment.

The key of no elements would be shared by very many sets, so it is left out and E segments are added, E being about
the most that are expected to be that short in one set. A set in which more are (and any partner that
meets it only in such segments is such a set too) adds the keys of another partition of the universe, up to
``LEVELS`` times; only then do keys of no elements stand.

Copies of one set are one class from the start, and only the first of a class makes keys. Nearly all keys are met once, so
(id, key) rows are not what is shuffled first: a task sends the sorted, gap-coded key numbers of many sets, one packed
value per range of numbers, and ranges answer with the numbers met twice; only (id, key) rows of those follow. A number has
12 bits more than the count of keys asks for, so few keys meet by chance, and none that is shared is missed.

A set whose keys are met elsewhere too seldom for any link (``keys_and_need``) goes before its elements are asked for.

Keys meet as grouped minima: every set under a key that others
share is first compared with the smallest id there. A set's elements that no other candidate has bound what any other
can share with it,
so many sets that only resemble each other drop out before any comparison. Links join components; only keys that still hold several
components are gone through, across components: pair by pair where few sets are left under a key, and by matrix
products of blocks of sets where many are. So a group of many near copies costs one comparison
a member and key, not all pairs. Comparison is of whole sets, computed again from the texts of candidates only.

Cases: a null text and one without words have no set and link with nothing; a text of fewer words than n has its
whole word sequence as its one element; a null ``doc_id`` has no component; rows that repeat an id count as
one document; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .components import components

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's distinct n-grams as sorted hashes. Words are split at ASCII white space, A-Z lower-cased."""
    import xxhash

    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*words)}
    out = []
    for w in words:
        h = np.fromiter([of[x] for x in w], U, len(w))
        k = min(n, len(h))
        grams = np.full(max(0, len(h) - k + 1) if k else 0, U(k))
        for i in range(k):
            grams = mix(grams * _A + h[i:len(h) - k + 1 + i] + _B)
        out.append(np.unique(grams))
    return out


class Classes:
    """Size classes and their segment counts for a threshold of percent / 100; without ``deletion`` all by whole segments."""

    def __init__(self, percent: int, ratio: float = 1.25, deletion: bool = True):
        self.p, self.ways = percent, (False, True) if deletion else (False,)
        first = 1
        while self.differences(2 * first + 1) == 0:  # smaller sets link only with equal ones or the next size
            first += 1
        self.low = [1, first] if first > 1 else [1]
        self.ratio = ratio

    def differences(self, sizes: int) -> int:
        """The most elements in which linked sets of these sizes together can differ."""
        return sizes * (100 - self.p) // (100 + self.p)

    def of(self, size: int) -> list[int]:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * self.ratio)))
        c = next(i for i in range(len(self.low) - 1, -1, -1) if self.low[i] <= size)
        found = [c]
        while c and self.p * size <= 100 * (self.low[c] - 1):  # a partner may be in the class below
            c -= 1
            found.append(c)
        return found

    def allocation(self, c: int) -> tuple[int, int, bool]:
        """Segments, how many of them may be too short, and whether by one-deletion neighbourhoods."""
        while len(self.low) <= c + 1:
            self.of(self.low[-1])
        low, most = self.low[c], self.differences(2 * (100 * (self.low[c + 1] - 1) // self.p))
        if not most:
            return 0, 0, False  # only equal sets link, and these are one class already
        options = []
        for deletion in self.ways:
            m = most // 2 + 1 if deletion else most + 1
            for _ in range(8):  # E depends on m, and m on E
                t = low / m
                short = m * math.exp(-t) * (1 + t if deletion else 1)
                extra = min(m - 1, math.ceil(short + 3 * math.sqrt(short))) if m > 1 else 0
                m = (most // 2 if deletion else most) + 1 + extra
            cost = (m + low if deletion else m) * (1 + 1000 * math.exp(-low / m))
            options.append((cost, (m, extra, deletion)))
        return min(options)[1]


LEVELS = 4


def keys(grams: np.ndarray, classes: Classes, known: dict) -> np.ndarray:
    """All keys of a set, as 64-bit numbers."""
    return keys_and_need(grams, classes, known)[0]


def keys_and_need(grams: np.ndarray, classes: Classes, known: dict) -> tuple[np.ndarray, int]:
    """All keys of a set, and how many of them at least any linked set has too.

    An element in which two sets differ spoils one segment. So of m segments all but as many agree as linked sets of these
    sizes can differ in, and those of them that are not empty give both sets a key.
    """
    out, least, size = [], [], len(grams)
    for c in classes.of(size):
        if c not in known:
            known[c] = classes.allocation(c)
        m, extra, deletion = known[c]
        if not m:
            continue
        for level in range(LEVELS):
            marks = mix(grams + _C * U(level + 1))
            seg = (marks % U(m)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            seg, inner = seg[order], mix(marks[order] + _A)
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sums, full, sizes = np.add.reduceat(inner, starts), seg[starts], np.diff(np.r_[starts, len(seg)])
            place = mix((np.arange(m, dtype=U) + U(m) * U(level)) * _B + U(c))
            out.append(mix(sums + place[full]))
            short = m - len(full)
            if level == 0:  # in its own class a set meets larger ones too, in the class below only that class's sizes
                partner = 100 * size // classes.p if not least else classes.low[c + 1] - 1
                least.append(1 if deletion else m - classes.differences(size + partner) - short)
            if deletion:
                longer = np.repeat(sizes > 1, sizes)
                out.append(mix(np.repeat(sums, sizes)[longer] - inner[longer] + place[seg[longer]]))
                short += int((sizes == 1).sum())
            if short <= extra:
                break
            if level == LEVELS - 1:
                some = full[sizes > 1] if deletion else full
                out.append(mix(np.delete(place, some)))
    return np.concatenate(out) if out else np.empty(0, U), max(1, min(least, default=1))


def identities(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2``: a set's size and its 128-bit identity."""

    def work(slices):
        for rows in slices:
            sets = ngram_sets(rows["text"], n)
            with np.errstate(over="ignore"):
                yield {
                    "doc_id": rows["doc_id"], "n_shingles": [len(s) for s in sets],
                    "k1": [int(mix(s + _A).sum(dtype=U).view(np.int64)) for s in sets],
                    "k2": [int(mix(s + _B).sum(dtype=U).view(np.int64)) for s in sets],
                }

    return common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")),
        {c: pa.int64() for c in ("doc_id", "n_shingles", "k1", "k2")}, "doc_id long, n_shingles long, k1 long, k2 long", work)


def numbers_of(packed: bytes, width: int) -> np.ndarray:
    """Key numbers of ``width`` bytes each."""
    wide = np.zeros((len(packed) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8")


def key_sets(docs: DataFrame, firsts: DataFrame, n: int, percent: int, deletion: bool, bits: int) -> DataFrame:
    """``id, size, need, keys``: the keys of the documents named, as numbers of ``bits`` bits in whole bytes.

    A set that links shares at least ``need`` of its keys with others.

    A few copies may pass the bitmap of ``firsts`` too; they only add rows that a later join leaves out.
    """
    bitmap, width = common.members(firsts, "id"), -(-bits // 8)

    def work(slices):
        classes, known = Classes(percent, deletion=deletion), {}
        for rows in slices:
            met = common.is_member(bitmap, np.array(rows["id"], np.int64))
            sets = ngram_sets([t for t, k in zip(rows["text"], met) if k], n)
            out = {"id": [i for i, k in zip(rows["id"], met) if k], "size": [len(s) for s in sets], "need": [], "keys": []}
            with np.errstate(over="ignore"):
                for s in sets:
                    own, need = keys_and_need(s, classes, known) if len(s) else (np.empty(0, U), 1)
                    numbers = np.unique(own >> U(64 - bits))
                    out["need"].append(max(1, need - len(own) + len(numbers)))  # keys that became one number count once
                    out["keys"].append(numbers.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), common.text_or_empty().alias("text")).filter("id is not null")
    return common.map_batches(
        rows, {"id": pa.int64(), "size": pa.int64(), "need": pa.int64(), "keys": pa.binary()}, "id long, size long, need long, keys binary", work)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as the first of them and gaps: the low bits of every gap, and the rest of it in unary."""
    gaps = np.diff(values)
    low = max(0, int((values[-1] - values[0]) // U(len(values))).bit_length() - 1) if len(values) else 0
    ones = np.cumsum((gaps >> U(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    lows = (gaps[:, None] >> np.arange(low, dtype=U) & U(1)).astype(np.uint8)
    head = np.array([len(values), low, values[0] if len(values) else 0], "<u8").tobytes()
    return head + np.packbits(lows).tobytes() + np.packbits(unary).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    count, low, first = map(int, np.frombuffer(packed[:24], "<u8"))
    if not count:
        return np.empty(0, U)
    cut = 24 + ((count - 1) * low + 7) // 8
    lows = np.unpackbits(np.frombuffer(packed[24:cut], np.uint8), count=(count - 1) * low).reshape(count - 1, low)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(packed[cut:], np.uint8)))[:count - 1]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(U) << U(low)
    for i in range(low):
        gaps += lows[:, i].astype(U) << U(i)
    return np.cumsum(np.concatenate([np.array([first], U), gaps]), dtype=U)


#: Key numbers that a task gathers before it sends them, and about how many a range takes.
GATHERED, RANGE = 1_000_000, 2_000_000


def shared_numbers(entries: DataFrame, bits: int, ranges: int) -> DataFrame:
    """``number``: the key numbers that two sets or more have."""
    width = -(-bits // 8)

    def send(slices):
        held, n = [], 0

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            part = np.minimum((values.astype(np.float64) * (ranges / 2.0**bits)).astype(np.int64), ranges - 1)
            out = {"part": [], "twice": [], "numbers": []}
            for twice, own in ((False, times == 1), (True, times > 1)):
                v, p = values[own], part[own]
                edges = np.flatnonzero(np.diff(p, prepend=-1, append=ranges))
                for lo, hi in zip(edges, edges[1:]):
                    for name, x in zip(out, (int(p[lo]), twice, pack_sorted(v[lo:hi]))):
                        out[name].append(x)
            return out

        for rows in slices:
            for packed in rows["keys"]:
                held.append(numbers_of(packed, width))
                n += len(held[-1])
                if n >= GATHERED:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def meet(slices):
        seen: dict[int, tuple[list, list]] = {}
        for rows in slices:  # a task's ranges
            for part, twice, packed in zip(rows["part"], rows["twice"], rows["numbers"]):
                seen.setdefault(part, ([], []))[twice].append(unpack_sorted(packed))
        for once, more in seen.values():
            values, times = np.unique(np.concatenate([*once, *more, np.empty(0, U)]), return_counts=True)
            yield {"number": np.union1d(values[times > 1], np.concatenate([*more, np.empty(0, U)])).view(np.int64)}

    sent = common.map_batches(
        entries.select("keys"), {"part": pa.int32(), "twice": pa.bool_(), "numbers": pa.binary()}, "part int, twice boolean, numbers binary", send)
    return common.map_batches(
        sent.repartitionById(ranges, F.col("part")), {"number": pa.int64()}, "number long", meet)


def join(docs: DataFrame, n: int = 3, percent: int = 90, deletion: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row.

    Without ``deletion`` sets have the keys of whole segments only: the same rows from fewer, less selective keys, for
    lower thresholds and n-grams that few texts share.
    """
    spark = docs.sparkSession
    every = common.stage(identities(docs, n), "jaccard-sets")
    same = ["n_shingles", "k1", "k2"]
    rows = every.filter("doc_id is not null and n_shingles > 0")
    copies = rows.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = common.stage(copies, "jaccard-copies")
    firsts = rows.join(copies, same, "left").filter("first is null or first = doc_id")
    firsts = common.stage(firsts.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_shingles").alias("size")), "jaccard-firsts")
    elements = firsts.agg(F.sum("size")).first()[0] or 0
    bits = min(63, 12 + (2 * elements + 64).bit_length())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), elements // RANGE)
    entries = common.stage(key_sets(docs, firsts, n, percent, deletion, bits), "jaccard-entries")
    numbers = common.stage(shared_numbers(entries, bits, ranges), "jaccard-numbers")
    under = _under(entries, common.members(numbers, "number"), bits).join(firsts.select("id"), "id", "left_semi")
    under = common.stage(under, "jaccard-keys")
    shared = under.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "least")
    common.drop(spark, entries, numbers)
    first_under = under
    under = common.stage(under.join(shared, "key"), "jaccard-under")
    common.drop(spark, first_under)

    fetch = common.stage(under.groupBy("id").agg(F.count("*").alias("n"), F.min("need").alias("need")).filter("n >= need").select("id"), "jaccard-fetch")
    sets = common.stage(_sets(docs, fetch, n), "jaccard-grams")
    lone = common.stage(_lone_grams(sets), "jaccard-lone")
    room = F.col("size") - F.coalesce("lone", F.lit(0))
    under = under.join(fetch, "id").drop("need").join(lone, "id", "left").withColumn("room", room).filter(100 * F.col("room") >= percent * F.col("size")).drop("lone")
    under = common.stage(under, "jaccard-near")

    stars = under.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = common.stage(_linked(stars, sets, percent), "jaccard-links")
    found = common.stage(components(links), "jaccard-components")

    parts = under.join(found, "id", "left").select("key", "id", "size", "room", F.coalesce("component", "id").alias("part"))
    open_keys = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("key")
    left = common.stage(_narrow(parts.join(open_keys, "key"), sets, percent), "jaccard-open")
    counts = left.groupBy("key").agg(F.count("*").alias("n"))
    light, heavy = left.join(counts.filter(F.col("n") <= LIGHT), "key"), left.join(counts.filter(F.col("n") > LIGHT), "key")
    one, two = (light.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("id", "size", "room", "part")]) for i in (1, 2))
    may = lambda i, j: 100 * F.col(f"room{i}") >= percent * (F.col(f"size{i}") + F.col(f"size{j}") - F.col(f"room{j}"))
    across = one.join(two, "key").filter(
        (F.col("part1") < F.col("part2")) & (100 * F.least("size1", "size2") >= percent * F.greatest("size1", "size2")) & may(1, 2) & may(2, 1)
    ).select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()
    more = common.stage(_linked(across, sets, percent).unionByName(_by_blocks(heavy, sets, percent)), "jaccard-links")
    common.drop(spark, under, sets, lone, left)
    final = common.stage(components(links.unionByName(more)), "jaccard-components")

    named = every.select("doc_id", *same).join(copies, same, "left").withColumn("rep", F.coalesce("first", "doc_id"))
    return named.join(final, named["rep"] == final["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _grams(sets: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of the sets: ``id, gram``."""

    def work(slices):
        for rows in slices:
            own = [np.frombuffer(g, np.int64) for g in rows["grams"]]
            counts = [len(g) for g in own]
            yield {"gram": np.concatenate([*own, np.empty(0, np.int64)]), **{c: np.repeat(np.array(rows[c], np.int64), counts) for c in ("id", *more)}}

    kinds = {c: pa.int64() for c in ("id", "gram", *more)}
    return common.map_batches(sets.select("id", "grams", *more), kinds, ", ".join(f"{c} long" for c in kinds), work)


def _lone_grams(sets: DataFrame) -> DataFrame:
    """``id, lone``: how many elements of a candidate's set no other candidate has; ids with none are left out."""
    lone = _grams(sets).groupBy("gram").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1")
    return lone.groupBy("id").agg(F.count("*").alias("lone"))


def _narrow(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (key, id, size, room, part) that can still link across parts.

    ``room`` becomes the number of a set's elements that sets of other parts have too: what it can share with any
    of them. Sets without enough of it go, and then keys under which one part is left.
    """
    members = common.stage(members, "jaccard-members")
    owners = members.select("id", "part").distinct()
    grams = _grams(sets.join(owners, "id"), ("part",))
    met = grams.groupBy("gram").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("gram")
    shared = grams.join(met, "gram").groupBy("id").agg(F.count("*").alias("room"))
    kept = members.drop("room").join(shared, "id").filter(100 * F.col("room") >= percent * F.col("size"))
    still = kept.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("key")
    return kept.join(still, "key").select("key", "id", "size", "room", "part")


#: Keys with more sets than this are compared by blocks of sets, not by rows of pairs.
LIGHT = 32
#: Sets in a block, and elements that a task counts at a time.
BLOCK, COLUMNS = 512, 4096


def _by_blocks(heavy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across parts among the sets under heavy keys: enough of them to join all parts that are linked.

    Sets that heavy keys hold together are cut into blocks by a hash; a task compares two blocks by one matrix
    product, and sends on only links that join what is apart in it. So no row stands for a pair.
    """
    stars = heavy.join(heavy.groupBy("key").agg(F.min("id").alias("a")), "key").select("a", F.col("id").alias("b")).distinct()
    cluster = components(stars).select("id", F.col("component").alias("cluster"))
    members = common.stage(heavy.select("id", "part").distinct().join(cluster, "id"), "jaccard-clusters")
    blocks = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("id", "part", "cluster", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("id")
        grams = [np.frombuffer(g, U) for g in cell["grams"]]
        size, ids, part = np.array([len(g) for g in grams]), cell["id"].to_numpy(), cell["part"].to_numpy()
        left, right = (np.flatnonzero(cell["block"].to_numpy() == key[i]) for i in (1, 2))
        owner = np.repeat(np.arange(len(grams)), size)
        values, column, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        some = np.flatnonzero(times > 1)
        number = np.full(len(values), -1)
        number[some] = np.arange(len(some))
        column = number[column]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(some), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            dense = np.zeros((len(grams), COLUMNS), np.float32)
            dense[owner[lo:hi], column[lo:hi] - at] = 1
            both += dense[left] @ dense[right].T
        total = size[left][:, None] + size[right][None, :]
        hit = (100 * both.astype(np.int64) >= percent * (total - both.astype(np.int64))) & (part[left][:, None] != part[right][None, :])
        root = {p: p for p in part.tolist()}

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        links = []
        for i, j in zip(*np.nonzero(hit)):
            p, q = find(int(part[left[i]])), find(int(part[right[j]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(ids[left[i]]), int(ids[right[j]])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cells.join(sets, "id").groupBy("cluster", "x", "y").applyInPandas(compare, "a long, b long")


def _under(entries: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """One row per set and key, without most of the keys that no other set has, and without sets that share too few to link."""
    width = -(-bits // 8)

    def work(slices):
        for rows in slices:
            own = [numbers_of(k, width).view(np.int64) for k in rows["keys"]]
            counts = [len(k) for k in own]
            flat = np.concatenate([*own, np.empty(0, np.int64)])
            keep, of = common.is_member(bitmap, flat), np.repeat(np.arange(len(own)), counts)
            keep &= (np.bincount(of[keep], minlength=len(own)) >= np.array(rows["need"], np.int64))[of]
            ids, sizes, need = (np.array(rows[c], np.int64)[of[keep]] for c in ("id", "size", "need"))
            yield {"id": ids, "size": sizes, "need": need, "key": flat[keep]}

    kinds = {c: pa.int64() for c in ("id", "size", "need", "key")}
    return common.map_batches(entries.select("id", "size", "need", "keys"), kinds, "id long, size long, need long, key long", work)


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, grams`` (packed sorted hashes) of the documents named. Texts stay where they lie; sets are shuffled."""
    bitmap = common.members(ids, "id")

    def work(slices):
        for rows in slices:
            met = common.is_member(bitmap, np.array(rows["id"], np.int64))
            texts = [t for t, k in zip(rows["text"], met) if k]
            yield {"id": [i for i, k in zip(rows["id"], met) if k], "grams": [s.tobytes() for s in ngram_sets(texts, n)]}

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), common.text_or_empty().alias("text")).filter("id is not null")
    found = common.map_batches(rows, {"id": pa.int64(), "grams": pa.binary()}, "id long, grams binary", work)
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left, right = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")

    def work(slices):
        for rows in slices:
            keep = []
            for x, y in zip(rows["a_grams"], rows["b_grams"]):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                common_size = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    merged = np.concatenate([x, y])
                    merged.sort(kind="stable")
                    common_size = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common_size >= percent * (len(x) + len(y) - common_size))
            yield {c: [v for v, k in zip(rows[c], keep) if k] for c in "ab"}

    return common.map_batches(
        pairs.join(right, "b").join(left, "a"), {"a": pa.int64(), "b": pa.int64()}, "a long, b long", work)
