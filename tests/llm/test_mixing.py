import itertools
import random
import time
from collections import Counter

import pandas as pd
import pytest

from lexmill.llm import mixing


def filled(sizes, weights):
    """Targets by repeated resharing."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        rest, w = total - sum(3 * sizes[n] for n in capped), sum(weight[n] for n in free)
        target = {n: rest * weight[n] / w for n in free}
        over = {n for n in free if target[n] > 3 * sizes[n]}
        if not over:
            return {n: 3.0 * sizes[n] if n in capped else target[n] for n in names}
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 1, None: 50}, {"a": 5}, {"a": 1, "b": 1, "c": 100_000, "d": 2, "e": 700}, {"a": 0, "b": 9}, {"Z": 3, "a": 4, "é": 90},
])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes, (1, 2, 3)))


def test_documents_near_target_and_reruns_agree(spark, docs):
    rows = mixing.plan(docs).rows.collect()
    taken, target = Counter(), {}
    by_id = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    assert len(rows) == len(by_id)
    for r in rows:
        assert 0 <= r["copies"] <= 3
        taken[by_id[r["doc_id"]]] += r["size"] * r["copies"]
        target[by_id[r["doc_id"]]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.05 * t + 100
    assert sorted(map(tuple, mixing.plan(docs).rows.collect())) == sorted(map(tuple, rows))


def test_mix_gives_the_rows_planned(spark, docs):
    planned = mixing.plan(docs)
    copies = {r["doc_id"]: r["copies"] for r in planned.rows.collect()}
    mixed = mixing.mix(docs, planned)
    assert mixed.columns == docs.columns
    got = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert got == Counter({d: n for d, n in copies.items() if n})


def test_quotas_are_split_exactly(spark):
    quotas = {1: 1000, 2: 1, 3: 333, 4: 0, 5: 77}
    df = spark.createDataFrame(list(quotas.items()), "sid int, quota long")
    rows = mixing.split_quotas(df, 150, seed=3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r["sid"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert by_source == Counter(quotas) and len(by_shard) == 150
    assert max(by_shard.values()) - min(by_shard.values()) <= 8


def test_odd_rows(spark, odd):
    rows = mixing.plan(odd).rows.collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan(odd.limit(0)).rows.count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def block(sizes, room):
    return pd.DataFrame({"sid": 1, "h": range(len(sizes)), "size": sizes, "room": float(room)})


def taken(sizes, room):
    out = mixing._fill(block(sizes, room)).iloc[0]
    return sum(n for h, n in enumerate(sizes) if (out["cut"] is not pd.NA and h <= out["cut"]) or h in out["extras"])


def test_fill_is_exact_where_sums_are():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(0, 40) for _ in range(rng.randint(1, 12))]
        room = rng.randint(1, 100)
        got = taken(sizes, room)
        best = min(abs(room - sum(c)) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k))
        assert abs(room - got) == best


def test_fill_with_book_length_documents_ends_soon():
    sizes = [300 + i % 90 for i in range(400)] + [20_000_000, 30_000, 100_000, 200_000] + [350] * 50
    start = time.perf_counter()
    for room in (5_000, 90_000, 150_000, 19_900_000):
        got = taken(sizes, room)
        assert abs(got - room) < max(100, 0.02 * room), (room, got)
    assert time.perf_counter() - start < 1


def test_a_large_document_does_not_end_the_run():
    sizes = [10] * 500 + [9000] + [10] * 4000
    for room in (9500, 20_000):
        assert abs(taken(sizes, room) - room) <= 10
