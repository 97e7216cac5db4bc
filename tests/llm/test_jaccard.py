import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lexmill.llm import jaccard, queries
from lexmill.llm.components import components
from tests.compare import compare, duck

from ..conftest import SF


def jac(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("percent", [50, 70, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    classes, known, linked = jaccard.Classes(percent), {}, 0
    with np.errstate(over="ignore"):
        for _ in range(1500):
            n = int(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 19, 20, 30, 60, 120, 400]))
            pool = rng.integers(0, 2**64, 2 * n + 60, dtype=np.uint64)
            x = set(pool[:n].tolist())
            gone = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            y = set(list(x)[gone:]) | set(pool[n:n + int(rng.integers(0, max(1, gone) + 1))].tolist())
            if not y or x == y or 100 * len(x & y) < percent * len(x | y):
                continue
            linked += 1
            a, b = (jaccard.keys(np.array(sorted(s), np.uint64), classes, known) for s in (x, y))
            assert np.intersect1d(a, b).size, (len(x), len(y), jac(x, y))
    assert linked > 100


def test_linked_sets_share_a_whole_segment():
    rng = np.random.default_rng(80)
    classes, known = jaccard.Classes(80, deletion=False), {}
    with np.errstate(over="ignore"):
        for n in [5, 9, 10, 14, 30, 45, 60, 120, 400] * 60:
            pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            gone = n // 9  # 8/10 of all elements are in both
            a, b = (jaccard.keys(np.unique(s), classes, known) for s in (pool[:n], np.r_[pool[gone:n], pool[n:n + gone]]))
            assert np.intersect1d(a, b).size, n
    assert not any(deletion for _, _, deletion in known.values())


def test_sets_with_many_empty_segments_share_a_key():
    """Elements chosen to fall into few segments of the first partition."""
    classes, known, rng = jaccard.Classes(90), {}, np.random.default_rng(1)
    with np.errstate(over="ignore"):
        c = classes.of(120)[0]
        m, extra, _ = classes.allocation(c)
        pool = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
        pool = pool[(jaccard.mix(pool + jaccard._C) % np.uint64(m)) < m - extra - 3]
        for _ in range(200):
            x = rng.choice(pool, 125, replace=False)
            y = np.concatenate([x[6:], rng.choice(pool, 5)])
            a, b = (jaccard.keys(np.unique(s), classes, known) for s in (x, y))
            assert np.intersect1d(a, b).size


@pytest.mark.parametrize("percent, deletion", [(80, False), (50, False), (90, True)])
def test_linked_sets_share_as_many_keys_as_needed(percent, deletion):
    """Linked sets of random and of hollow partitions, also at the very threshold, and sets that share one segment by chance."""
    rng = np.random.default_rng(percent)
    classes, known, asked, chance = jaccard.Classes(percent, deletion=deletion), {}, 0, 0
    with np.errstate(over="ignore"):
        for i in range(3000):
            n = int(rng.choice([1, 3, 9, 10, 14, 25, 44, 57, 60, 90, 112, 113, 200, 311, 400]))
            pool = rng.integers(0, 2**64, 40 * n + 60, dtype=np.uint64)
            if i % 3 == 0:  # many segments without an element
                pool = pool[(jaccard.mix(pool + jaccard._C) % np.uint64(max(1, classes.allocation(classes.of(n)[0])[0]))) < max(1, n // 4)]
            n = min(n, len(pool) // 2)
            if not n:
                continue
            common = n - int(rng.integers(0, n * (100 - percent) // 100 + 1))
            x, more = pool[:n], int(rng.integers(0, n // 2 + 1))
            y = np.r_[x[:common], pool[n:n + more]]
            if common == n and not more or 100 * common < percent * (n + more):
                continue
            (a, need_a), (b, need_b) = (jaccard.keys_and_need(np.unique(s), classes, known) for s in (x, y))
            shared = np.intersect1d(a, b).size
            assert shared >= max(need_a, need_b, 1), (n, common, more, shared, need_a, need_b)
            asked += need_a > 5
            chance += need_a > 1
    assert percent != 80 or (chance > 200 and asked > 100)


def test_a_set_that_shares_one_key_by_chance_is_not_asked_for(spark):
    """Texts that have one short sentence in common share a key, but far fewer than linked ones would."""
    rng = np.random.default_rng(3)
    own = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    line, copied = "this one line stands in every text of the table and in its copies ", own(300)
    texts = [line + own(280) for _ in range(40)] + [line + copied, line + copied + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = docs.selectExpr("doc_id as id")
    entries = jaccard.key_sets(docs, ids, 5, 80, False, 40).cache()
    numbers = jaccard.shared_numbers(entries, 40, 2)
    kept = {r["id"] for r in jaccard._under(entries, jaccard.common.members(numbers, "number"), 40).select("id").distinct().collect()}
    assert kept >= {40, 41} and len(kept) < 10
    assert entries.count() == 42 and numbers.count() > 10
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, n=5, percent=80, deletion=False).collect()}
    assert found == {i: min(i, 40) for i in range(42)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, pairs):
    parent = list(range(41))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs or [], "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.mark.parametrize("light, block", [(32, 512), (1, 4), (0, 7)])
def test_join_equals_brute_force(spark, monkeypatch, light, block):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (5, 12, 14, 25, 60, 150, 400):
        for _ in range(3):
            seed = [words[i] for i in rng.integers(0, 3000, n)]
            texts.append(" ".join(seed))
            for _ in range(5):
                own = list(seed)
                for _ in range(int(rng.integers(0, max(2, n // 30)))):
                    own[int(rng.integers(0, n))] = "New" + words[int(rng.integers(0, 3000))]
                texts.append("\n".join(own))
    base = [words[i] for i in rng.integers(0, 3000, 80)]  # many near copies, on both sides of the threshold
    for _ in range(60):
        own = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 5))):
            own[k] = words[int(rng.integers(0, 8))]
        texts.append(" ".join(own))
    common = "one very common line that many of the short texts here share with all the others "
    texts += [common + " ".join(words[i] for i in rng.integers(0, 3000, 3)) for _ in range(30)]
    sets = [set(zip(*[t.lower().split()[i:] for i in range(3)])) or {tuple(t.lower().split())} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_odd_rows(spark, odd):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        elif r["doc_id"] in (4, 5):
            assert (r["n_shingles"], r["component_id"]) == (3, 4)
        else:
            assert r["component_id"] == r["doc_id"]
        if r["doc_id"] in (0, 1, 2):
            assert r["n_shingles"] == 0
    assert jaccard.join(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    line = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert line.startswith("ok"), line


def test_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    for bits in (1, 13, 40, 62):
        for n in (0, 1, 2, 3, 1000):
            values = np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64))
            packed = jaccard.pack_sorted(values)
            assert (jaccard.unpack_sorted(packed) == values).all()
    dense = np.arange(10**6, 10**6 + 50_000, dtype=np.uint64)
    assert len(jaccard.pack_sorted(dense)) < 20_000


def test_numbers_met_twice_are_found_in_any_order_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GATHERED", 50)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**12, int(rng.integers(0, 60)), dtype=np.uint64)) for _ in range(90)]
    rows = [(i, len(s), s.view(np.uint8).reshape(-1, 8)[:, :2].tobytes()) for i, s in enumerate(sets)]
    entries = spark.createDataFrame(rows, "id long, size long, keys binary").repartition(7)
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    for ranges in (1, 5, 64):
        got = sorted(r["number"] for r in jaccard.shared_numbers(entries, 12, ranges).collect())
        assert got == values[times > 1].tolist()
