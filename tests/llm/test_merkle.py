import hashlib
import random
import zlib

import pytest

from lexmill.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, leaf int, value string, pos int"


def rows_of(n, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "ä", "z", *["hot"] * 12]
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "\n", "one\ntwo", "plain", "x\n\ny " * rng.randint(1, 9), "漢字\n"])
        i = rng.choice([None, *range(-3, 3 * n)]) if rng.random() < 0.1 else rng.randint(0, 10 * n)
        rows.append((i, text, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 7]), 1, "v", 2))
    return rows + rows[:3]


def brute(rows):
    """Trees level by level over whole lists; proofs and folds by walking up."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(show, (r[0], r[2], r[3], r[4], text)))

    def tree(values):
        levels = [values]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def up(levels, at, value):
        proof = []
        for nodes in levels[:-1]:
            start = at - at % 3
            left, right = nodes[start:at], nodes[at + 1:start + 3]
            proof += left + right
            value, at = H(*left, value, *right), at // 3
        return proof, value

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by[s]])
    crown = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(by[s]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            p, v = up(trees[s], at, leaf(r, text))
            q, v = up(crown, k, v)
            root = crown[-1][0]
            out.append((r[0], s, trees[s][0][at], trees[s][-1][0], root, len(p + q), H(*p, *q), v, v == root))
    return out


@pytest.mark.parametrize("n, levels", [(1, 7), (2, 1), (28, 1), (300, 2), (300, 7), (90, 4)])
def test_manifest_equals_trees_level_by_level(spark, n, levels):
    rows = rows_of(n, n + levels) if n > 1 else rows_of(5, 1)[:1]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), levels).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert any(r["verified"] for r in got) or n < 3


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_grow_several_rounds(spark):
    rows = [(i, f"t\n{i}", f"s{i % 40}", "en", i, 1, "v", 2) for i in range(200)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_appends_extend_witnesses():
    for n in range(1, 40):
        leaves, root = merkle.grow([merkle.digest(str(i)) for i in range(n)], merkle.height(n))
        assert all(merkle.fold(x.value, merkle.steps(x)) == root.value for x in leaves)
        assert all(len(merkle.steps(x)) == merkle.height(n) for x in leaves)
    frontier = merkle.Frontier()
    nodes = [merkle.Node(str(i)) for i in range(4)]
    for n in nodes[:2]:
        frontier.append(n)
    assert nodes[0].above is None
    frontier.append(nodes[2])  # the run is complete: its members' witnesses grow
    assert nodes[0].right == "12" and nodes[2].left == "01" and nodes[0].above is nodes[2].above
    frontier.append(nodes[3])
    assert nodes[3].above is None
    assert frontier.close(2) is nodes[3].above.above is nodes[0].above.above
