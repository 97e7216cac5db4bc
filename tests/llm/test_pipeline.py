from collections import Counter

import numpy as np

import corpus_pipeline
from lexmill.llm import common, jaccard

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs, kept = common.table(spark, SF, "documents"), []
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, SF), "t")
        assert docs.columns == names
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    raw, good, content, one, mixed = [r["doc_id"] for r in common.table(spark, SF, "documents").select("doc_id").collect()], *kept
    assert set(good) < set(raw) and set(content) <= set(good) and set(one) < set(content) and len(set(one)) == len(one)
    assert set(mixed) <= set(one) and max(Counter(mixed).values()) <= 3
    groups = jaccard.join(common.table(spark, SF, "documents").filter(f"doc_id in ({','.join(map(str, one))})")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in groups)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(mixed)


def test_labels_that_are_good_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    docs = common.table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, SF).select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_near_copies_by_five_words(spark):
    """The smallest id of each group of 5-word similarity 0.8 stays; most pairs here lie between 0.7 and 1."""
    rng, texts = np.random.default_rng(5), []
    word = lambda: f"w{rng.integers(0, 5000)}"
    for n in (3, 5, 8, 30, 48, 49, 54, 58, 59, 100, 150, 400):
        for _ in range(3):
            seed = [word() for _ in range(n)]
            texts.append(seed)
            for changes in range(1, 2 + n // 40):
                own = list(seed)
                for at in rng.choice(n, changes, replace=False):
                    own[at] = word()
                texts.append(own)
            texts.append(seed + [word() for _ in range(n // 6)])
    sets = [{tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    group, between = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            between += 80 * either <= 100 * both < 90 * either
            if 100 * both >= 80 * either and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one(spark, docs, SF).collect())
    assert between > 20 and kept == [i for i, g in enumerate(group) if i == g]


def test_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF), "t")
    one = corpus_pipeline.keep_one(spark, odd, SF)
    ids = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert sorted(ids, key=lambda x: (x is not None, x or 0)) == [None, 0, 1, 2, 4, 6, 7, 8, 9, 10]
