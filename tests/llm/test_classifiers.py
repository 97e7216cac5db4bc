import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import common, licenses, line_crf, quality, queries, toxicity, training
from lexmill.llm.training import fit_logistic, sigmoid

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    labels = {r["doc_id"]: r[label] for r in common.table(spark, SF, "labels").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == common.table(spark, SF, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    return [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def auc(pairs):
    good, bad = ([s for y, s, _ in pairs if y == v] for v in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, "op5_quality", "quality")
    assert auc(rows) > 0.95 and sum(p == 0 for y, _, p in rows if y) <= 0.05 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, "op4_toxicity", "toxic")
    assert auc(rows) > 0.75 and sum(p for y, _, p in rows if not y) <= 0.05 * len(rows)


def test_logistic_finds_the_rule_even_when_separable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) * [1, 10, 0.1, 1, 1]
    x[:, 4] = x[:, 3]
    y = (x[:, 0] + x[:, 1] / 10 > 0.2).astype(float)
    w = fit_logistic(x, y, ridge=0.1)
    assert ((sigmoid(x @ w[:-1] + w[-1]) > 0.5) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("score", ["toxicity", "quality", "rules", "scan"])
def test_odd_rows(spark, odd, docs, labels, score):
    none = labels.limit(0)
    for df in (odd, odd.limit(0)):
        for own in (labels, none):
            if score == "toxicity":
                out = toxicity.scored(df, own)
            elif score == "quality":
                out = quality.score(df, quality.train(docs, own))
                assert quality.keep_good(df, quality.train(docs, own)).columns == odd.columns
            elif score == "rules":
                out = line_crf.rules(df, line_crf.train(docs, own))
                assert line_crf.keep_content(df, line_crf.train(docs, own)).columns == odd.columns
            else:
                out = licenses.summary(licenses.scan(df))
            assert out.count() == df.count()


def test_label_model_finds_rates(spark):
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    rates = np.array([[0.02, 0.01, 0.03, 0.02], [0.6, 0.5, 0.7, 0.4]])
    votes = (rng.random((4000, 4)) < rates[y.astype(int)]).astype(int)
    n = Counter(map(tuple, votes.tolist()))
    df = spark.createDataFrame([(list(v), c) for v, c in n.items()], "votes array<int>, n long")
    model = toxicity.LabelModel(np.tile([[0.05], [0.4]], (1, 4)), 0.1).fit(df)
    assert abs(model.share - 0.2) < 0.06 and np.abs(model.rates[1, :4] - rates[1]).max() < 0.15
    again = spark.createDataFrame([(list(v) + [v[0]], c) for v, c in n.items()], "votes array<int>, n long")  # with a copy of a voter
    model = toxicity.LabelModel(np.tile([[0.05], [0.4]], (1, 5)), 0.1).fit(again)
    assert model.discount[0] < model.discount[1] and model.discount[4] < model.discount[1]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_base_counts_equal_brute_force(docs):
    rng = np.random.default_rng(4)
    texts = [r["text"] for r in docs.limit(60).collect()]
    texts += [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(200)] + ["a\nb\n\na\n \x85\n \x85", "x\x1cy z\xa0", "s " * 50]
    for t in texts:
        assert line_crf.base_counts(t) == brute_counts(t)


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(6)
    for _ in range(30):
        f = rng.normal(size=(rng.integers(1, 8), line_crf.N_FEATURES))
        crf = line_crf.Crf(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=(2, 2)))
        gain = f @ crf.weights
        value = lambda y: sum(g for g, v in zip(gain, y) if v) + sum(crf.bonds[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(f)), key=value)
        assert value(tuple(crf.decode(f))) == pytest.approx(value(best))


def test_crf_learns_a_planted_rule():
    rng = np.random.default_rng(8)
    runs = []
    for _ in range(80):
        f = np.zeros((12, line_crf.N_FEATURES))
        f[:, 0] = 1
        f[:, 12] = rng.random(12) < 0.4
        runs.append((f, f[:, 12].astype(int)))
    crf = line_crf.fit(runs, rounds=150)
    assert np.mean([crf.decode(f) == y for f, y in runs]) > 0.98


def test_blocks_equal_brute_force(spark, docs):
    rng = np.random.default_rng(2)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)})
    counts = {w: int(rng.integers(1, 50)) for w in vocabulary}
    templates = licenses.order_templates(licenses.TEMPLATES, counts, 0.8)
    scanner = licenses.Scanner(templates, counts)
    texts = [licenses.words_of(t) for _, t in licenses.TEMPLATES]
    for _ in range(40):
        noise = [f"n{i}".encode() for i in rng.integers(0, 99, 30)]
        run = list(texts[int(rng.integers(0, len(texts)))])
        for _ in range(int(rng.integers(0, len(run) // 3 + 1))):
            run[int(rng.integers(0, len(run)))] = b"other"
        at = int(rng.integers(0, 30))
        words = noise[:at] + run + noise[at:]
        want = set()
        for t in templates:
            for start in range(0, len(words), t.width // 2):
                share = len(set(t.words) & set(words[start:start + t.width]))
                if share >= t.need:
                    want.add((t.label, start, share / len(t.words)))
        assert {(x, a, c) for x, a, _, c in scanner.blocks(words)} == want


def test_phrase_places():
    scanner = licenses.Scanner([], {})
    words = licenses.words_of("MIT-License; mit license mit license\nthe GNU General  Public License, apache licenses")
    assert scanner.places(words) == [(0, "mit"), (2, "mit"), (4, "mit"), (8, "gpl")]


def test_digits_of_a_whole_line_count():
    digit = lambda line: line_crf.line_features(line)[0][0, 13]
    assert digit("word " * 100 + "7") == digit("7 word") == digit("x\u00b2 " + "word " * 100) == 1 and digit("word " * 100) == 0
    every = [chr(c) for c in range(0x110000)]
    assert [c for c in every if line_crf.DIGIT.search(c)] == [c for c in every if c.isdigit()]


def test_places_are_found_in_linear_time():
    scanner = licenses.Scanner([], {})
    seconds = []
    for n in (80_000, 160_000):
        words = [b"mit", b"license", b"x"] * n
        start = time.perf_counter()
        found = scanner.places(words)
        seconds.append(time.perf_counter() - start)
        assert len(found) == n and found[:2] == [(0, "mit"), (3, "mit")] and found[-1] == (3 * n - 3, "mit")
    assert seconds[1] < 2


def test_places_equal_a_scan_of_words():
    rng, scanner = random.Random(5), licenses.Scanner([], {})
    phrases = [(tuple(p.encode().split()), label) for p, label in licenses.PHRASES]
    for _ in range(300):
        words = [rng.choice([b"mit", b"license", b"apache", b"general", b"public", b"x"]) for _ in range(rng.randint(0, 30))]
        want = sorted((i, label) for p, label in phrases for i in range(len(words)) if tuple(words[i:i + len(p)]) == p)
        assert scanner.places(words) == want


def test_an_id_of_many_rows_brings_one_text(spark):
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") + 100_000).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "other"), (3, "third"), (None, "no id")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    labels = labels.unionByName(labels)
    assert sorted(training.labelled_sample(docs, labels, "toxic", 4, 9, 50, 100)) == [("other", 0), ("text 100000", 1), ("third", 0)]
    assert len(training.labelled_sample(docs, labels, "toxic", 4, 9, 1, 100)) == 2


@pytest.mark.parametrize("text", ["“idiot”", "«idiot»", "¡idiot!", "x—idiot", "a\u3000idiot", "…idiot", "9idiot", "İdiot idiot"])
def test_words_start_after_marks_of_any_script(text):
    counter = toxicity.HitCounter([("idiot", 1)])
    assert counter.counts(text)[0] == [1]
    assert counter.counts("éidiot xidiot")[0] == [0]
