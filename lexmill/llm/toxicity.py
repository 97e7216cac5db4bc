"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters look for words that start with a stem: those of a fixed English list, and stems learnt from a bounded sample of
labelled texts (word starts that toxic texts share, or have several times, and clean ones lack, chosen to cover every toxic text several
times); pattern voters look for several hits and for their density. A voter votes "toxic" or abstains.

The label model is fitted on the votes of all documents: expectation-maximisation estimates the share of toxic
documents and every voter's hit rates in either class, starting from the labelled sample; the voters' correlations inside the
classes then discount votes that say the same thing. A logistic regression over the voters' counts is trained on
the posteriors of a bounded, hash-ordered sample of documents, and scaled to the labels of the training folds.

Words start after white space, digits, marks and symbols of any script. Scripts written without spaces are not covered: there a stem is met only
where such a character stands before it.

Sample bounds: ``per_class`` texts of each label up to ``max_chars`` characters, ``fit_rows`` documents for the
classifier. Votes and the model's counts cover whole texts of all documents.
Cases: a null or empty text has no vote; without labels only the fixed voters vote; a null ``doc_id`` is scored and is
not held out; repeated rows get a row each; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import common
from .training import fit_logistic, labelled_sample, sigmoid

#: Stems of English insults.
STEMS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
    "imbecile", "bastard", "bitch", "asshole", "fuck", "shit", "retard", "vermin", "filth", "whore", "slut",
)
#: ASCII characters that are no letters become spaces, so that a stem stands after a space; beyond ASCII, marks and spaces do.
_SPACED = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))
_MARKS = regex.compile(r"[\p{P}\p{S}\p{Z}]")


def normalise(text: str) -> str:
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return " " + text.lower().encode("utf-8", "replace").translate(_SPACED).decode()


#: How many words of a text must start with a learnt stem for its hits to count: word starts that clean texts have now and then
#: still tell toxic texts, which have several.
NEEDS = (1, 2, 4)


def learn_stems(
    sample: list[tuple[str, int]], most: int = 40, cover: int = 2, lengths: tuple[int, ...] = (4, 5, 6, 7), needs: tuple[int, ...] = NEEDS,
) -> list[tuple[str, int]]:
    """Word starts, with the hits they need, that cover the toxic texts of a sample ``cover`` times, each rare among clean ones."""
    toxic, clean, n_clean, n_toxic = defaultdict(set), Counter(), 0, 0
    for text, label in dict(sample).items():
        starts = Counter(w[:k] for w in normalise(text).split() for k in lengths if len(w) >= k)
        met = [(s, need) for s, n in starts.items() for need in needs if n >= need]
        if label:
            for m in met:
                toxic[m].add(n_toxic)
            n_toxic += 1
        else:
            clean.update(met)
            n_clean += 1
    rate = lambda m: (clean[m] + 0.5) / (n_clean + 1)
    pool = {m: d for m, d in toxic.items() if len(d) >= max(3, 0.01 * n_toxic) and len(d) / n_toxic > 12 * rate(m)}
    need, chosen = np.full(n_toxic, cover), []
    while pool and len(chosen) < most:
        gain = {m: (sum(need[i] > 0 for i in d) - 20 * n_toxic * clean[m] / max(1, n_clean), len(m[0]), m) for m, d in pool.items()}
        best = max(gain, key=gain.get)
        if gain[best][0] < max(2, 0.003 * n_toxic):
            break
        chosen.append(best)
        for i in pool.pop(best):
            need[i] -= 1
        pool = {m: d for m, d in pool.items() if not m[0].startswith(best[0]) and not best[0].startswith(m[0])}
    return chosen


class HitCounter:
    """Counts hits of stems at word starts; of a stem with fewer hits than it needs, none count."""

    def __init__(self, stems: list[tuple[str, int]]):
        import ahocorasick

        self.needs = [need for _, need in stems]
        self.automaton = ahocorasick.Automaton()
        for i, (s, _) in enumerate(stems):
            self.automaton.add_word(" " + s, i)
        self.automaton.make_automaton()

    def counts(self, text: str) -> tuple[list[int], int]:
        spaced = normalise(text)
        hits = [0] * len(self.needs)
        for _, i in self.automaton.iter(spaced):
            hits[i] += 1
        return [n if n >= need else 0 for n, need in zip(hits, self.needs)], len(spaced.split())


def votes(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0/1 votes: one per stem, two or more hits, and a hit in at most 50 words."""
    total = counts.sum(axis=1)
    patterns = np.column_stack([total >= 2, total * 50 >= np.maximum(words, 1)])
    return np.concatenate([counts > 0, patterns], axis=1).astype(np.int8)


def features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1)
    return np.column_stack([np.log1p(counts), counts > 0, np.log1p(total), total > 0, np.sqrt(total / np.maximum(words, 1)), np.log1p(words)])


def count_hits(docs: DataFrame, stems: list[tuple[str, int]]) -> DataFrame:
    """``doc_id, words, counts`` of every document, written once."""

    def work(slices):
        counter = HitCounter(stems)
        for rows in slices:
            got = [counter.counts(t) for t in rows["text"]]
            yield {"doc_id": rows["doc_id"], "words": [w for _, w in got], "counts": [c for c, _ in got]}

    return common.stage(common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")),
        {"doc_id": pa.int64(), "words": pa.int64(), "counts": pa.list_(pa.int32())},
        "doc_id long, words long, counts array<int>", work), "toxicity-hits")


class LabelModel:
    """Hit rates of every voter in toxic (row 1) and clean (row 0) documents, the toxic share, and the voters' discounts."""

    def __init__(self, rates: np.ndarray, share: float):
        self.rates, self.share, self.discount = rates, share, np.ones(rates.shape[1])

    def posterior(self, v: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0]) * self.discount
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.discount
        return sigmoid(np.log(self.share / (1 - self.share)) + off.sum() + v @ (on - off))

    def fit(self, patterns: DataFrame, rounds: int = 6) -> LabelModel:
        """EM over ``votes array<tinyint>, n``; sums come back as one row per pair of voters (a bounded number)."""
        for _ in range(rounds):
            toxic, clean = self._sums(patterns)
            size = np.array([clean[0, 0], toxic[0, 0]])
            if size.sum() == 0:
                return self
            hits = np.stack([clean[0, 1:], toxic[0, 1:]])
            self.rates = np.clip((hits + [[0.01], [0.2]]) / (size[:, None] + [[20.0], [1.0]]), 1e-6, 0.999)
            self.share = float(np.clip(size[1] / size.sum(), 1e-4, 0.9))
        toxic, clean = self._sums(patterns)
        excess = np.zeros((len(self.discount),) * 2)
        for sums in (toxic, clean):
            n = max(sums[0, 0], 1.0)
            mean = sums[0, 1:] / n
            cov = sums[1:, 1:] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            excess = np.maximum(excess, np.clip(cov / np.outer(sd, sd), 0, 1) * (n > 20))
        np.fill_diagonal(excess, 0)
        self.discount = 1 / (1 + excess.sum(axis=1))
        return self

    def _sums(self, patterns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts in either class: [0,0] documents, [0,j] hits, [i,j] joint hits."""
        model = self
        k = len(self.discount) + 1

        def run(batches):
            total = np.zeros((2, k, k))
            for batch in batches:
                v = np.array(batch.column("votes").to_pylist(), dtype=float).reshape(batch.num_rows, k - 1)
                n, p = batch.column("n").to_numpy(), model.posterior(v)
                one = np.column_stack([np.ones(len(v)), v])
                for y, w in ((0, n * (1 - p)), (1, n * p)):
                    total[y] += (one * w[:, None]).T @ one
            yield pa.RecordBatch.from_pydict({"at": np.arange(total.size), "value": total.ravel()})

        rows = patterns.select("votes", "n").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(2 * k * k)
        for r in rows:
            out[r["at"]] = r["value"]
        clean, toxic = out.reshape(2, k, k)
        return toxic, clean


def scored(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, left_out: int = 2, per_class: int = 3000,
    max_chars: int = 32_768, fit_rows: int = 20_000, threshold: float = 0.3,
) -> DataFrame:
    """``doc_id, score, predicted`` and the label model's ``posterior`` of every document."""
    sample = labelled_sample(docs, labels, label, folds, left_out, per_class, max_chars)
    toxic = sum(y for _, y in sample)
    learnt = learn_stems(sample) if 8 <= toxic < len(sample) else []
    stems = learnt + [(s, 1) for s in STEMS if not any(s.startswith(x) or x.startswith(s) for x, _ in learnt)]
    counter = HitCounter(stems)
    own = [counter.counts(t) for t, _ in sample]
    c, w = np.array([x for x, _ in own]).reshape(len(own), len(stems)), np.array([x for _, x in own])
    y = np.array([v for _, v in sample], dtype=float)
    k = len(stems) + 2
    rates, share = np.tile([[0.002], [0.3]], (1, k)), 0.1
    if learnt:
        v = votes(c, w)
        rates = np.stack([(v[y == t].sum(axis=0) + s) / ((y == t).sum() + 2 * s + 1) for t, s in ((0, 0.05), (1, 0.5))])
        share = 0.1

    hits = count_hits(docs, stems)
    as_votes = _as_votes()
    patterns = common.stage(hits.select(as_votes.alias("votes")).groupBy("votes").agg(F.count("*").alias("n")), "toxicity-votes")
    model = LabelModel(rates, share).fit(patterns)
    keyed = hits.withColumn("h", F.xxhash64("doc_id", "words"))
    some = keyed.filter(F.exists("counts", lambda x: x > 0)).orderBy("h").limit(fit_rows // 2).unionByName(
        keyed.filter(~F.exists("counts", lambda x: x > 0)).orderBy("h").limit(fit_rows // 2)).toPandas()
    weights = np.zeros(2 * len(stems) + 5)
    if len(some):
        fc, fw = np.array(some["counts"].tolist()).reshape(len(some), len(stems)), some["words"].to_numpy()
        weights = fit_logistic(features(fc, fw), model.posterior(votes(fc, fw)), ridge=1.0)
    scale, shift = 1.0, 0.0
    if learnt:
        logit = features(c, w) @ weights[:-1] + weights[-1]
        balance = np.where(y == 1, model.share / y.mean(), (1 - model.share) / (1 - y.mean()))
        scale, shift = fit_logistic(logit[:, None], y, balance, ridge=0.1)

    def work(slices):
        for rows in slices:
            counts, words = np.array(rows["counts"]).reshape(len(rows["counts"]), len(stems)), np.array(rows["words"])
            s = sigmoid(scale * (features(counts, words) @ weights[:-1] + weights[-1]) + shift)
            yield {"doc_id": rows["doc_id"], "score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist(), "posterior": model.posterior(votes(counts, words)).tolist()}

    return common.map_batches(
        hits, {"doc_id": pa.int64(), "score": pa.float64(), "predicted": pa.int32(), "posterior": pa.float64()},
        "doc_id long, score double, predicted int, posterior double", work)


def _as_votes():
    """``votes`` of a row of hits as a column."""
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    flag = lambda c: c.cast("tinyint")
    return F.concat(
        F.transform("counts", lambda x: flag(x > 0)), F.array(flag(total >= 2), flag(total * 50 >= F.greatest(F.lit(1), F.col("words")))))
