"""Quality rules: base counts, and line labels by a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows of a whole text. A linear-chain
CRF then labels every line with a word as content or boilerplate (Viterbi decoding); a text is kept if it passes the
base rules and content lines hold at least ``share`` of its words.

The CRF is trained here, by gradient ascent on the conditional likelihood of a bounded sample: lines of texts labelled
bad, repeated lines and lines with notice words count as boilerplate, other lines of good texts as content.
Sample: at most ``per_class`` texts of each label up to ``max_chars`` characters, in runs of at most ``RUN`` lines.

Cases: a null or empty text has no words and fails; without labels the CRF has only rules of its prior (notice words,
symbols, repetition); a null ``doc_id`` is judged like any other; repeated rows get a row each; other columns are not
looked at; an empty table gives no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .training import labelled_sample

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
RUN = 64
#: What str.isdigit holds for: decimal digits and those in circles, above the line and the like.
DIGIT = re.compile(
    r"[\d\xb2\xb3\xb9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792\U00010a40-\U00010a43\U00010e60-\U00010e68\U00011052-\U0001105a\U0001f100-\U0001f10a]")
#: Words of notices, menus and licences.
NOTICE = re.compile(
    r"\b(?:copyright|rights reserved|licensed?|licen[cs]e|cookies?|privacy|terms of|subscribe|newsletter|sign (?:up|in)|log ?in|"
    r"click here|read more|share this|advertisement|all rights|powered by|javascript)\b|©", re.IGNORECASE)


def base_counts(text: str) -> dict:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(words), "word_chars": len(text) - sum(text.count(c) for c in SPACE),
        "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first one included."""
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) > n - width:  # a window met twice has width words met twice
        return 0
    ids = np.fromiter([number[w] for w in words], np.int64, n)
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ windows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    if not (windows[order[1:][same]] == windows[order[:-1][same]]).all():  # different windows with one hash
        order = np.lexsort(windows.T)
        same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and word counts of the lines with a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = len(line)
        symbols = sum(map(line.count, SYMBOLS))
        upper = sum(map(str.isupper, words))
        distinct = len(set(words)) / n
        rows.append((
            1.0, min(n, 60) / 30, n < 4, min(1.0, 4 * symbols / chars), line.count("|") >= 0.2 * n, upper >= 0.6 * n,
            line.count("!") >= 0.4 * n, distinct < 0.5 and n >= 6, distinct < 0.2 and n >= 6, line in seen,
            bool(NOTICE.search(line)), line[-1] in ".!?…:;\"'»”", chars / n > 14, bool(DIGIT.search(line)),
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, float).reshape(len(rows), N_FEATURES), np.array(sizes, np.int64)


N_FEATURES = 14
#: What the weights start from and are drawn to: boilerplate against content.
PRIOR = np.array([-1.5, -0.5, 0.3, 2.0, 2.0, 1.5, 1.5, 2.0, 2.0, 1.5, 2.0, -0.3, 0.3, 0.0])


@dataclass
class Crf:
    """Boilerplate (1) against content (0): ``weights`` of a line's features, ``bonds[i, j]`` of neighbours."""

    weights: np.ndarray
    bonds: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The most likely labels of all lines together."""
        gain = (features @ self.weights).tolist()
        (b00, b01), (b10, b11) = self.bonds.tolist()
        zero, one, back = 0.0, gain[0], []
        for g in gain[1:]:
            to0, to1 = (zero + b00, one + b10), (zero + b01, one + b11)
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            zero, one = max(to0), max(to1) + g
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


def fit(runs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.1, ridge: float = 1.0, slack: float = 0.05) -> Crf:
    """Adam on the penalised conditional log-likelihood of (features, labels) runs, all runs at once.

    ``slack`` (a share of the lines) holds the bonds of neighbours down: texts labelled as a whole make them look
    stronger than they are, and a single notice would take the lines around it along.
    """
    w, b = PRIOR.copy(), np.array([[0.3, -0.3], [-0.3, 0.3]])
    if not runs:
        return Crf(w, b)
    s, t = len(runs), max(len(y) for _, y in runs)
    x, y, on = np.zeros((s, t, N_FEATURES)), np.zeros((s, t), int), np.zeros((s, t), bool)
    for i, (f, label) in enumerate(runs):
        x[i, :len(label)], y[i, :len(label)], on[i, :len(label)] = f, label, True
    pair = on[:, 1:] & on[:, :-1]
    seen_w = np.einsum("stf,st->f", x, y * on)
    seen_b = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)], float)
    first, second, k = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), on.sum()
    for step in range(1, rounds + 1):
        unary = np.stack([np.zeros((s, t)), x @ w], axis=2)
        ahead, behind = np.zeros((s, t, 2)), np.zeros((s, t, 2))
        ahead[:, 0] = unary[:, 0]
        for i in range(1, t):
            new = np.logaddexp.reduce(ahead[:, i - 1, :, None] + b, axis=1) + unary[:, i]
            ahead[:, i] = np.where(on[:, i, None], new, ahead[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(b[None] + (unary[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where(on[:, i + 1, None], new, 0.0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None]) * on
        joint = np.exp(ahead[:, :-1, :, None] + b + (unary + behind)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        slope = np.r_[seen_w - np.einsum("stf,st->f", x, p) - ridge * (w - PRIOR), (seen_b - joint.sum(axis=(0, 1)) - slack * k * b).ravel()] / k
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w + move[:N_FEATURES], b + move[N_FEATURES:].reshape(2, 2)
    return Crf(w, b)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, left_out: int = 0, per_class: int = 1500, max_chars: int = 32_768,
) -> Crf:
    runs = []
    for text, good in labelled_sample(docs, labels, label, folds, left_out, per_class, max_chars):
        f, _ = line_features(text)
        y = np.ones(len(f), int) if not good else ((f[:, 9] + f[:, 10]) > 0).astype(int)
        runs += [(f[i:i + RUN], y[i:i + RUN]) for i in range(0, len(f), RUN)]
    return fit(runs)


def judge(text: str, crf: Crf, share: float = 0.5) -> dict:
    out = base_counts(text)
    n = out["n_words"]
    failed = n < 20 or 100 * out["n_repeat_words"] > 30 * n
    content = 0.0
    features, sizes = line_features(text)
    if len(sizes):
        content = float(sizes[crf.decode(features) == 0].sum() / sizes.sum())
    return {**out, "base_failed": failed, "content_share": content, "kept": not failed and content >= share}


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "content_share": pa.float64(), "kept": pa.bool_(),
}


def rules(docs: DataFrame, crf: Crf, share: float = 0.5) -> DataFrame:
    """``doc_id`` with the base counts, ``base_failed``, ``content_share`` and ``kept`` of every row."""

    def work(slices):
        for rows in slices:
            got = [judge(t, crf, share) for t in rows["text"]]
            yield {"doc_id": rows["doc_id"], **{c: [g[c] for g in got] for c in COLUMNS}}

    return common.map_batches(
        docs.select("doc_id", common.text_or_empty().alias("text")).selectExpr("cast(doc_id as long) as doc_id", "text"),
        {"doc_id": pa.int64(), **COLUMNS},
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean",
        work)


def keep_content(docs: DataFrame, crf: Crf, share: float = 0.5) -> DataFrame:
    """The rows that are kept, all columns as they are."""
    return common.filter_texts(docs, lambda: lambda texts: [judge(t, crf, share)["kept"] for t in texts])
