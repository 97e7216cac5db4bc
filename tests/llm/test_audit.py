import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from lexmill.llm import audit

SCHEMA = "doc_id long, text string, source string, part string, mask int, n int"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(rows, labels):
    """Every order applied to every document in turn."""
    known = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            known[i] = [max(known[i][0], q or 0), max(known[i][1], t or 0)]
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text]}
        good, toxic = known[i] if i is not None else (0, 0)
        docs.append((source or "", fails, good == 1, toxic == 1))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return out


def test_audit_equals_every_order_in_turn(spark):
    rng = random.Random(2)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "A", "word " * 250, long, long + " $", long.upper(), long + " X" * 100, "tab\there\x0bthere | x", "é" * 30, "dup text", "dup text"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "a", "b", "hot", "hot", "hot"])) for _ in range(400)]
    rows += [(900 + i, "the same everywhere", "hot") for i in range(200)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(6)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in audit.audit(docs, lab).collect()}
    want = brute(rows, labels)
    assert len(got) == 600 * len({p for p, _, _ in want}) and got == want


def test_empty_tables(spark):
    docs, lab = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, lab).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    rows = audit.audit(one, lab).collect()
    assert len(rows) == 600 and all(r["part"] == "" and r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in rows)


def test_min_plus_gives_the_first_failed_filter():
    orders, position, step = audit.removal_steps(4)
    for m in range(16):
        for o, s in zip(orders, step[m]):
            hit = [k + 1 for k, f in enumerate(o) if m >> f & 1]
            assert s == (hit[0] if hit else np.inf)
