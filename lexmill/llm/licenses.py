"""License scan: places of license phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows of words, at half-overlapping starts over the whole text, of a width of twice the template's length or
more, so every run of words as long as a template lies whole in some block. A block meets a template if it holds at
least ``containment`` of the template's distinct words. Words are ordered by how many times the corpus has them,
rarest first; of n words a template's first n - ceil(containment n) + 1 are its prefix, one of which every
such block holds. Blocks with a prefix word pass the length filter (enough template words at all) and the
positional filter (enough left after the match in either order), and are then counted exactly.

The templates are a bounded list and go to every task; the word counts are sums of their words over all documents,
added up before the shuffle. Documents stay where they lie.

Cases: a null or empty text has no words and no match; equal words and repeated places all count; a null ``doc_id``
stays null; repeated rows get a row each; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Phrases and the labels they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of well-known licenses, in their published words.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
     "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means."),
)
#: A-Z in lower case; whatever is neither a letter, a digit nor beyond ASCII parts words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    need: int
    width: int


def order_templates(templates, counts: dict[bytes, int], containment: float) -> list[Template]:
    """Templates with their words in global order. Widths are powers of two, so that few kinds of block arise."""
    out = []
    for label, text in templates:
        run = words_of(text)
        own = tuple(sorted(set(run), key=lambda w: (counts.get(w, 0), w)))
        out.append(Template(label, own, math.ceil(containment * len(own) - 1e-9), 1 << (2 * len(run) - 1).bit_length()))
    return out


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many times all documents together have each word of a bounded vocabulary."""

    def work(slices):
        for rows in slices:
            total: Counter = Counter()
            for text in rows["text"]:
                total.update(filter(vocabulary.__contains__, words_of(text)))
            yield {"word": list(total), "n": list(total.values())}

    counts = common.map_batches(
        docs.select(common.text_or_empty().alias("text")), {"word": pa.binary(), "n": pa.int64()}, "word binary, n long", work)
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Scanner:
    """Finds phrases and template blocks in a text's words."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], phrases=PHRASES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        self.templates = templates
        vocabulary = {w for t in templates for w in t.words}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            for i, w in enumerate(t.words[:len(t.words) - t.need + 1]):
                self.index.setdefault(w, []).append((k, i))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start word, label) of every place of a phrase."""
        joined, out = b" " + b" ".join(words) + b" ", []
        for phrase, label in self.phrases:
            at, before, word = joined.find(phrase), 0, 0
            while at >= 0:
                word, before = word + joined.count(b" ", before, at), at  # words between two places are counted once
                out.append((word, label))
                at = joined.find(phrase, at + 1)
        return sorted(out)

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, containment) of every block that meets a template's threshold."""
        index, found, done = self.index, [], set()
        for at in [i for i, w in enumerate(words) if w in index]:
            for k, i in index[words[at]]:
                t = self.templates[k]
                half = t.width // 2
                for start in range(max(0, at // half - 1) * half, at + 1, half):
                    if start + t.width <= at or (k, start) in done:
                        continue
                    block = sorted({w for w in words[start:start + t.width] if w in self.rank}, key=self.rank.__getitem__)
                    if len(block) < t.need or 1 + min(len(t.words) - i - 1, len(block) - block.index(words[at]) - 1) < t.need:
                        continue
                    done.add((k, start))
                    share = len(set(t.words).intersection(block))
                    if share >= t.need:
                        found.append((t.label, start, len(words[start:start + t.width]), share / len(t.words)))
        return found


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = 0.9) -> DataFrame:
    """``doc_id, n_words, places, blocks`` of every row: phrase places and the template blocks met."""
    vocabulary = {w for _, text in templates for w in words_of(text)}
    counts = word_counts(docs, vocabulary)
    ordered = order_templates(templates, counts, containment)
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    block = pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])

    def work(slices):
        scanner = Scanner(ordered, counts)
        for rows in slices:
            words = [words_of(t) for t in rows["text"]]
            yield {
                "doc_id": rows["doc_id"], "n_words": [len(w) for w in words],
                "places": [[dict(word=a, label=x) for a, x in scanner.places(w)] for w in words],
                "blocks": [[dict(label=x, start=a, n_words=n, containment=c) for x, a, n, c in scanner.blocks(w)] for w in words],
            }

    return common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")),
        {"doc_id": pa.int64(), "n_words": pa.int64(), "places": pa.list_(place), "blocks": pa.list_(block)},
        "doc_id long, n_words long, places array<struct<word:long,label:string>>, "
        "blocks array<struct<label:string,start:long,n_words:long,containment:double>>", work)


def summary(found: DataFrame) -> DataFrame:
    """One row per document: counts of places, labels and the best containment."""
    base = F.transform("places", lambda p: p["label"])
    both = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        text(base).alias("base_labels"), text(both).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), F.size("blocks").cast("long").alias("n_blocks"))
