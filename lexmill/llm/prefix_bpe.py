"""Byte-level BPE by prefix dynamic programming: exact encoding, appends, edits and decoding.

Byte-pair encoding gives every byte string one encoding, and a prefix of that encoding is the encoding of its own
bytes. So each prefix of a string has exactly one valid last token, and that is all a ``Table`` stores: of the tokens that
end at a byte, the valid one stands stably beside the last token of the prefix before it. Two tokens stand stably
together if no merge across their border comes before a merge inside one of them that takes its side of the border away;
undoing the merges of both, latest first, decides it. The tokens that end at a byte come from an Aho-Corasick automaton,
so work is linear in the bytes, for pieces of megabytes too.

Appends are exact: entries of the old bytes stand and new bytes get theirs. After an edit the entries before it stand, and new
ones are made only until as many in a row as the longest token has bytes agree with the old. ``Text`` keeps
a text's pieces (matches of the pattern, each encoded separately) with their tables, and matches again only near an edit.

``digests`` runs over a table of documents where its rows lie, without a shuffle. Texts are cut at spaces and line
ends at which the pattern ends a piece whatever follows, and a bounded memory holds the ids of chunks met before.

Cases: a null or empty text has no ids; a null ``doc_id`` stays null; rows that repeat an id get a row each; a text of any
length is encoded whole; a byte that is no token raises an error; other columns are not looked at; an empty table
gives no row.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Tokens by rank, the two tokens that each is merged from, and which pairs stand stably side by side."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 1_000_000):
        import ahocorasick

        self.ranks, self.keep = ranks, keep
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.halves[rank] = self._halves(token, rank)
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self.ending = automaton.iter
        self.merged = {pair: rank for rank, pair in self.halves.items()}
        self.stable: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that stand before the merge that makes a token of its bytes."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low >= rank:
                raise ValueError(f"no merges lead to the token of rank {rank}")
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stands(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of two tokens is these two tokens."""
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) >= self.keep:
                self.stable.clear()
            found = self.stable[left, right] = self._undo(left, right)
        return found

    def _undo(self, left: int, right: int) -> bool:
        halves, soonest = self.halves, float("inf")  # a merge across the border counts if it comes before this
        while True:
            if self.merged.get((left, right), soonest) < soonest:
                return False
            a, b = left if left in halves else -1, right if right in halves else -1
            if a == b == -1:
                return True
            if a > b:  # of two merges of one rank the one further left comes first
                soonest, left = a, halves[a][1]
            else:
                soonest, right = b + 0.5, halves[b][0]

    def extend(self, last: list[int], data: bytes, enough: Callable[[], bool] | None = None) -> None:
        """Add to ``last`` the last tokens of the prefixes of ``data`` that it still lacks, until there are ``enough``."""
        stable, stands, done, full = self.stable, self.stands, len(last), len(data)
        base = max(0, done - self.longest + 1)  # tokens that end behind what is done begin here or later
        for end, (rank, size) in self.ending(data[base:].decode("latin-1")):
            end += base
            if end < done:  # that prefix has its token
                continue
            if end > done:
                break
            if size <= end:
                pair = (last[end - size], rank)
                if not (stable[pair] if pair in stable else stands(*pair)):
                    continue
            last.append(rank)
            done += 1
            if enough is not None and enough():
                return
        if done < full:
            raise ValueError(f"no token ends at byte {done}")

    def spell(self, last: list[int]) -> list[int]:
        """The ids that a full list of last tokens stands for."""
        out, at, token = [], len(last), self.token
        while at:
            out.append(last[at - 1])
            at -= len(token[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        last: list[int] = []
        self.extend(last, data)
        return self.spell(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Table:
    """The last token of every prefix of ``data``. Tables do not change; appends and edits make new ones."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes, last: list[int] | None = None):
        self.vocabulary, self.data, self.last = vocabulary, data, [] if last is None else last
        vocabulary.extend(self.last, data)

    def append(self, more: bytes) -> Table:
        return Table(self.vocabulary, self.data + more, list(self.last))

    def replace(self, start: int, stop: int, more: bytes) -> tuple[Table, int]:
        """The table with ``more`` in place of the bytes from ``start`` to ``stop``, and how many entries were made for it."""
        data, last, shift, same = self.data[:start] + more + self.data[stop:], self.last[:start], stop - start - len(more), 0

        def enough() -> bool:
            nonlocal same
            at = len(last) - 1
            same = same + 1 if at >= start + len(more) and last[at] == self.last[at + shift] else 0
            return same >= self.vocabulary.longest  # all that follows looks back no further than this

        self.vocabulary.extend(last, data, enough)
        made = len(last) - start
        return Table(self.vocabulary, data, last + self.last[len(last) + shift:]), made

    def ids(self) -> list[int]:
        return self.vocabulary.spell(self.last)


class Text:
    """A text with the tables of its pieces, kept exact under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.tables = "", []
        self.append(text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, more: str) -> int:
        """Put ``more`` in place of the characters from ``start`` to ``stop``; how many entries were made for it.

        What the pattern matches from a place on depends on the text behind it alone, and a match looks no further than two pieces on
        (white space before a word, the letters of a contraction). So matching starts two pieces before that of
        the character before the edit, and stops where a piece begins at the start of an old piece behind the edit.
        """
        old, text, shift = self.tables, self.text[:start] + more + self.text[stop:], len(more) - (stop - start)
        starts = [0, *accumulate(len(t.data.decode()) for t in old)]
        first = max(0, bisect_left(starts, start, hi=len(old)) - 3)
        behind = {s + shift: k for k, s in enumerate(starts) if s >= stop}
        at, pieces = starts[first], []
        while at < len(text) and not (at >= start + len(more) and at in behind):
            pieces.append(self.pattern.match(text, at).group().encode())
            at += len(pieces[-1].decode())
        last = behind[at] if at in behind and at >= start + len(more) else len(old)
        tables, made = [], 0
        for k, piece in enumerate(pieces):
            near = old[first + k] if first + k < last else None
            table, n = self._from(near, piece)
            tables.append(table)
            made += n
        self.text, self.tables = text, old[:first] + tables + old[last:]
        return made

    def _from(self, near: Table | None, piece: bytes) -> tuple[Table, int]:
        """The table of a piece, from that of a similar one if there is one."""
        if near is None:
            return Table(self.vocabulary, piece), len(piece)
        head, most = 0, min(len(piece), len(near.data))
        while head < most and piece[head] == near.data[head]:
            head += 1
        tail = 0
        while tail < most - head and piece[-1 - tail] == near.data[-1 - tail]:
            tail += 1
        return near.replace(head, len(near.data) - tail, piece[head:len(piece) - tail])

    def ids(self) -> list[int]:
        return list(chain.from_iterable(t.ids() for t in self.tables))


class Encoder:
    """Ids of whole texts, with a bounded memory of chunks met before.

    A chunk starts at a space or line end, and the pattern ends a piece there: always behind a character that is no white
    space, and else if another such follows. Texts with other white space are matched as a whole. Ids are kept as packed
    numbers; of two generations of chunks the older goes when the younger is full, so frequent chunks stay.
    """

    def __init__(self, ranks: str, pattern: str, keep: int = 600_000):
        import regex

        self.vocabulary, self.keep = Vocabulary(read_ranks(ranks)), keep
        self.dtype = np.dtype("<u2" if max(self.vocabulary.token) < 1 << 16 else "<u4")
        self.packed = {rank: rank.to_bytes(self.dtype.itemsize, "little") for rank in self.vocabulary.token}
        self.pieces = regex.compile(pattern).findall
        self.irregular = regex.compile(r"\s[ \n](?:\s|\Z)").search
        #: By a chunk without its space; one that starts with a line end has no space before it.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Encoder:
        """The encoder of this worker process: later tasks find the chunks of earlier ones."""
        if getattr(cls, "_own", (None,))[0] != (ranks, pattern):
            cls._own = ((ranks, pattern), cls(ranks, pattern))
        return cls._own[1]

    def _meet(self, chunk: str) -> bytes:
        """The ids of a chunk, put among the young."""
        ids = self.young.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is None:
                pieces = self.pieces(chunk if chunk[:1] == "\n" else " " + chunk)
                ids = self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._known, pieces))
            self.young[chunk] = ids
        return ids

    def _known(self, piece: str) -> bytes:
        """The ids of a piece; one behind a space shares the entry of its chunk."""
        return self._meet(piece[1:]) if piece[:1] == " " and piece[1:2] not in ("", "\n") else self._piece(piece)

    def _piece(self, piece: str) -> bytes:
        ids, packed = self.vocabulary.encode(piece.encode()), self.packed
        return packed[ids[0]] if len(ids) == 1 else b"".join([packed[i] for i in ids])

    def encode(self, text: str) -> np.ndarray:
        if self.irregular(text):
            found = [*map(self._known, self.pieces(text))]
            self._age()
            return np.frombuffer(b"".join(found), self.dtype)
        first, *words = text.replace("\n", " \n").split(" ")
        young, meet = self.young, self._meet
        for word in set(words).difference(young):
            meet(word)
        found = [*map(self._piece, self.pieces(first)), *map(young.__getitem__, words)]
        self._age()
        return np.frombuffer(b"".join(found), self.dtype)

    def _age(self) -> None:
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256`` of every row: its ids, and what they decode to."""

    def work(slices):
        encoder = Encoder.of(ranks, pattern)
        decode, shown = encoder.vocabulary.decode, {rank: str(rank) for rank in encoder.vocabulary.token}.__getitem__
        for rows in slices:
            out = {k: [] for k in ("n_tokens", "n_bytes", "ids_sha256", "decoded_sha256")}
            for text in rows["text"]:
                ids = encoder.encode(text).tolist()
                data = decode(ids)
                for column, v in zip(out.values(), (
                        len(ids), len(data), hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest())):
                    column.append(v)
            yield {"doc_id": rows["doc_id"], **out}

    return common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")),
        {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_bytes": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()},
        "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string", work, rows_at_once=64)
