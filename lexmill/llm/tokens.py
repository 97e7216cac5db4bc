"""Token ids of whole texts, with a bounded memory of words already encoded."""

from __future__ import annotations

import re
import threading

from tokenizers import Tokenizer

#: White space in the sense of the tokenizers' patterns (Unicode White_Space).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_REGULAR = re.compile(f"[^{SPACES}](?:.*[^{SPACES}])?", re.DOTALL)
#: Precomposed Latin letters: with a space before them one pre-token that no normalizer but lower-casing changes.
_PLAIN = re.compile("[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+")
#: Marks whose runs behind a letter are pre-tokens of their own: all of ASCII but the apostrophe, which may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Runs of marks that are remembered: up to so many characters, and so many runs.
LONGEST_MARKS, MOST_MARKS = 16, 10_000


class _Known(dict):
    """Ids by word. A word that is not there is encoded and kept; ``KeyError``: it is not regular."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if ids is None:
            raise KeyError(word)
        self[word] = ids
        return ids


IDLE_S = 20


class Encoder:
    """Encodes with a tokenizer file, word by word.

    A piece is a run of white space with the run of other characters after it. The pre-tokenizers of
    byte-level and word-level files never join characters across the start of such a run, so the ids of
    a text are those of its pieces in order, and a piece that comes again costs a look-up. Most pieces
    are one space and a word, or a line end and a word: ``known`` has the ids of these by the word, or by line
    end and word. A new word of plain letters, with marks behind it or without, goes to the file's model itself where probes find
    that the steps before the model allow it (``_learn_word_rule``). ``keep`` bounds the memory: a full one is emptied.

    Strings of the file's added tokens have ids of their own wherever they stand, so a text that holds one goes through the
    library's tokenizer whole.
    """

    def __init__(self, path: str, keep: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # no piece holds one; in the middle of a text they are looked for first
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = sorted(t.content for t in added if not t.normalized)  # looked for in the text as it is
        shown = "|".join(re.escape(t.content) for t in added if t.normalized)
        self.shown = re.compile(shown, re.IGNORECASE).search if shown else None
        self.model = self.tokenizer.model
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.keep, self.timer = keep, None
        self.known = _Known(self._learn)
        self.marks: dict[str, bytes] = {}
        self.space, self.line, self.lower, self.letters = "", b"", False, {}
        self.by_model = self._learn_word_rule()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process: later tasks find the words of earlier ones.

        A worker outlives its stage, so an encoder that no task has asked for in ``IDLE_S`` seconds is let go.
        """
        if getattr(cls, "_own", (None,))[0] != path:
            cls._own = (path, cls(path))
        cls._own[1]._stay()
        return cls._own[1]

    def _stay(self) -> None:
        if self.timer:
            self.timer.cancel()
        self.timer = threading.Timer(IDLE_S, self._leave)
        self.timer.daemon = True
        self.timer.start()

    def _leave(self) -> None:
        cls = type(self)
        if getattr(cls, "_own", (None, None))[1] is self:
            cls._own = (None, None)
        self.known.clear()  # it refers back to the encoder, so the words would wait for the collector

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.timer:
            self._stay()
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added) or (self.shown and self.shown(t))]
        if whole:
            return self._with_added(texts, whole)
        known, out = self.known, []
        if len(known) > self.keep:
            known.clear()
        ids_of = known.__getitem__
        for text in texts:
            words = iter(text.replace("\n", " \n").split(" "))
            try:
                out.append(self._first(next(words)) + b"".join(map(ids_of, words)))
            except KeyError:  # white space other than single spaces and line ends between words
                out.append(self._irregular(text))
        return out

    def _with_added(self, texts: list[str], whole: list[int]) -> list[bytes]:
        held = set(whole)
        rest = iter(self.encode([t for i, t in enumerate(texts) if i not in held]))
        found = iter(self._whole([texts[i] for i in whole], self.library))
        return [next(found) if i in held else next(rest) for i in range(len(texts))]

    def _first(self, word: str) -> bytes:
        """The ids of a text's first word, which has no space before it."""
        ids = self._by_rule(word, "")
        if ids is None and _REGULAR.fullmatch(word):
            ids = self._whole([word])[0]
        if not ids:
            raise KeyError(word)
        return ids

    def _learn(self, word: str) -> bytes | None:
        """The ids of a space and a word, or of a line end and a word; None: not regular."""
        line = word[:1] == "\n"
        ids = self._by_rule(word[1:], "") if line else self._by_rule(word, self.space)
        if ids is not None:
            return self.line + ids if line else ids
        return self._whole([word if line else " " + word])[0] if _REGULAR.fullmatch(word, int(line)) else None

    def _by_rule(self, word: str, space: str) -> bytes | None:
        """The ids of plain letters, ``space`` before them, and of the marks behind them, by the model alone; None: not such a word."""
        body = word.rstrip(MARKS)
        marks = word[len(body):]
        if not (self.by_model and body.isalpha() and len(marks) <= LONGEST_MARKS and (body.isascii() or _PLAIN.fullmatch(body))):
            return None
        shared = marks and space == self.space  # the word comes with other marks and without
        ids = self.known.get(body) if shared else None
        if ids is None:
            of, shown = self.bytes_of, body.lower() if self.lower else body
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([of[t.id] for t in self.model.tokenize(space + shown)])
            if shared:
                self.known[body] = ids
        return ids + self._of_marks(marks) if marks else ids

    def _of_marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) >= MOST_MARKS:
                self.marks.clear()
            ids = self.marks[marks] = self._whole([marks])[0]
        return ids

    def _irregular(self, text: str) -> bytes:
        pieces = _PIECE.findall(text)
        key = [(p[1:] if p[1:2] != "\n" else "") if p[0] == " " else p if p[0] == "\n" else "" for p in pieces]
        learnt = {k: self._learn(k) for k in set(key).difference(self.known)}
        self.known.update((k, ids) for k, ids in learnt.items() if ids is not None)
        found = [self.known.get(k) for k in key]
        rest = iter(self._whole([p for p, ids in zip(pieces, found) if ids is None]))
        return b"".join([next(rest) if ids is None else ids for ids in found])

    def _whole(self, pieces: list[str], tokenizer: Tokenizer | None = None) -> list[bytes]:
        of = self.bytes_of
        return [b"".join([of[i] for i in e.ids]) for e in (tokenizer or self.tokenizer).encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn_word_rule(self) -> bool:
        """Find from probes how the steps before the model show a plain word and cut off marks; False: no such rule holds."""
        shown = [a for a, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")]
        self.space = shown[0][:-1] if len(shown) == 1 else ""
        self.lower = self._whole(["QZ"]) == self._whole(["qz"])
        self.letters = {b: self._letter(b) for b in range(0x80, 0x100)}
        self.line = self._whole(["\n"])[0]
        self.by_model = True
        words = ["word", "Wörter", "ÀÿÇà", "été", "Ñandú", "straße", "a", "Q", "tionestha"]
        probes = words + [f"{w}{m}" for w in words for m in (*MARKS, "***", ").", MARKS[:LONGEST_MARKS], MARKS[-LONGEST_MARKS:])]
        shown = [[self._by_rule(p, "") for p in probes], [self._learn(p) for p in probes], [self._learn("\n" + p) for p in probes]]
        self.known.clear()
        return shown == [self._whole([before + p for p in probes]) for before in ("", " ", "\n")]

    @staticmethod
    def _letter(b: int) -> str:
        """The printable letter that stands for a byte in byte-level vocabularies."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(b) if b in plain else chr(256 + [x for x in range(256) if x not in plain].index(b))
