import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lexmill.llm import prefix_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　 'stdreméÀß漢字🙂.,!|$09Aá̇Σς İaeiou     "


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.Encoder(RANKS, public_tokenizers.PATTERN, keep=500)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})


def some(rng, most):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most)))


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(4)
    for _ in range(4000):
        text = some(rng, 30)
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
        word = "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 50)))
        assert encoder.encode(word).tolist() == library.encode_ordinary(word)


def test_each_prefix_has_the_last_token_of_its_encoding(encoder):
    v = encoder.vocabulary
    data = " unbelievablythethequeueing".encode()
    table = prefix_bpe.Table(v, data)
    for n in range(1, len(data) + 1):
        ids = prefix_bpe.Table(v, data[:n]).ids()
        assert table.last[n - 1] == ids[-1] and v.decode(ids) == data[:n]
        assert all(v.stands(a, b) for a, b in zip(ids, ids[1:]))


def test_appends_and_edits(encoder, library):
    rng, v = random.Random(6), encoder.vocabulary
    for _ in range(300):
        own = prefix_bpe.Text(v, public_tokenizers.PATTERN, some(rng, 40))
        for _ in range(5):
            start = rng.randint(0, len(own.text))
            stop = min(len(own.text), start + rng.choice([0, 0, 1, 3, 9]))
            own.replace(start, stop, some(rng, 6))
            assert own.ids() == library.encode_ordinary(own.text)
        own.append("'re")
        assert own.ids() == library.encode_ordinary(own.text)


def test_an_edit_of_a_long_piece_makes_few_entries(encoder, library):
    rng, v = random.Random(8), encoder.vocabulary
    text = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    table, made = prefix_bpe.Table(v, text.encode()).replace(10_000, 10_003, b"zz")
    assert made < 3 * v.longest and table.ids() == library.encode_ordinary(text[:10_000] + "zz" + text[10_003:])
    assert table.append(b"tail").ids() == library.encode_ordinary(table.data.decode() + "tail")


def test_digests(spark, odd, library):
    rows = prefix_bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), len(text.encode()), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert prefix_bpe.digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_byte_that_is_no_token():
    v = prefix_bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2})
    assert v.encode(b"abba") == [2, 1, 0]
    for data in (b"xab", b"abx", b"axb"):
        with pytest.raises(ValueError):
            v.encode(data)
