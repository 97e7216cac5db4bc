import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm import common, packing, token_files
from lexmill.llm.tokens import Encoder

from .conftest import TEXTS

FILES = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("path", FILES.values())
def test_pieces_give_the_ids_of_whole_texts(path):
    encoder, fresh, rng = Encoder(path, keep=500), Tokenizer.from_file(path), random.Random(3)
    letters = " \n\t\r\x0b\x1c\x85\xa0 'stdéÀß漢字🙂.,!|$09Aá̇Σς İ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [t or "" for t in TEXTS]
    for at in range(0, len(texts), 100):
        want = [e.ids for e in fresh.encode_batch(texts[at:at + 100], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[at:at + 100])] == want


def test_plan_places_every_id_once_without_padding():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.choice([1, 2, 7, 100, 511, 512, 513, 3000, 4096, 9000, rng.randint(1, 6000)]) for _ in range(rng.randint(0, 40))]
        placed = defaultdict(list)
        for pieces in packing.plan(lengths):
            total = sum(n for _, _, n in pieces)
            assert total <= 4096 and total & (total - 1) == 0
            for d, start, n in pieces:
                placed[d].append((start, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, k in sorted(placed[d]):
                assert start == at
                at += k
            assert at == n


def test_step_groups_are_balanced():
    sizes = [4096] * 40 + [1024] * 30 + [512] * 9
    loads = defaultdict(int)
    for s, g in zip(sizes, packing.deal(sizes, 16_384)):
        loads[g] += s
    assert max(loads.values()) - min(loads.values()) <= 512


def test_pack_rebuilds_documents(odd):
    path = FILES["word_bpe_49k.json"]
    rows = packing.pack(odd, path, end_id=2, with_ids=True).collect()
    encoder = Encoder(path)
    want = sorted(((r["doc_id"] is None, r["doc_id"], encoder.encode([r["text"] or ""])[0] + b"\x02\0\0\0") for r in odd.collect()), key=str)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, pieces in by_doc.items():
        own = sum(4 * r["length"] for r in pieces)
        assert own == sum(len(x) for _, i, x in want if i == doc_id)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0
    assert packing.pack(odd.limit(0), path, end_id=2).count() == 0


def test_token_files_round_trip(spark, odd):
    path = FILES["byte_bpe_50k.json"]
    folder = "file://" + common.scratch(spark, "t").removeprefix("file://")
    manifest = token_files.write_token_files(odd, folder, path, end_id=0, length=64, rows_per_batch=8)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    encoder, at = Encoder(path), 0
    rows = [(r["doc_id"], encoder.encode([r["text"] or ""])[0] + bytes(4)) for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(i, len(x) // 4, zlib.crc32(x)) for i, x in rows]
    for r, (_, x) in zip(got, rows):
        assert r["start"] == at
        at += len(x) // 4
    for f in manifest.collect():
        reader = token_files.open_file(f["file"] + ".arrow")
        batch = reader.get_batch(0)
        assert batch.schema.field("input_ids").type.list_size == 64 and batch.column("mask").type.list_size == 64
        kept = sum(sum(map(sum, reader.get_batch(i).column("mask").to_pylist())) for i in range(reader.num_record_batches))
        assert kept == f["n_tokens"]
    empty = token_files.write_token_files(odd.limit(0), folder, path, end_id=0)
    assert token_files.read_token_files(empty).count() == 0


@pytest.mark.parametrize("path", FILES.values())
def test_added_tokens_have_the_ids_of_the_library(path):
    texts = ["a <|endoftext|> b", "<|startoftext|>x", "<|ENDOFTEXT|> y", "plain words here", "two <|endoftext|><|endoftext|>\n  lines", "<|endoftext"]
    fresh = Tokenizer.from_file(path)
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)] == want


@pytest.mark.parametrize("path", FILES.values())
def test_new_words_with_marks_or_at_line_starts_go_to_the_model_alone(path, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdegilmnorstuzäéñßÜQ") for _ in range(rng.randint(1, 9)))
    marks = ["", "", ".", ",", "***", "!?", '.")', "$$$", "_", "--"]
    texts = ["".join(rng.choice((" ", " ", "\n")) + word() + rng.choice(marks) for _ in range(40))[1:] for _ in range(50)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder, pieces = Encoder(path), []
    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda some, *more: pieces.extend(some) or whole(some, *more))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert encoder.by_model and {p for p in pieces if p} <= set(marks)  # each run of marks once, no word
