"""Byte-level BPE against the tiktoken library."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from girder.llm import byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    dice = random.Random(1)
    out = ["", " ", "a" * 3000, "ab" * 2000, "x  y\n\n z ", "<|endoftext|>", "\x1c\x1d a", "日本語" * 90, "a" * 700 + " b", "it's  we'll\t'S"]
    out += ["".join(dice.choice("abc xyz\n'st0 é—") for _ in range(dice.randrange(120))) for _ in range(400)]
    return out + ["".join(dice.choice("abcdefgh") for _ in range(9000))]


def test_ids_and_round_trip(reference):
    coder = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    for text, ids in zip(texts(), coder.encode_batch(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_a_full_memory_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 3)
    coder = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    for text in texts()[:150]:
        assert np.frombuffer(coder.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_columns(frame, reference):
    docs = frame([(1, "Hello there"), (None, None), (3, ""), (3, "")])
    rows = {(r.doc_id, r.n_tokens) for r in byte_bpe.digests(docs, RANKS, P.PATTERN).collect()}
    assert rows == {(1, 2), (None, 0), (3, 0)}
    coded = byte_bpe.encode_column(docs, RANKS, P.PATTERN)
    assert sorted(bytes(r.raw) for r in byte_bpe.decode_column(coded, RANKS, P.PATTERN).collect()) == [b"", b"", b"", b"Hello there"]
    assert byte_bpe.digests(frame([]), RANKS, P.PATTERN).count() == 0
