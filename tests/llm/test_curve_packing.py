"""Packing: the curve visits neighbours, every id lies in one piece, sequences are full."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from girder.llm import curve_packing

PATH = P.path("word_bpe_49k.json")


def test_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = curve_packing.hilbert_keys(points, bits)
        order = np.argsort(keys)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_tokens():
    dice = random.Random(3)
    signs = ["a", "B", "é", "E", "́", ".", ",", " ", "\n", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "\xa0", "\x85", "\x1c", "Σ", "İ", "日", "!", "...", "\t"]
    docs = ["".join(dice.choice(signs) for _ in range(dice.randrange(40))) for _ in range(1500)]
    tokens, reference = curve_packing._Tokens(PATH), Tokenizer.from_file(PATH)
    got = [np.frombuffer(x, tokens.kind).tolist() for x in tokens.encode([d.encode() for d in docs])]
    assert got == [x.ids for x in reference.encode_batch(docs, add_special_tokens=False)]


def test_pieces(frame):
    dice = random.Random(4)
    rows = [(i, " ".join(dice.choice(["tree", "house", "river", "stone"]) for _ in range(dice.randrange(900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "x"), (102, "wood " * 5000), (103, "same"), (103, "same")]
    out = curve_packing.pieces(frame(rows), PATH).toPandas()
    reference = Tokenizer.from_file(PATH)
    want = sorted((str(i), len(reference.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    total = out[out.start == 0]
    assert sorted((str(int(i)) if i == i and i is not None else "None", n) for i, n in zip(total.doc_id, total.doc_tokens, strict=True)) == want
    assert out.length.sum() == sum(n for _, n in want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        n = int(s.length.sum())
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
        assert n <= 2048 and n & (n - 1) == 0
    ids = np.array([*reference.encode("wood " * 5000, add_special_tokens=False).ids, 1], "<u4")
    for r in out[out.doc_id == 102].itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert curve_packing.pieces(frame([]), PATH).count() == 0


def test_new_words_take_no_array_each(monkeypatch):
    """Many words seen for the first time; empty and blank texts between; ids as the tokenizer gives them."""
    tokens = curve_packing._Tokens(PATH)
    texts = [b"", " ".join(f"Wort{k}, né{k}." for k in range(500)).encode(), b" \n\t", b"a", b""]
    calls, real = [], np.array
    monkeypatch.setattr(np, "array", lambda *args, **options: calls.append(args) or real(*args, **options))
    got = [np.frombuffer(x, tokens.kind).tolist() for x in tokens.encode(texts)]
    assert len(calls) < 10
    assert got == [tokens.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert tokens.encode([]) == [] and tokens.encode([b"", b" "]) == [b"", b""]


def test_signs_after_a_word_make_no_new_words():
    """Runs of signs before white space are cut off the word, so fewer words are to be remembered; no id changes."""
    tokens = curve_packing._Tokens(PATH)
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    dice = random.Random(8)
    words = [dice.choice(["ab", "É", "Zé", "x1", "7", "don't", "e\u0301"]) + "".join(dice.choices(signs, k=dice.randrange(4))) + dice.choice([" ", "\n", "  ", "s ", "\u0338 ", "\u00a0", "\t"]) for _ in range(4000)]
    texts = ["".join(words[k : k + 40]) for k in range(0, 4000, 40)] + [f"ab{a}{b} cd{a}\nef{b}{a}" for a in signs for b in signs]
    got = [np.frombuffer(x, tokens.kind).tolist() for x in tokens.encode([t.encode() for t in texts])]
    assert got == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tokens.known.clear()
    tokens.encode([" ".join(f"word{a}" for a in signs if a != "'").encode() + b"!! "])
    assert len([w for w in tokens.known if w.startswith(b"word")]) == 1
