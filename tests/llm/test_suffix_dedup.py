"""Suffix sorting against sorted(), and removal against a set of windows."""

import random
import tempfile

import numpy as np
import pytest

from girder.llm import induced, suffix_dedup


@pytest.mark.parametrize("options", [{}, {"in_memory": 2}, {"in_memory": 5, "buffer": 7}])
def test_suffix_order_and_common_prefixes(options):
    dice = random.Random(5)
    for _ in range(120):
        alphabet = dice.choice([b"ab", b"abc", bytes(range(1, 30)), b"\0ab"])
        text = bytes(dice.choice(alphabet) for _ in range(dice.randrange(120)))
        text = text[:20] * 4 + text if dice.random() < 0.3 else text
        with tempfile.TemporaryDirectory() as folder:
            out = list(induced.sort_suffixes(np.frombuffer(text, np.uint8), folder, **options))
        order = [p for positions, _ in out for p in positions.tolist()]
        shared = [c for _, common in out for c in common.tolist()]
        assert order == sorted(range(len(text)), key=lambda k: text[k:])
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = next((i for i in range(min(len(a), len(b), induced.CAP)) if a[i] != b[i]), min(len(a), len(b), induced.CAP))
            assert shared[k] == n


def test_a_shard_far_larger_than_memory(tmp_path):
    """With bounds far below the text's length, recursion and queues go to disk: a text four times as long takes no more
    memory, and comes out in order."""
    import tracemalloc

    dice = np.random.default_rng(3)
    words = [bytes(dice.integers(97, 101, dice.integers(2, 6)).astype(np.uint8)) for _ in range(60)]
    peaks = []
    for many in (16000, 48000):
        text = np.frombuffer(b" ".join(words[k] for k in dice.integers(0, 60, many)), np.uint8)
        tracemalloc.start()
        last, n, right = None, 0, True
        for positions, _ in induced.sort_suffixes(text, str(tmp_path), in_memory=4000, buffer=10_000, cap=40):
            for p in positions[:: max(1, len(positions) // 5)].tolist():
                here = text[p : p + 40].tobytes()
                right &= last is None or last <= here
                last = here
            n += len(positions)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert right and n == len(text) > 7 * 10_000
    assert peaks[1] < 1.5 * peaks[0]


def brute(rows, length=100):
    seen, out = {}, set()
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if seen.setdefault(w, (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.add((i, len(raw), sum(gone), spans, kept))
    return out


def corpus():
    dice = random.Random(9)
    words = ["".join(dice.choice("abcdeé") for _ in range(dice.randrange(1, 8))) for _ in range(300)]
    passages = [" ".join(dice.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(40):
        text = " ".join(dice.choice(words) for _ in range(dice.randrange(0, 200)))
        for p in passages:
            if dice.random() < 0.4:
                cut = dice.randrange(len(text) + 1)
                text = text[:cut] + p[dice.randrange(20) : len(p) - dice.randrange(20)] + text[cut:]
        rows.append((i, text))
    return rows + [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, "a" * 1000), (55, "ab" * 400 + "x" + "ab" * 400), (56, "short")]


def test_removal(frame):
    got = {(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.suffix_dedup(frame(corpus())).collect()}
    assert got == brute(corpus())


def test_stage_keeps_rows_columns_and_characters(frame):
    docs = frame(corpus() + [(None, "é" * 80), (60, "é" * 80)])
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert len(rows) == docs.count() and rows[52] is None and rows[51] == "" and "�" not in "".join(t or "" for t in rows.values())


def test_empty_table_and_repeated_ids(frame):
    assert suffix_dedup.suffix_dedup(frame([])).count() == 0
    twice = suffix_dedup.suffix_dedup(frame([(1, "q" + "abcdefghij" * 5 + "klmnopqrst" * 7), (1, "q" + "abcdefghij" * 5 + "klmnopqrst" * 7)])).collect()
    assert len(twice) == 2 and twice[0].n_removed == twice[1].n_removed


def hot_corpus():
    """Lines of 20, 99 and 130 bytes in most documents, with different text around them."""
    dice = random.Random(3)
    lines = ["".join(dice.choice("abcdefgh ") for _ in range(n)) for n in (20, 99, 130)]
    rows = []
    for i in range(120):
        own = ["".join(dice.choice("klmnopqrst ") for _ in range(dice.randrange(30, 200))) for _ in range(4)]
        rows.append((i, own[0] + lines[0] + own[1] + lines[1] + own[2] + lines[2] + own[3] + (lines[2] + own[3] if i % 3 == 0 else "")))
    return rows + [(200, rows[5][1]), (201, rows[6][1] + "x"), (202, "a" * 600), (203, "b" + "a" * 300)]


def test_a_hot_anchor_is_split_and_results_are_the_same(frame):
    rows = suffix_dedup._rows(frame(hot_corpus()), "doc_id", "text")
    largest = [suffix_dedup._grouped(rows, 100, 16, group)[2].agg({"bytes": "max"}).first()[0] for group in (suffix_dedup.GROUP, 4000)]
    assert largest[0] > 15_000 and largest[1] <= 4000
    for group in (4000, 300):
        got = {(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.suffix_dedup(frame(hot_corpus()), group=group).collect()}
        assert got == brute(hot_corpus())


def test_only_windows_that_may_recur_are_sorted(tmp_path):
    """Segments that share an anchor and no whole window do not reach the sort; what is covered stays the same."""
    dice = random.Random(11)
    anchor, passage = dice.randbytes(16), dice.randbytes(130)
    segments = [dice.randbytes(80) + anchor + dice.randbytes(80) for _ in range(40)]
    segments += [dice.randbytes(30) + passage + dice.randbytes(30), passage + dice.randbytes(60), b"x" * 150]

    def shard(name):
        (tmp_path / name).mkdir()
        out = suffix_dedup.Shard(str(tmp_path / name))
        for doc, raw in enumerate(segments):
            out.add(raw, len(raw) - 99, doc, 0)
        return out

    small, numbers, cut = shard("trimmed").trimmed(100, 1 << 22)
    assert numbers.tolist() == [40, 41, 42] and cut.tolist() == [30, 0, 0]
    assert small.size == 131 + 131 + 151
    runs = {int(numbers[k]): [(r["a"] + int(cut[k]), r["b"] + int(cut[k])) for r in v] for k, v in small.covered(100, 1 << 22, 1 << 20).items()}
    whole, every, none = shard("whole").trimmed(100, 10)
    assert every.tolist() == list(range(43)) and not none.any() and whole.size == sum(map(len, segments)) + 43
    assert runs == {k: [(r["a"], r["b"]) for r in v] for k, v in whole.covered(100, 1 << 22, 1 << 20).items()}
    assert runs == {41: [(0, 31)], 42: [(1, 51)]}
    empty, numbers, _ = suffix_dedup.Shard(str(tmp_path / "whole")).trimmed(100, 1 << 22)
    assert empty.covered(100, 1 << 22, 1 << 20) == {} and not len(numbers)
