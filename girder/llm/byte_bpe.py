"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A text is cut by the pattern into pieces; each *distinct* piece is encoded once for each batch, and the
ids of chunks between spaces are remembered in a bounded table. Pieces that are tokens themselves need no merging. The others become
rows of matrices, bucketed by length and padded. In each round every row finds its leftmost pair of
minimum rank, merges it, and the matrix is compacted; only the two pairs beside a merge are looked up
again, in an open-addressing hash table over all pairs that form a token.

A piece of over LONG bytes is a matrix of one row, in which one round may merge all occurrences of the
minimum-rank pair, from the left, where no pair with the merged token has a lower rank (the outcome is
then the same as merging one at a time).

Null text is empty: no ids, the hash of no bytes. Empty tables give empty results. Columns other than
the id and the text are not read. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import python_texts, small_batches

LONG = 256
MEMORY = 900_000  # chunks remembered by each worker: about 200 MB
NONE = np.int32(2**31 - 1)
PAD = np.int32(-1)
#: A space that starts no chunk: before white space or at the end. Texts with one are cut by the pattern as a whole.
ODD_SPACE = regex.compile(r" (?=\s|$)")


class PairTable:
    """(left id, right id) -> rank of the joined bytes, by open addressing with linear probing.

    A slot holds left, right and rank in 21 bits each.
    """

    def __init__(self, tokens: dict[bytes, int]):
        keys, ranks = [], []
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 21 | right)
                    ranks.append(rank)
        if max(tokens.values(), default=0) >= 1 << 21:
            raise ValueError("ranks of more than 21 bits")
        key, rank = np.array(keys, np.int64), np.array(ranks, np.int64)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int64)
        at, left = self._home(key), np.arange(len(key))
        while len(left):  # every key tries its slot; of those that meet, one gets it
            free = self.slots[at[left]] == -1
            self.slots[at[left[free]]] = key[left[free]] << 21 | rank[left[free]]
            left = left[self.slots[at[left]] >> 21 != key[left]]
            at[left] = (at[left] + 1) & self.mask
        self.unsafe = np.zeros(max(tokens.values(), default=0) + 1, bool)
        for member in (key >> 21, key & 0x1FFFFF):
            self.unsafe[member[rank < member]] = True

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it forms no token or one side is padding."""
        key = (left.astype(np.int64) << 21 | right).ravel()
        key[(key < 0) | (right < 0).ravel()] = -2
        at = self._home(key)
        slot = self.slots[at]
        there = slot >> 21
        out = np.where(there == key, slot & 0x1FFFFF, NONE).astype(np.int32)
        todo = np.flatnonzero((there != key) & (slot != -1) & (key >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            slot = self.slots[at[todo]]
            hit = slot >> 21 == key[todo]
            out[todo[hit]] = slot[hit] & 0x1FFFFF
            todo = todo[~hit & (slot != -1)]
        return out.reshape(left.shape)


def _width(n: int) -> int:
    return n + n % 2 if n <= 24 else 1 << (n - 1).bit_length()


class ByteBpe:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.tokens)
        self.single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        by_id = [b""] * (max(self.tokens.values()) + 1)
        for token, rank in self.tokens.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.first: dict[str, bytes] = {}  # ids of a chunk at the start of a text
        self.known: dict[str, bytes] = {}  # ids of a chunk after a space

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rows: dict[int, list[int]] = {}
        raws = [piece.encode() for piece in pieces]
        for at, raw in enumerate(raws):
            if (whole := self.tokens.get(raw)) is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[at] = self._long(raw).astype("<u4").tobytes()
            else:
                rows.setdefault(_width(len(raw)), []).append(at)
        for width, bucket in rows.items():
            step = max(1, (1 << 18) // width)
            for start in range(0, len(bucket), step):
                part = bucket[start : start + step]
                self._matrix(part, [raws[at] for at in part], width, out)
        return out

    def _matrix(self, places: list[int], raws: list[bytes], width: int, out: list[bytes]) -> None:
        flat = np.frombuffer(b"".join([raw.ljust(width, b"\0") for raw in raws]), np.uint8).reshape(-1, width)
        ids = self.single[flat]
        ids[np.arange(width) >= np.fromiter(map(len, raws), np.int64, len(raws))[:, None]] = PAD
        rank = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        who = np.array(places)
        while len(who):
            n, row = ids.shape[1], np.arange(len(who))
            at = rank.argmin(1) if n > 1 else np.zeros(len(who), np.int64)
            best = rank[row, at] if n > 1 else np.full(len(who), NONE)
            if (done := best == NONE).any():
                full = ids[done]
                used = full != PAD
                raw, ends = full[used].astype("<u4").tobytes(), np.cumsum(used.sum(1)).tolist()
                start = 0
                for place, end in zip(who[done].tolist(), ends, strict=True):
                    out[place] = raw[4 * start : 4 * end]
                    start = end
                more = ~done
                who, ids, rank, at, best = who[more], ids[more], rank[more], at[more], best[more]
                row = np.arange(len(who))
                if not len(who):
                    break
            ids[row, at] = best
            stay = np.ones(ids.shape, bool)
            stay[row, at + 1] = False
            ids = ids[stay].reshape(-1, n - 1)
            stay = np.ones(rank.shape, bool)  # the merged pair's own rank goes; its two neighbours are new
            stay[row, at] = False
            rank = rank[stay].reshape(-1, n - 2)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.look_up(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < n - 2)
            rank[right, at[right]] = self.pairs.look_up(best[right], ids[right, at[right] + 1])

    def _long(self, raw: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(raw, np.uint8)]
        rank = self.pairs.look_up(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if self.pairs.unsafe[best]:
                at = at[:1]
            elif len(at) > 1:  # of a run of overlapping pairs, every second one
                first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 0]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            now = at - np.arange(len(at))
            for touched in (now[now > 0] - 1, now[now < len(ids) - 1]):
                rank[touched] = self.pairs.look_up(ids[touched], ids[touched + 1])
        return ids

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks of text that begin where a piece begins; each distinct piece is encoded once."""
        cut = [self.split(chunk) for chunk in chunks]
        pieces = list(set().union(*cut))
        ids_of = dict(zip(pieces, self.encode_pieces(pieces), strict=True)).__getitem__
        return [b"".join(map(ids_of, parts)) for parts in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        A space before anything but white space always begins a piece, so texts are cut there and the
        chunks between are encoded on their own, each distinct one once.
        """
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        odd: list[int] = []
        for at, text in enumerate(texts):
            if ODD_SPACE.search(text):
                odd.append(at)
            else:
                cut.append((at, text.split(" ")))
        new = list(set().union(*(parts[1:] for _, parts in cut)).difference(self.known))
        ids = dict(zip(new, self._encode_chunks([f" {x}" for x in new]), strict=True))
        if room := max(0, MEMORY - len(self.known)):
            self.known.update(list(ids.items())[:room])
        ids_of = self.known.__getitem__ if len(new) <= room else lambda x: self.known.get(x) or ids[x]
        heads = self._encode_chunks([parts[0] for _, parts in cut])
        for (at, parts), head in zip(cut, heads, strict=True):
            parts[0] = ""
            it = iter(parts)
            next(it)
            out[at] = head + b"".join(map(ids_of, it))
        for at, raw in zip(odd, self._encode_chunks([texts[at] for at in odd]), strict=True):
            out[at] = raw
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        which = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        if not len(which):
            return b""
        return self.all_bytes[np.arange(ends[-1]) + np.repeat(self.starts[which] - ends + lengths, lengths)].tobytes()


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def encode_column(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids``: the text's token ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        bpe = coder(ranks_path, pattern)
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.encode_batch(python_texts(batch.column(1))), pa.binary())], ["id", "ids"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode_column(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``raw``: the bytes that the ids stand for. Null ids give no bytes."""

    def run(batches):
        bpe = coder(ranks_path, pattern)
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["id", "raw"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, raw binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from these ids."""

    def run(batches):
        bpe = coder(ranks_path, pattern)
        for batch in small_batches(batches, 1):
            ids = bpe.encode_batch(python_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
