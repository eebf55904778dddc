"""Packing along a space-filling curve.

Every document's token counts, hashed with signs into BUCKETS places, are projected to a few dimensions;
the place on a Hilbert curve through that space is its sort key. The table is range-partitioned and sorted
by the key, so that neighbours in a partition are alike, and each partition is cut every ``window``
tokens: all its sequences are full but for the last tokens, which become sequences whose sizes are
powers of two. Ties of the key are split by id, so a large group of copies spreads over partitions.

Tokens come from a tokenizer that drops white space; the ids of a run of non-space bytes do not depend
on what stands around it, so each worker remembers them in a bounded table.

Null text is empty and packs as the end id alone. A null id sorts first. Repeated rows are packed each.
An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep, resident, small_batches

WINDOW = 2048
DIMS, BITS = 4, 15
BUCKETS = 2048
MEMORY = 400_000  # words of which a worker remembers the ids
LONG = 200  # longer runs of bytes are not remembered


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of points with integer coordinates below 2**bits.

    points: one row each. Undoes the curve's rotations from the highest bit down, then reads the Gray code.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for high in range(bits - 1, 0, -1):
        q = np.int64(1 << high)
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for high in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << high), (1 << high) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for high in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> high & 1)
    return key


#: ASCII signs but for apostrophes, between an ASCII letter and white space, are a piece of their own.
STOP = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[ \n])")


def _plain(text: bytes) -> bytes:
    """The text with fewer different words: runs between white space that the tokenizer treats on their own.

    The tokenizer lower-cases, and splits letters from other signs; doing so here for ASCII changes no id.
    Texts that might hold a special token's string are left as they are.
    """
    return text if b"<|" in text else STOP.sub(rb" \g<0>", text.lower())


class _Tokens:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        dice = np.random.default_rng(20240229)
        self.bucket = dice.integers(0, BUCKETS, size + 1)
        self.sign = dice.choice(np.array([-1.0, 1.0]), size + 1)
        self.projection = dice.standard_normal((BUCKETS, DIMS))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        cut = pc.ascii_split_whitespace(pa.array([_plain(t) for t in texts], pa.large_binary()).view(pa.large_string()))
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.view(pa.large_binary()).to_pylist()
        ids = list(map(self.known.get, distinct))
        new = [k for k, x in enumerate(ids) if x is None]
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            for k, got in zip(part, self.tokenizer.encode_batch_fast([distinct[k].decode() for k in part], add_special_tokens=False), strict=True):
                ids[k] = array(self.kind.char, got.ids).tobytes()
        if room := max(0, MEMORY - len(self.known)):
            self.known.update([(distinct[k], ids[k]) for k in new if len(distinct[k]) <= LONG][:room])
        out = pa.array(ids, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1] if len(out) else np.zeros(1, np.int64)
        data = out.buffers()[2].to_pybytes() if len(out) else b""
        stops = ends[np.r_[0, np.cumsum(cut.value_lengths().to_numpy())]].tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def keys(self, ids: list[bytes]) -> np.ndarray:
        """The curve keys of documents."""
        out = np.zeros((len(ids), DIMS))
        for at, raw in enumerate(ids):
            which = np.frombuffer(raw, self.kind)
            if len(which):
                vector = np.bincount(self.bucket[which], self.sign[which], BUCKETS)
                vector = np.sign(vector) * np.sqrt(np.abs(vector))
                out[at] = vector @ self.projection / max(1e-9, np.sqrt(vector @ vector))
        # projections of unit vectors are about standard normal; the logistic curve makes them about even
        even = 1 / (1 + np.exp(-1.702 * out))
        return hilbert_keys(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _of(path: str) -> _Tokens:
    return resident(f"tokens {path}", lambda: _Tokens(path))


def _kind(path: str) -> np.dtype:
    """How wide the ids of a tokenizer are stored."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, curve_key, ids (binary, with the end id) of every row."""

    def run(batches):
        give_back(f"tokens {tokenizer_path}")
        tokens = _of(tokenizer_path)
        end = np.array([end_id], tokens.kind).tobytes()
        for batch in small_batches(batches, 1):
            ids = tokens.encode([x or b"" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens.keys(ids)), pa.array([x + end for x in ids], pa.binary())], ["id", "curve_key", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, f"id {kind}, curve_key long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``start`` counts the document's ids before the piece, ``offset`` is the piece's place in its sequence.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    unsigned = _kind(tokenizer_path)
    ordered = keep(tokenised(docs, tokenizer_path, end_id, id_col, text_col), "tokens").repartitionByRange("curve_key", "id").sortWithinPartitions("curve_key", "id")
    def run(batches):
        from pyspark import TaskContext

        give_back()
        sequence, filled = TaskContext.get().partitionId() << 33, 0
        rest: list[tuple] = []  # pieces of the sequence not yet full

        def columns(pieces: list[tuple]) -> pa.RecordBatch:
            each = list(zip(*pieces, strict=True))
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(each, kinds, strict=True)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        def piece(doc, ids, start, length, seq, offset):
            raw = ids[start : start + length].tobytes()
            return (doc, start, length, zlib.crc32(raw), len(ids), seq, offset, raw)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            done: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, unsigned).astype("<u4")
                start = 0
                while start < len(ids):
                    length = min(window - filled, len(ids) - start)
                    rest.append((doc, ids, start, length, sequence, filled))
                    start, filled = start + length, filled + length
                    if filled == window:
                        done += itertools.starmap(piece, rest)
                        rest, sequence, filled = [], sequence + 1, 0
            if done:
                yield columns(done)
        # the last tokens of the partition, in sequences of 2**k tokens
        done, sizes = [], [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]
        offset = 0
        for doc, ids, start, length, *_ in rest:
            while length:
                take = min(length, sizes[0] - offset)
                done.append(piece(doc, ids, start, take, sequence, offset))
                start, length, offset = start + take, length - take, offset + take
                if offset == sizes[0]:
                    sizes.pop(0)
                    sequence, offset = sequence + 1, 0
        if done:
            yield columns(done)

    out = ordered.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() without the ids."""
    return pack(docs, tokenizer_path, id_col=id_col, text_col=text_col).select(F.col(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
