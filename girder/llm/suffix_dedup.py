"""Removing repeated byte strings with suffix order from external induced sorting.

Every byte goes that lies in a string of ``length`` bytes which also starts earlier in the corpus: in a
document of smaller id, or earlier in the same one. Strings are judged on the input.

1. Anchors. Every window of ``length`` bytes has one anchor: the first of its GRAM-byte strings with the least
   hash. Equal windows have equal anchors at equal distances, so windows whose anchor occurs once in the
   corpus are unique, and consecutive windows of one anchor form a segment. Spark counts the anchors.
2. Equal segments of repeated anchors are combined (first place, number of places), so a text with any number
   of copies has each of its segments once. An anchor with one kind of segment needs no more: all places
   but the first are covered.
3. Where the kinds of segments of one anchor have more than GROUP bytes, all places of that anchor are split: the
   windows whose anchor stands at one of ``width`` neighbouring offsets share the anchor with the bytes around it,
   length + 1 - width in all, and a hash of these is the new anchor. Equal windows have equal offsets, so they stay
   together. WIDTHS gets smaller while a group is too large; at 1 all windows of a group are equal and need no sorting.
   Equal parts are combined as in 2.
4. The kinds of segments of all other anchors get their bytes. A shard holds all segments of its anchors; they are
   written to disk, less the windows at their ends whose hash no other window of the shard has, and their suffixes sorted
   by induced sorting with common prefixes. Suffixes that share ``length``
   bytes are neighbours; all but the first in the corpus are covered. There are so many shards that each has about
   SHARD bytes, and none of its anchors more than GROUP, whatever the corpus: that bounds a task's memory.
5. The covered windows of each segment go back to its places (at later places of a segment all are covered),
   and each document loses the union.

Segments are told apart by 128 bits of hash. Null text is empty. Texts shorter than ``length`` lose nothing. A null
id comes before all others. Rows with the same id are one document: places at equal starts are the same
place, and none of them is earlier. Empty tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import tempfile
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, keep, small_batches
from .induced import BUFFER, IN_MEMORY, sort_suffixes
from .jaccard_trees import _powers, mix

LENGTH, GRAM = 100, 16
CHUNK = 1 << 19  # windows looked at together
SHARDS_A_PARTITION = 4  # at least
SHARD = 1 << 21  # bytes of segments; sorting holds about a hundred bytes for each
GROUP = 1 << 18  # bytes of the different segments of one anchor, beyond which they are split
WIDTHS = (21, 5, 1)  # offsets of the anchor that stay together when segments are split
PLACE = np.uint64((1 << 20) - 1)
SPREAD = mix(np.arange(7, 263, dtype=np.uint64))  # a large number for each byte
SPREAD_KEY = mix(np.arange(1007, 1263, dtype=np.uint64))  # another, for the anchors of split segments


def _anchors(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, gram: int, bytes_too: bool) -> tuple[np.ndarray, ...]:
    """raw: bytes of several documents, below 2**20; starts, stops: of each document.

    Returns for each segment: document, first window (from the document's start), windows, the hashes of its
    anchor and, if these are wanted, of all its bytes; and the anchor's place from the first window.
    """
    h = raw.astype(np.uint64) + np.uint64(1)
    width, power = 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
    h = mix(h)
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    span, done = length - gram + 1, 1
    while 2 * done <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    counts = np.maximum(0, stops - starts - length + 1)
    which = np.repeat(np.arange(len(starts)), counts)
    window = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    anchor = (low[window] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])]) if len(window) else np.zeros(0, np.int64)
    many = np.diff(np.r_[first, len(window)])
    begin = window[first]
    if not bytes_too:
        return which[first], begin - starts[which[first]], many, h[anchor[first]].view(np.int64), many, anchor[first] - begin
    up, down = _powers(1 << len(raw).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(up[: len(raw)] * SPREAD[raw])]
    end = begin + many + length - 1
    whole = mix((sums[end] - sums[begin]) * down[begin] + end.astype(np.uint64) - begin.astype(np.uint64)).view(np.int64)
    return which[first], begin - starts[which[first]], many, h[anchor[first]].view(np.int64), whole, anchor[first] - begin


def _only_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors of all segments, for counting."""

    def run(batches):
        for batch in small_batches(batches, 0, 1 << 20):
            for _, _, _, anchor, _ in anchors_of(batch.column(0).to_pylist(), length, gram, bytes_too=False):
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])

    return rows.select("text").mapInArrow(run, "anchor long")


def anchors_of(texts: list[bytes], length: int, gram: int, bytes_too: bool = True):
    """The same for texts of any size, in chunks."""
    room, part = CHUNK, []
    chunks: list[list[tuple[int, int, int]]] = [part]
    for k, text in enumerate(texts):
        windows = len(text) - length + 1
        for start in range(0, max(0, windows), CHUNK):
            size = min(CHUNK, windows - start) + length - 1
            if size > room and part:
                part = []
                chunks.append(part)
                room = CHUNK + length
            part.append((k, start, size))
            room -= size
    for part in filter(None, chunks):
        raw = np.frombuffer(b"".join([texts[k][start : start + size] for k, start, size in part]), np.uint8)
        sizes = np.array([size for _, _, size in part])
        stops = np.cumsum(sizes)
        which, first, many, hashes, whole, _ = _anchors(raw, stops - sizes, stops, length, gram, bytes_too)
        doc, offset = np.array([k for k, _, _ in part]), np.array([start for _, start, _ in part])
        yield doc[which], first + offset[which], many, hashes, whole


def _version(docs: DataFrame, id_col: str, text):
    """Tells texts of the same id apart; 0 where ids are unique."""
    unique = docs.groupBy(id_col).count().where("count > 1").isEmpty()
    return F.lit(0).cast("long") if unique else F.xxhash64(text)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    version = _version(docs, id_col, text)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.col(id_col).alias("id"), text.cast("binary").alias("text"), version.alias("version"))


def _segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Every segment of every document; ``lead`` marks the first of its kind in the document."""

    def run(batches):
        for batch in small_batches(batches, 2, 1 << 20):
            docs, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            each = list(anchors_of(batch.column(2).to_pylist(), length, gram))
            if not each:
                continue
            which, first, many, anchor, digest = (np.concatenate(c) for c in zip(*each, strict=True))
            yield from _told(which, docs, versions, first, many, anchor, digest)
        give_back()

    return rows.select("doc", "version", "text").mapInArrow(run, SEGMENTS)


SEGMENTS = "anchor long, digest long, doc long, version long, first int, windows int, lead boolean"


def _told(which, docs, versions, first, many, anchor, digest):
    """Batches of segments; which: the row of each in docs and versions."""
    order = np.lexsort((first, digest, anchor, which))
    w, a, d = which[order], anchor[order], digest[order]
    lead = np.ones(len(order), bool)
    lead[order[1:]] = (w[1:] != w[:-1]) | (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    columns = [anchor, digest, docs[which], versions[which], first.astype(np.int32), many.astype(np.int32), lead]
    for start in range(0, len(lead), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 50_000]) for c in columns], ["anchor", "digest", "doc", "version", "first", "windows", "lead"])


def _parts(raws: list[bytes], length: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """Of segments (below 2**20 bytes in all), their parts: segment, first window in it, windows, the hashes of the bytes
    that its windows share by their anchor and of all its bytes."""
    raw, sizes = np.frombuffer(b"".join(raws), np.uint8), np.array([len(x) for x in raws], np.int64)
    stops = np.cumsum(sizes)
    which, _, many, _, _, at = _anchors(raw, stops - sizes, stops, length, gram, bytes_too=False)
    up, down = _powers(1 << len(raw).bit_length())
    sums = [np.r_[np.uint64(0), np.cumsum(up[: len(raw)] * spread[raw])] for spread in (SPREAD_KEY, SPREAD)]
    found: list[tuple] = []
    for low in range(0, length - gram + 1, width):
        high = min(low + width, length - gram + 1)  # offsets low to high - 1; window j has offset at - j
        a, b = np.maximum(0, at - high + 1), np.minimum(many, at - low + 1)
        some = np.flatnonzero(a < b)
        start = (stops - sizes)[some]
        hashes = []
        for total, begin, end in zip(sums, (start + at[some] - low, start + a[some]), (start + at[some] + length - high + 1, start + b[some] + length - 1), strict=True):
            hashes.append(mix((total[end] - total[begin]) * down[begin] + np.uint64(low) * np.uint64(0x9E3779B97F4A7C15) + (end - begin).astype(np.uint64)).view(np.int64))
        found.append((which[some], a[some], (b - a)[some], *hashes))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _split(joined: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Of rows (doc, version, text, segments): the parts of these segments."""

    def run(batches):
        for batch in small_batches(batches, 2, 1 << 20):
            owner, firsts, raws = [], [], []
            for row, (text, segments) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for first, windows in sorted({(s["first"], s["windows"]) for s in segments}):
                    owner.append(row)
                    firsts.append(first)
                    raws.append(text[first : first + windows + length - 1])
            each = []
            for start in range(0, len(raws), 2000):
                segment, offset, many, anchor, digest = _parts(raws[start : start + 2000], length, gram, width)
                each.append((segment + start, offset, many, anchor, digest))
            segment, offset, many, anchor, digest = (np.concatenate(c) for c in zip(*each, strict=True))
            docs, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield from _told(np.array(owner)[segment], docs, versions, np.array(firsts)[segment] + offset, many, anchor, digest)
        give_back()

    return joined.select("doc", "version", "text", "segments").mapInArrow(run, SEGMENTS)


def _kinds(places: DataFrame) -> DataFrame:
    """Equal segments, combined: the first place and the number of places."""
    origin = F.when(F.col("lead"), F.col("doc"))
    return places.groupBy("anchor", "digest").agg(F.min(origin).alias("at_doc"), F.min_by("first", origin).alias("at_first"), F.min_by("version", origin).alias("at_version"), F.max("windows").alias("windows"), F.count(F.lit(1)).alias("n"))


def _grouped(rows: DataFrame, length: int, gram: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The places and kinds of repeated segments; the anchors with several kinds, none of more bytes than group."""
    found = _segments(rows, length, gram)
    repeated = keep(_only_anchors(rows, length, gram).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    places = keep(found.join(repeated, "anchor"), "repeated-segments")
    kinds = keep(_kinds(places), "kinds-of-segments")
    widths = iter(WIDTHS)
    while True:
        several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("windows").cast("long") + (length - 1)).alias("bytes")).where("kinds > 1")
        several = keep(several.select("anchor", "bytes"), "groups-of-kinds")
        # at most one for each GROUP bytes of segments: a small table, as the optimiser sees from its file
        large = keep(several.where(F.col("bytes") > group).select("anchor"), "large-groups")
        width = next(widths, None)
        if width is None or large.isEmpty():
            return places, kinds, several
        sought = places.join(large, "anchor").groupBy("doc", "version").agg(F.collect_list(F.struct("first", "windows")).alias("segments"))
        parts = keep(_split(rows.join(sought, ["doc", "version"]), length, gram, width), "split-segments")
        places = places.join(large, "anchor", "left_anti").unionByName(parts)
        kinds = keep(kinds.join(large, "anchor", "left_anti").unionByName(_kinds(parts)), "kinds-of-segments")


def _with_bytes(joined: DataFrame, length: int) -> DataFrame:
    """Of rows (doc, text, segments): every segment with its bytes."""

    def run(batches):
        for batch in small_batches(batches, 1):
            lists, texts = batch.column(2), batch.column(1).to_pylist()
            anchor, digest, first, windows = lists.flatten().flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            stop = first.to_numpy() + windows.to_numpy() + (length - 1)
            raw = [texts[k][a:b] for k, a, b in zip(owner.tolist(), first.to_pylist(), stop.tolist(), strict=True)]
            columns = [anchor, digest, batch.column(0).take(pa.array(owner)), first, windows, pa.array(raw, pa.binary())]
            for start in range(0, len(raw), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(start, 20_000) for c in columns], ["anchor", "digest", "doc", "first", "windows", "raw"])

    return joined.mapInArrow(run, "anchor long, digest long, doc long, first int, windows int, raw binary")


def _alone(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment its first window that another place of the shard may have too, and the first after the last such.

    Windows are told apart by a hash: what it leaves out has no equal, what it keeps goes to the sort."""
    up, down = _powers(1 << len(text).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(up[: len(text)] * SPREAD[text])]
    ends = np.cumsum(windows)
    which = np.repeat(np.arange(len(starts), dtype=np.int32), windows)
    at = np.arange(len(which)) + np.repeat(starts - ends + windows, windows)
    hashes = mix((sums[at + length] - sums[at]) * down[at])
    del sums, at
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(twice):
        return low, high
    place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    met = np.flatnonzero(twice[place] == hashes)
    own = which[met]
    first, last = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), np.flatnonzero(np.r_[own[1:] != own[:-1], True])
    begin = (ends - windows)[own[first]]
    low[own[first]], high[own[first]] = met[first] - begin, met[last] - begin + 1
    return low, high


class Shard:
    """The segments of one shard, on disk: symbols (byte + 1, 0 after each segment) and a table of places."""

    def __init__(self, folder: str):
        self.folder = folder
        self.text = open(f"{folder}/text", "wb")  # noqa: SIM115
        self.size, self.starts, self.windows, self.docs, self.firsts = 0, *(array("q") for _ in range(4))

    def add(self, raw: bytes, windows: int, doc: int, first: int) -> None:
        self.text.write((np.frombuffer(raw, np.uint8) + np.uint8(1)).tobytes() + b"\0")
        self.starts.append(self.size)
        self.windows.append(windows)
        self.docs.append(doc)
        self.firsts.append(first)
        self.size += len(raw) + 1

    def trimmed(self, length: int, in_memory: int) -> tuple[Shard, np.ndarray, np.ndarray]:
        """The shard without the windows at both ends of a segment that occur nowhere else in it, and without segments
        that have no others; of each segment that stays, its number here and the windows cut off before it. A shard of
        more than in_memory bytes stays as it is, for the sort alone is external."""
        self.text.close()
        if self.size > in_memory:
            return self, np.arange(len(self.starts)), np.zeros(len(self.starts), np.int64)
        folder = f"{self.folder}/trimmed"
        os.mkdir(folder)
        new = Shard(folder)
        if not self.starts:
            return new, np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.fromfile(f"{self.folder}/text", np.uint8)
        starts, windows, docs, firsts = (np.frombuffer(x, np.int64) for x in (self.starts, self.windows, self.docs, self.firsts))
        low, high = _alone(text, starts, windows, length)
        stay = np.flatnonzero(low < high)
        begin, many = (starts + low)[stay], (high - low)[stay]
        for a, n in zip(begin.tolist(), many.tolist(), strict=True):
            new.text.write(text[a : a + n + length - 1].tobytes() + b"\0")
        sizes = many + length
        new.size = int(sizes.sum())
        for name, values in (("starts", np.cumsum(sizes) - sizes), ("windows", many), ("docs", docs[stay]), ("firsts", (firsts + low)[stay])):
            getattr(new, name).frombytes(values.astype(np.int64).tobytes())
        os.unlink(f"{self.folder}/text")
        return new, stay, low[stay]

    def covered(self, length: int, in_memory: int, buffer: int) -> dict[int, list[dict]]:
        """For each segment the runs of its windows that also start earlier."""
        self.text.close()
        if not self.starts:
            return {}
        text = np.memmap(f"{self.folder}/text", np.uint8, "r")
        starts, windows, docs, firsts = (np.frombuffer(x, np.int64) for x in (self.starts, self.windows, self.docs, self.firsts))
        marked = np.memmap(f"{self.folder}/marked", bool, "w+", shape=(len(text),))
        tail = np.zeros(0, np.int64)
        for positions, common in sort_suffixes(text, self.folder, in_memory, buffer, cap=length):
            positions = positions.astype(np.int64)
            same = common >= length
            if same[0] and len(tail):
                positions, same = np.r_[tail, positions], np.r_[False, np.ones(len(tail) - 1, bool), same]
            same[0] = False
            group = np.cumsum(~same) - 1
            last = group == group[-1]
            tail = positions[last]
            some = same | np.r_[same[1:], False]
            if not some.any():
                continue
            p, g = positions[some], group[some]
            segment = np.searchsorted(starts, p, "right") - 1
            window = p - starts[segment]
            whole = window < windows[segment]
            p, g, segment, window = p[whole], g[whole], segment[whole], window[whole]
            if not len(g):
                continue
            doc, place = docs[segment], firsts[segment] + window
            order = np.lexsort((place, doc, g))
            p, g, doc, place = p[order], g[order], doc[order], place[order]
            head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            origin = np.repeat(head, np.diff(np.r_[head, len(g)]))
            marked[p[(doc != doc[origin]) | (place != place[origin])]] = True
        return _runs(marked, starts)


def _runs(marked: np.ndarray, starts: np.ndarray, block: int = 1 << 20) -> dict[int, list[dict]]:
    """The runs of marked places in each segment, counted from its start; a run never crosses the end of a segment."""
    out: dict[int, list[dict]] = {}
    open_ = None
    for at in range(0, len(marked), block):
        part = np.r_[False, marked[at : at + block], False]
        change = np.flatnonzero(part[1:] != part[:-1]) + at
        for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            if open_ is not None and open_[1] == a:
                a = open_[0]
            elif open_ is not None:
                _told_run(out, starts, *open_)
            open_ = (a, b)
    if open_ is not None:
        _told_run(out, starts, *open_)
    return out


def _told_run(out: dict[int, list[dict]], starts: np.ndarray, a: int, b: int) -> None:
    segment = int(np.searchsorted(starts, a, "right")) - 1
    out.setdefault(segment, []).append({"a": a - int(starts[segment]), "b": b - int(starts[segment])})


def _sorted_shards(segments: DataFrame, length: int, in_memory: int, buffer: int) -> DataFrame:
    """Of rows (anchor, digest, doc, first, windows, raw): the covered windows of those that have any."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            shard, names = Shard(folder), []
            for batch in small_batches(batches, 5):
                for doc, first, windows, raw in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                    shard.add(raw, windows, doc, first)
                names.append((batch.column(0), batch.column(1)))
            small, numbers, cut = shard.trimmed(length, in_memory)
            ranges = small.covered(length, in_memory, buffer)
        found = {int(numbers[k]): [{"a": r["a"] + int(cut[k]), "b": r["b"] + int(cut[k])} for r in runs] for k, runs in ranges.items()}
        give_back()
        done = 0
        for anchor, digest in names:
            some = [k for k in range(len(anchor)) if done + k in found]
            mine = pa.array([found[done + k] for k in some], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            done += len(anchor)
            if some:
                yield pa.RecordBatch.from_arrays([anchor.take(pa.array(some)), digest.take(pa.array(some)), mine], ["anchor", "digest", "covered"])

    return segments.mapInArrow(run, "anchor long, digest long, covered array<struct<a:int,b:int>>")


def _merged(removed) -> list[list[int]]:
    """The union of spans, as maximal runs in order."""
    spans: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in removed or ()):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    return spans


def _without(text: bytes, spans: list) -> bytes:
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    return b"".join(kept)


def _whole_characters(text: bytes, spans: list) -> list[tuple[int, int]]:
    """The spans without the parts of characters that they hold at their ends."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def _cut(rows: DataFrame, length: int, id_kind: str) -> DataFrame:
    """Of rows (id, text, removed): what is left."""

    def run(batches):
        for batch in small_batches(batches, 1):
            out = []
            for id_, text, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = _merged(removed)
                out.append((id_, len(text), sum(b - a for a, b in spans), len(spans), _without(text, spans)))
            each = list(zip(*out, strict=True))
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(each, kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"id {id_kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _removed(rows: DataFrame, length: int, gram: int, in_memory: int, buffer: int, group: int) -> DataFrame:
    """doc, version, removed (spans, overlapping) of the documents that lose something; rows: of _rows()."""
    if not gram <= length <= 250 or gram & (gram - 1):
        raise ValueError("the length is 250 bytes at most, and the gram a power of two not above it")
    places, kinds, several = _grouped(rows, length, gram, group)
    sought = kinds.join(several.select("anchor"), "anchor").groupBy(F.col("at_doc").alias("doc"), F.col("at_version").alias("version")).agg(F.collect_list(F.struct("anchor", "digest", F.col("at_first").alias("first"), "windows")).alias("segments"))
    bytes_of = _with_bytes(rows.join(sought, ["doc", "version"]).select("doc", "text", "segments"), length)
    size = several.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(SHARDS_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    covered = keep(_sorted_shards(bytes_of.repartition(shards, "anchor"), length, in_memory, buffer), "covered-windows")
    told = kinds.join(covered, ["anchor", "digest"], "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<struct<a:int,b:int>>"))).where("n > 1 OR size(covered) > 0")
    told = keep(told.drop("windows"), "segments-told")

    # a segment of more than 1/1000 of all places is broadcast (there are fewer than 1000), others are joined by shuffle
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1000, total // 1000)
    hot = told.where(F.col("n") > least)
    rest = told.where(F.col("n") <= least)
    slim = places.select("anchor", "digest", "doc", "version", "first", "windows")
    met = slim.join(F.broadcast(hot), ["anchor", "digest"]).unionByName(slim.join(F.broadcast(hot.select("anchor", "digest")), ["anchor", "digest"], "left_anti").join(rest, ["anchor", "digest"]))
    is_first = (F.col("doc") == F.col("at_doc")) & (F.col("first") <= F.col("at_first"))
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    windows = F.when(is_first, F.col("covered")).otherwise(all_of_it)
    spans = F.transform(windows, lambda w: F.struct((F.col("first") + w["a"]).alias("start"), (F.col("first") + w["b"] + (length - 1)).alias("stop")))
    return met.select("doc", "version", F.explode(spans).alias("span")).groupBy("doc", "version").agg(F.collect_list("span").alias("removed"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", in_memory: int = IN_MEMORY, buffer: int = BUFFER, group: int = GROUP) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes that are left) of every row."""
    rows = _rows(docs, id_col, text_col)
    gone = _removed(rows, length, gram, in_memory, buffer, group)
    out = _cut(rows.join(gone, ["doc", "version"], "left").select("id", "text", "removed"), length, docs.schema[id_col].dataType.simpleString())
    return out.withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with all their columns, the text without repeated strings; for a pipeline stage.

    Of a character that a repeated string holds in part nothing goes. Documents keep their rows even if
    nothing is left; null texts stay null. chars_col, where there, counts the new text's characters.
    """
    gone = _removed(_rows(docs, id_col, text_col), length, gram, IN_MEMORY, BUFFER, GROUP)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), _version(docs, id_col, text).alias("version"))
    both = keyed.join(gone, ["doc", "version"], "left").select(F.col(f"row.`{text_col}`").cast("binary").alias("text"), "removed", "row")
    kind = both.schema["row"].dataType

    def run(batches):
        for batch in small_batches(batches, 0):
            new = []
            for text, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.append(text if not removed else _without(text, _whole_characters(text, _merged(removed))))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()).cast(pa.string()), batch.column(2)], ["new", "row"])

    cut = both.mapInArrow(run, T.StructType([T.StructField("new", T.StringType()), T.StructField("row", kind)]))
    changed = {text_col: F.col("new"), chars_col: F.coalesce(F.char_length("new"), F.col(f"row.`{chars_col}`")).cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame, **options) -> DataFrame:
    """suffix_dedup() with the SHA-256 of the kept bytes instead of these."""
    out = suffix_dedup(docs, **options)
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
