"""External induced sorting: suffix order and common prefixes of a text on disk.

The text is a file of symbols (0 separates records). Suffixes are of type S or L as they are smaller or
larger than the one after; an S* suffix is an S after an L. One induction takes the S* suffixes in some order
and yields all L and then all S suffixes through priority queues keyed by (first symbol, rank of the
suffix after): first with S* in text order, which sorts the S* substrings; these get names, the string of
names is sorted by recursion (in memory once it is small enough), and a second induction from the then
sorted S* suffixes gives the order of all suffixes. Queue entries carry positions and, in the second
induction, the length of the common prefix with the entry before, which the range minimum of the source
ranks gives. Queues and results are runs on disk beyond a bound of memory.

Everything is done in bulk: all entries of one symbol are taken from the queue together, and those that
their own symbol induces follow in rounds.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 250  # longest common prefix that is told, unless less is asked for
IN_MEMORY = 1 << 22  # strings of names up to this length are sorted by doubling
BUFFER = 1 << 22  # entries that a queue holds before they go to disk


def _stable(symbols: np.ndarray) -> np.ndarray:
    """A stable argsort; of small symbols by radix."""
    small = len(symbols) and symbols.max() < 1 << 16
    return np.argsort(symbols.astype(np.uint16) if small else symbols, kind="stable")


class BulkQueue:
    """A priority queue of (symbol, insertion order) with columns, drained one symbol at a time.

    What is inserted for a symbol comes in order of rank, so its order of insertion is its order. Beyond
    ``buffer`` entries all are written to disk as a run sorted by symbol; a symbol's entries are one slice of each
    run, then what is in memory.
    """

    def __init__(self, folder: str, columns: list[np.dtype], buffer: int):
        self.folder, self.columns, self.buffer = folder, columns, buffer
        self.near: dict[int, list[tuple]] = {}
        self.held = 0
        self.runs: list[tuple] = []

    def insert(self, symbols: np.ndarray, *columns: np.ndarray) -> None:
        if not len(symbols):
            return
        order = _stable(symbols)
        symbols, columns = symbols[order], [c[order] for c in columns]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for symbol, a, b in zip(symbols[first].tolist(), first.tolist(), np.r_[first[1:], len(symbols)].tolist(), strict=True):
            self.near.setdefault(symbol, []).append(tuple(c[a:b] for c in columns))
        self.held += len(symbols)
        if self.held >= self.buffer:
            self._spill()

    def _spill(self) -> None:
        symbols = np.array(sorted(self.near), np.int64)
        sizes = [sum(len(part[0]) for part in self.near[x]) for x in symbols.tolist()]
        stored = [self._written([np.r_[0, np.cumsum(sizes)]], np.dtype(np.int64)), self._written([symbols], np.dtype(np.int64))]
        for k, kind in enumerate(self.columns):
            stored.append(self._written((part[k] for x in symbols.tolist() for part in self.near[x]), kind))
        self.runs.append(tuple(stored))
        self.near, self.held = {}, 0

    def _written(self, parts, kind: np.dtype) -> np.ndarray:
        handle, path = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "wb") as out:
            for part in parts:
                out.write(part.astype(kind, copy=False).tobytes())
        return np.memmap(path, kind, "r")

    def stored(self, symbol: int):
        """The symbol's pieces on disk, in order."""
        for bounds, symbols, *columns in self.runs:
            k = int(np.searchsorted(symbols, symbol))
            if k < len(symbols) and symbols[k] == symbol:
                start, stop = int(bounds[k]), int(bounds[k + 1])
                for at in range(start, stop, self.buffer):
                    yield tuple(c[at : min(stop, at + self.buffer)] for c in columns)

    def take(self, symbol: int):
        """All entries of the symbol, in pieces of ``buffer`` at most; none may come for it afterwards."""
        near = self.near.pop(symbol, [])
        self.held -= sum(len(part[0]) for part in near)
        for piece in self.stored(symbol):
            yield tuple(np.asarray(c) for c in piece)
        yield from _joined(near, self.buffer)


def _joined(parts: list[tuple], buffer: int) -> list[tuple]:
    """The same entries in larger pieces, of about ``buffer``."""
    out, held, size = [], [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= buffer:
            out.append(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
            held, size = [], 0
    return [*out, tuple(np.concatenate(c) for c in zip(*held, strict=True))] if held else out


class Sorted:
    """Suffixes by symbol as they are found, with common prefixes of neighbours; on disk beyond ``buffer`` entries in all."""

    def __init__(self, folder: str, buffer: int, kind: np.dtype):
        self.queue = BulkQueue(folder, [kind, np.dtype(np.uint8)], buffer)

    def add(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        if len(positions):
            self.queue.near.setdefault(symbol, []).append((positions, common))
            self.queue.held += len(positions)
            if self.queue.held >= self.queue.buffer:
                self.queue._spill()

    def get(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The symbol's pieces in order: what is on disk stays there."""
        return [*self.queue.stored(symbol), *_joined(self.queue.near.get(symbol, []), self.queue.buffer)]


def _on_disk(folder: str, size: int, kind) -> np.ndarray:
    """An array in a file of its own."""
    handle, path = tempfile.mkstemp(dir=folder)
    os.close(handle)
    return np.memmap(path, kind, "w+", shape=(size,)) if size else np.zeros(0, kind)


def star_suffixes(text: np.ndarray, folder: str, block: int = 1 << 16) -> np.ndarray:
    """Positions of S* suffixes in text order, on disk; the text is read from the end in blocks."""
    kind = np.dtype(np.int32 if len(text) < 1 << 31 else np.int64)
    handle, path = tempfile.mkstemp(dir=folder)
    after_symbol, after_small, n = -1, False, len(text)  # the empty suffix is smaller than all: the last one is L
    total = 0
    with os.fdopen(handle, "wb") as out:
        for start in range((max(0, n - 1) // block) * block, -1, -block):
            part = text[start : start + block].astype(np.int64)
            if not len(part):
                break
            nxt = np.r_[part[1:], after_symbol]
            flag = part != nxt
            differ = np.flatnonzero(flag)
            small = np.zeros(len(part), bool)
            which = np.cumsum(flag) - flag  # the end of the run of equal symbols
            inside = which < len(differ)
            ends = differ[which[inside]]
            small[inside] = part[ends] < nxt[ends]
            small[~inside] = after_small
            found = start + np.flatnonzero(small[1:] & ~small[:-1]) + 1
            if start + len(part) < n and after_small and not small[-1]:
                found = np.r_[found, start + len(part)]
            out.write(found[::-1].astype(kind).tobytes())
            total += len(found)
            after_symbol, after_small = int(part[0]), bool(small[0])
    return np.memmap(path, kind, "r")[::-1] if total else np.zeros(0, kind)


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) for each pair, low < high, by a table of minima over powers of two."""
    if not len(low):
        return np.zeros(0, values.dtype)
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    level, table = 0, values
    top = int(power.max())
    while True:
        mine = np.flatnonzero(power == level)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << level)])
        if level == top:
            return out
        half = 1 << level
        table = np.minimum(table[:-half], table[half:])
        level += 1


class _Since:
    """For each target symbol, the least common prefix since the last entry that went to it."""

    def __init__(self):
        self.last: dict[int, int] = {}
        self.all = CAP  # what everything has passed since; folded into last when read

    def entries(self, common: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """common: of a stretch of scanned suffixes, each with the one before. sources: which of them
        induce, ascending. Returns the common prefix of each induced entry with the one before it in its
        symbol (0 for the first)."""
        order = _stable(targets)
        t, s = targets[order], sources[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        low = np.r_[0, s[:-1] + 1] if len(s) else s
        low[first] = 0
        least = _range_minima(common, low, s + 1).astype(np.int64) if len(s) else np.zeros(0, np.int64)
        out = np.minimum(least + 1, CAP)
        ends = np.r_[first[1:], len(t)] - 1 if len(t) else first
        final = int(common.min()) if len(common) else CAP
        for f, symbol in zip(first.tolist(), t[first].tolist(), strict=True):
            known = self.last.get(symbol)
            out[f] = 0 if known is None else min(known, int(least[f])) + 1
        for symbol in self.last:
            self.last[symbol] = min(self.last[symbol], final)
        tails = s[ends] + 1 if len(t) else ends
        rest = np.full(len(tails), CAP, np.int64)
        some = np.flatnonzero(tails < len(common))
        rest[some] = _range_minima(common, tails[some], np.full(len(some), len(common)))
        self.last.update(zip(t[first].tolist(), rest.tolist(), strict=True))
        back = np.empty(len(out), np.uint8)
        back[order] = np.minimum(out, CAP)
        return back


def _common(text: np.ndarray, a: int, b: int) -> int:
    x, y = text[a : a + CAP], text[b : b + CAP]
    m = min(len(x), len(y))
    differ = np.flatnonzero(x[:m] != y[:m])
    return int(differ[0]) if len(differ) else m


def _symbols(text: np.ndarray, block: int = 1 << 16) -> list[int]:
    found = np.zeros(0, np.int64)
    for start in range(0, len(text), block):
        found = np.union1d(found, text[start : start + block])
    return found.astype(np.int64).tolist()


def induce(text: np.ndarray, stars: np.ndarray, star_common: np.ndarray | None, folder: str, buffer: int) -> tuple[list[int], Sorted, Sorted]:
    """All suffixes by symbol: those of type L, and those of type S (descending, as they are found)."""
    n, kind = len(text), np.dtype(np.int32 if len(text) < 1 << 31 else np.int64)
    track = star_common is not None
    columns = [kind, np.dtype(np.uint8)]
    begun = BulkQueue(folder, columns, buffer)  # the S* suffixes by their first symbol
    for start in range(0, len(stars), buffer):
        part = np.asarray(stars[start : start + buffer])
        begun.insert(np.asarray(text[part]).astype(np.int64), part.astype(kind), np.asarray(star_common[start : start + buffer]) if track else np.zeros(len(part), np.uint8))
    symbols = _symbols(text)
    large, small = Sorted(folder, buffer, kind), Sorted(folder, buffer, kind)

    def scan(queue: BulkQueue, since: _Since, found: np.ndarray, common: np.ndarray, wanted, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Puts what these suffixes induce into the queue; returns what belongs to the symbol ``own``."""
        some = np.flatnonzero(found > 0)
        before = found[some].astype(np.int64) - 1
        t = np.asarray(text[before]).astype(np.int64)
        good = wanted(t)
        some, before, t = some[good], before[good], t[good]
        carried = since.entries(common, some, t) if track else np.zeros(len(some), np.uint8)
        mine = t == own if own is not None else np.zeros(len(t), bool)
        queue.insert(t[~mine], before[~mine].astype(kind), carried[~mine])
        return before[mine].astype(kind), carried[mine]

    def through(out: Sorted, queue: BulkQueue, since: _Since, symbol: int, wanted) -> int | None:
        """Takes the queue's entries of the symbol, then in rounds what they induce for it; returns the last one."""
        pieces, last = queue.take(symbol), None
        while True:
            following = []
            for found, common in pieces:
                out.add(symbol, found, common)
                last = int(found[-1])
                own = scan(queue, since, found, common, wanted, symbol)
                if len(own[0]):
                    following.append(own)
            if not following:
                return last
            pieces = following

    def joint(last: int | None, first: int) -> int:
        return _common(text, last, first) if track and last is not None else 0

    queue, since = BulkQueue(folder, columns, buffer), _Since()
    if n:
        queue.insert(np.array([int(text[n - 1])]), np.array([n - 1], kind), np.zeros(1, np.uint8))
        since.last[int(text[n - 1])] = 0
    for symbol in symbols:
        last = through(large, queue, since, symbol, lambda t, symbol=symbol: t >= symbol)
        for at, (mine, common) in enumerate(begun.take(symbol)):
            if at == 0:
                common = common.copy()
                common[0] = joint(last, int(mine[0]))
            # the suffix before an S* suffix is larger: it never belongs to this symbol
            scan(queue, since, mine, common, lambda t, symbol=symbol: t >= symbol, None)
    queue, since = BulkQueue(folder, columns, buffer), _Since()
    for symbol in reversed(symbols):
        last = through(small, queue, since, symbol, lambda t, symbol=symbol: t <= symbol)
        for up, up_common in reversed(large.get(symbol)):
            found = np.asarray(up)[::-1]
            common = np.r_[np.uint8(joint(last, int(found[0]))), np.asarray(up_common)[:0:-1]]  # of each with the larger one before it
            last = int(found[-1])
            scan(queue, since, found, common, lambda t, symbol=symbol: t < symbol, None)
    return symbols, large, small


def _by_doubling(names: np.ndarray, cap: int) -> np.ndarray:
    """Places of suffixes in order, in memory; the end is smaller than every name.

    Names stand for two symbols or more, so the order holds for cap symbols once that many names are looked at.
    """
    n = len(names)
    _, rank = np.unique(names, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + second
        order = np.argsort(key)  # equal keys may come in any order
        sorted_key = key[order]
        fresh = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        if n == 0 or fresh[-1] == n or step > cap:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2


def _in_order(symbols: list[int], large: Sorted, small: Sorted):
    """(whether of type S, positions, common prefixes) of all suffixes, ascending, in pieces. The first common prefix of a
    piece is not told."""
    for symbol in symbols:
        for positions, common in large.get(symbol):
            yield False, np.asarray(positions), np.array(common, np.uint8)
        for positions, common in reversed(small.get(symbol)):
            yield True, np.asarray(positions)[::-1], np.r_[np.uint8(0), np.asarray(common)[:0:-1]]


def sort_suffixes(text: np.ndarray, folder: str, in_memory: int = IN_MEMORY, buffer: int = BUFFER, cap: int = CAP, track: bool = True):
    """Yields (positions, common) in suffix order; common is the prefix shared with the suffix before (0 without ``track``).

    Order and common prefixes are right for the first cap symbols (CAP at most); suffixes that share more may
    stand in any order, and common may fall short of what they share beyond. In memory are about ``buffer`` entries of each
    queue and ``in_memory`` names; everything else is on disk in ``folder``.
    """
    stars = _sorted_stars(text, folder, in_memory, buffer, cap)
    common = _neighbours(text, stars, cap, folder) if track else None
    last = None
    for _, positions, shared in _in_order(*induce(text, stars, common, folder, buffer)):
        shared[0] = _common(text, last, int(positions[0])) if track and last is not None else 0
        last = int(positions[-1])
        yield positions, shared


def _neighbours(text: np.ndarray, order: np.ndarray, cap: int, folder: str) -> np.ndarray:
    """Common prefixes, up to cap or a little more, of suffixes that follow each other in order.

    Eight symbols are compared at a time, as one little-endian number.
    """
    out = _on_disk(folder, len(order), np.uint8)
    if len(order) < 2 or text.dtype != np.uint8:
        return out
    n = len(text)
    padded = _on_disk(folder, n + CAP + 16, np.uint8)
    for start in range(0, n, 1 << 20):
        padded[start : min(n, start + (1 << 20))] = text[start : start + (1 << 20)]
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    for start in range(1, len(order), 1 << 16):
        a, b = order[start - 1 : start - 1 + (1 << 16)].astype(np.int64), order[start : start + (1 << 16)].astype(np.int64)
        a = a[: len(b)]
        length, open_ = np.zeros(len(b), np.int64), np.arange(len(b))
        for step in range(0, cap, 8):
            differ = eight[a[open_] + step] ^ eight[b[open_] + step]
            whole = differ == 0
            # the lowest set bit tells the first symbol that differs
            lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
            length[open_] += np.where(whole, 8, lowest)
            open_ = open_[whole]
            if not len(open_):
                break
        out[start : start + len(b)] = np.minimum(np.minimum(length, n - np.maximum(a, b)), CAP)
    return out


def _equal_to_before(text: np.ndarray, before: np.ndarray, here: np.ndarray, lengths_before: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each substring at here equals the one at before."""
    same = lengths == lengths_before
    todo = np.flatnonzero(same)
    for step in range(int(lengths[same].max(initial=0))):
        todo = todo[step < lengths[todo]]
        if not len(todo):
            break
        differ = text[here[todo] + step] != text[before[todo] + step]
        same[todo[differ]] = False
        todo = todo[~differ]
    return same


def _sorted_stars(text: np.ndarray, folder: str, in_memory: int, buffer: int, cap: int) -> np.ndarray:
    """The S* suffixes in order, on disk."""
    stars = star_suffixes(text, folder)
    if len(stars) < 2:
        return stars
    # sort the S* substrings: an induction from S* in text order leaves the S suffixes sorted up to the next S*
    is_star = _on_disk(folder, len(text), bool)
    for start in range(0, len(stars), buffer):
        is_star[stars[start : start + buffer]] = True
    order, filled = _on_disk(folder, len(stars), stars.dtype), 0
    for small, positions, _ in _in_order(*induce(text, stars, None, folder, buffer)):
        if small:
            mine = positions[is_star[positions]]
            order[filled : filled + len(mine)] = mine
            filled += len(mine)
    # names: equal substrings (to the next S* or the end) get equal names
    names, name, block = _on_disk(folder, len(stars), np.int64), -1, min(buffer, 1 << 18)
    last = len(stars) - 1
    for start in range(0, len(stars), block):
        here = np.asarray(order[max(0, start - 1) : start + block]).astype(np.int64)
        place = np.searchsorted(stars, here)
        lengths = np.where(place == last, len(text), stars[np.minimum(place + 1, last)].astype(np.int64) + 1) - here
        same = _equal_to_before(text, here[:-1], here[1:], lengths[:-1], lengths[1:])
        # the last S* substring runs into the end, which is smaller than everything: it equals no other
        same &= (place[1:] != last) & (place[:-1] != last)
        fresh = ~same if start else np.r_[True, ~same]
        own = place[1:] if start else place
        names[own] = name + np.cumsum(fresh)
        name += int(fresh.sum())
    if name + 1 == len(names):
        return order
    if len(names) <= in_memory:
        return stars[_by_doubling(np.asarray(names), cap)]
    filled = 0
    for ranks, _ in sort_suffixes(names, folder, in_memory, buffer, cap, track=False):
        order[filled : filled + len(ranks)] = stars[ranks]
        filled += len(ranks)
    return order
