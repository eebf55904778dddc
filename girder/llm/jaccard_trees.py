"""Exact n-gram Jaccard join with signature trees.

A document is the set of hashes of its word shingles. Equal sets are one set from the start (its class).

Which sets can be alike at all is found without comparing them. Sets of sizes a <= b with Jaccard
similarity of t or more differ in at most D = (1-t)/(1+t) (a+b) members. If the space of hashes is cut
into more than D ranges, the two agree completely in one at least. So every class emits, for each range, a
hash of what it has there; only sets that meet in such a key can be linked. Ranges are a few more than
D + 1, so that ranges with few members, in which unlike sets agree by chance, may be left out: a set
that has more of these than the surplus emits them all. Nothing is lost, whatever the data.

Signature trees join sets that may meet: a node holds the OR of its sets' token bitmaps, their range of sizes, and the
most tokens that a set has beyond its bits; a traversal of two trees leaves out pairs of nodes whose largest possible
overlap is too small. Pairs of sets that survive are compared exactly. There are two rounds:

1. Every set goes to the smallest set that it shares a key with (its hub), in chunks of the hub's sets; trees join each
   chunk with itself and with the hub. That is linear in the number of sets, and connects large groups of near copies.
2. A key whose sets are all connected by now has no more to tell. Sets in other keys form groups (what is connected
   counts as one node). Trees over signatures alone, 512 bytes a set at most, join the sets of a group but for pairs that
   are connected already; what they cannot rule out forms smaller groups, whose sets are then joined exactly. In a large
   group sets only meet by key: keys are dealt to buckets, and a set goes to those of its own keys, so a group of any size
   costs what its sets have of keys. Only the sets of one key, where they are many, are cut into blocks by size and hash,
   and pairs of blocks are separate tasks.

jaccard_components() gives the components, jaccard_links() every link between different sets.

Words are runs of other bytes than space and \\t to \\r, A-Z lower-cased. A document with fewer words than a
shingle is one shingle of them all; with none it has the empty set and no links. Null text is empty. Rows
that repeat an id are documents each; so are rows without an id, which name no component while there is another id
in it. Shingles are 64-bit hashes, sets are told apart by 128 bits, and links name them by 64 of these. Empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, keep, small_batches
from .graph import components

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK_SETS, CHUNK_BYTES = 256, 4 << 20  # of a hub's sets that are joined in one task
BLOCK_SETS, BLOCK_BYTES = 512, 8 << 20  # of a group's sets
LEAF, FAN, BIT_WORDS = 8, 8, 64
FEW_TASKS = 200_000  # entries of dealt sets that are broadcast to the texts, about 20 MB


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    line = b" ".join(texts) + b" "
    raw = np.frombuffer(line, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, stops = edge[::2], edge[1::2]
    up, down = _powers(1 << (len(raw)).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(up[: len(raw)] * (LOWER[raw].astype(np.uint64) + np.uint64(1)))]
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    first = np.r_[0, last[:-1]]
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled = rolled * np.uint64(BASE) + words[j : len(words) - width + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled + np.uint64(width))
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        else:
            few = functools.reduce(lambda acc, w: (acc * BASE + int(w)) % (1 << 64), words[a:b], 0)
            out.append(mix(np.array([few + b - a], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


class Measure:
    """The threshold num/den and what follows from it."""

    def __init__(self, width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def needed(self, total):
        """The least overlap of linked sets with this many members together."""
        return -(-self.num * total // (self.num + self.den))

    @functools.cached_property
    def bands(self) -> np.ndarray:
        """Lower ends of the bands of sizes; a set's partners that are larger are in its band or the next."""
        ends = [1]
        while ends[-1] < 1 << 40:
            ends.append(ends[-1] * self.den // self.num + 1)
        return np.array(ends)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.bands, size, "right")) - 1

    @functools.lru_cache(4096)  # noqa: B019
    def ranges(self, band: int) -> tuple[int, int, int]:
        """For pairs whose smaller set is in this band: ranges, members that a full range needs, surplus."""
        low, high = int(self.bands[band]), int(self.bands[band + 1]) - 1
        total = high + high * self.den // self.num
        differ = total - 2 * self.needed(total)
        for other in range(max(1, high - 1), high + 1):  # rounding may let a slightly smaller pair differ more
            for partner in range(max(1, other * self.den // self.num - 2), other * self.den // self.num + 1):
                differ = max(differ, other + partner - 2 * self.needed(other + partner))
        for least in (4, 3, 2, 1):
            count = differ + 1
            for _ in range(60):
                mean = low / count
                weak = count * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least))
                more = differ + 1 + math.ceil(weak + 3 * math.sqrt(weak))
                if more <= count or more > 1.4 * (differ + 1) + 2:
                    break
                count = more
            if more <= 1.4 * (differ + 1) + 2:
                return count, least, count - differ - 1
        return differ + 1, 0, 0

    def differ(self, total: int) -> int:
        """The most members in which linked sets with this many members together differ; it grows with the total."""
        return total * (self.den - self.num) // (self.num + self.den)

    def keys(self, members: np.ndarray) -> np.ndarray:
        """The keys of a set, by sorted hashes of its members."""
        return self.keyed(members)[0]

    def keyed(self, members: np.ndarray) -> tuple[np.ndarray, int]:
        """The keys of a set, and how many of them it shares at least with every set that it is linked with.

        Of two linked sets each range in which they differ costs a member, so all others agree. A range that agrees has
        a key in both if it is full in one; where all ranges are told, the other set may leave out its surplus.
        """
        if not len(members):
            return np.zeros(0, np.int64), 0
        own, out, sure = self.band(len(members)), [], {}
        spread, salted = members >> np.uint64(32), mix(members ^ np.uint64(0xD6E8FEB86659FD93))
        for band in {own, max(0, own - 1)}:
            count, least, surplus = self.ranges(band)
            where = (spread * np.uint64(count)) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            sizes = np.diff(np.r_[first, len(where)])
            place, inside = where[first], np.add.reduceat(salted, first)
            full = sizes >= least
            if count - int(full.sum()) > surplus:
                every = np.zeros(count, np.uint64)
                every[place.astype(np.int64)] = inside
                place, inside = np.arange(count, dtype=np.uint64), every
                sure[band] = count - surplus
            else:
                place, inside = place[full], inside[full]
                sure[band] = len(place)
            out.append(mix(inside + mix(place + np.uint64(band) * np.uint64(1 << 40) + np.uint64(1))))
        return np.concatenate(out).view(np.int64), self._least(len(members), own, sure)

    def _least(self, n: int, own: int, sure: dict[int, int]) -> int:
        """sure: for each band in which a set of this band and size has keys, how many of them are compared for certain."""
        most = n * self.den // self.num
        same = self.differ(n + min(most, int(self.bands[own + 1]) - 1))
        least = [sure[own] - self.differ(n + most), sum(max(0, k - same) for k in sure.values())]
        if own:
            least.append(sure[own - 1] - self.differ(n + int(self.bands[own]) - 1))
        return max(1, min(least))


def _digest(members: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (of the text, to find the row again) and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def _sets(source: DataFrame, measure: Measure, parts: int) -> DataFrame:
    """id, mark, n, least, low, high, and the keys, those of each part of the key space in a column of their own."""
    columns = [f"keys_{part}" for part in range(parts)]

    def run(batches):
        give_back()
        for batch in small_batches(batches, 2, 1 << 20):
            sets = shingle_sets([x or b"" for x in batch.column(2).to_pylist()], measure.width)
            digest = [_digest(s) for s in sets]
            keys, least = zip(*(measure.keyed(s) for s in sets), strict=True)
            dealt = [pa.array([k if parts == 1 else k[k % parts == part] for k in keys], pa.list_(pa.int64())) for part in range(parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.int64()), pa.array([a for a, _ in digest], pa.int64()), pa.array([b for _, b in digest], pa.int64()), *dealt],
                ["id", "mark", "n", "least", "low", "high", *columns],
            )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, mark long, n long, least long, low long, high long, {', '.join(f'{c} array<long>' for c in columns)}")


def _met(source: DataFrame, measure: Measure, parts: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents, without keys; low, key, a for every class and key that another class has too, a being
    the smallest of them. Texts are cut into shingles once; a round holds the exploded keys of one part only."""
    sets = keep(_sets(source, measure, parts), "shingle-sets")
    slim = keep(sets.select("id", "mark", "n", "least", "low", "high"), "sets")
    found = []
    for part in range(parts):
        one = keep(sets.where("n > 0").groupBy("low", "high").agg(F.first(f"keys_{part}").alias("keys")), "keys-of-classes")
        keyed = one.select("low", F.explode("keys").alias("key"))
        shared = keep(keyed.groupBy("key").agg(F.min("low").alias("a"), F.max("low").alias("z")).where("a <> z").select("key", "a"), "shared-keys")
        found.append(keep(keyed.join(shared, "key").select("low", "key", "a"), "meetings"))
        discard(one, shared)
    discard(sets)
    met = functools.reduce(DataFrame.unionAll, found)
    met._kept = [path for each in found for path in each._kept]
    return slim, met


def _of_several(left: DataFrame) -> DataFrame:
    """low, known, key, a, often: the rows whose key sets of several known have, a being the smallest of these, often how
    many rows the key has."""
    keys = left.groupBy("key").agg(F.min("known").alias("a"), F.max("known").alias("z"), F.count(F.lit(1)).alias("often"))
    return keep(left.join(keys.where("a <> z").select("key", "a", "often"), "key").select("low", "known", "key", "a", "often"), "meetings-of-several")


def _enough(met: DataFrame, classes: DataFrame) -> DataFrame:
    """low, known, key, a, often: met (low, known, key, kept) without the sets that share fewer keys with sets of another
    known than any link with one takes, and then without the keys that are left to one known.

    Both sets of a link stay, with all keys that they share. Goes on as long as a tenth of the rows goes.
    """
    before, rows = met.count(), 0
    while True:
        shared = met.groupBy("low").agg(F.count(F.lit(1)).alias("shared"))
        enough = shared.join(classes.select("low", "least"), "low").where("shared >= least").select("low").distinct()
        left = keep(met.join(enough, "low").select("low", "known", "key"), "sets-that-share-enough")
        discard(met)
        met = _of_several(left)
        discard(left)
        rows = met.count()
        if 10 * rows >= 9 * before:
            return met
        before = rows


def _rarest(met: DataFrame, classes: DataFrame) -> DataFrame:
    """What _enough() returns, without the keys of each set that most sets have: as many as may go such that the sets of a
    link, which share ``least`` keys, still share one. All sets have their keys in the same order, so if each leaves out
    its last ``least - 1``, the first key that two share stays in both."""
    own = Window.partitionBy("low")
    ranked = met.join(classes.select("low", "least"), "low").select("low", "known", "key", "least", F.row_number().over(own.orderBy("often", "key")).alias("place"), F.count(F.lit(1)).over(own).alias("shared"))
    left = keep(ranked.where("place <= shared - least + 1").select("low", "known", "key"), "rarest-keys")
    discard(met)
    out = _of_several(left)
    discard(left)
    return out


def signature(members: np.ndarray) -> bytes:
    """The token bitmap of a set: the places of its bits if these are shorter, else all bits."""
    places = np.unique((members >> np.uint64(6)) % np.uint64(BIT_WORDS) << np.uint64(6) | members & np.uint64(63)).astype("<u2")
    if 2 * len(places) < 8 * BIT_WORDS:
        return places.tobytes()
    return _bits([places.tobytes()])[0].tobytes()


def _bits(signatures: list[bytes]) -> np.ndarray:
    """The bitmaps of signatures, one row each."""
    out = np.zeros((len(signatures), BIT_WORDS), np.uint64)
    for k, raw in enumerate(signatures):
        if len(raw) == 8 * BIT_WORDS:
            out[k] = np.frombuffer(raw, "<u8")
        else:
            places = np.frombuffer(raw, "<u2").astype(np.uint64)
            np.bitwise_or.at(out[k], (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    return out


class Tree:
    """Sets in order of their smallest hash, as bitmaps and sizes; levels of nodes from sets up to one root level."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        beyond = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, beyond)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, low, high, beyond = self.levels[-1]
            at = np.arange(0, len(bits), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(beyond, at)))
            fan = FAN

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def join_trees(left: Tree, right: Tree, measure: Measure, met, connected, same: bool) -> None:
    """Calls met(i, j) for sets of the two trees that may be linked by their bitmaps and sizes, leaving out pairs that
    connected(i, j) tells of: of two numbers or of two arrays of them."""
    depth = max(len(left.levels), len(right.levels)) - 1
    pairs = (np.zeros(1, np.int64), np.zeros(1, np.int64))
    for level in range(depth, -1, -1):
        a, b = min(level, len(left.levels) - 1), min(level, len(right.levels) - 1)
        (bits1, low1, high1, more1), (bits2, low2, high2, more2) = left.levels[a], right.levels[b]
        i, j = pairs
        kept = []
        for start in range(0, len(i), 1 << 15):
            x, y = i[start : start + (1 << 15)], j[start : start + (1 << 15)]
            size = (measure.den * high1[x] >= measure.num * low2[y]) & (measure.den * high2[y] >= measure.num * low1[x])
            x, y = x[size], y[size]
            common = np.bitwise_count(bits1[x] & bits2[y]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(more1[x], more2[y]) + common, np.minimum(high1[x], high2[y]))
            good = most >= measure.needed(low1[x] + low2[y])
            kept.append((x[good], y[good]))
        i, j = (np.concatenate([k[c] for k in kept]) if kept else np.zeros(0, np.int64) for c in (0, 1))
        if level == 0:
            for start in range(0, len(i), 1 << 12):
                open_ = connected(i[start : start + (1 << 12)], j[start : start + (1 << 12)])
                for x, y in zip(i[start : start + (1 << 12)][~open_].tolist(), j[start : start + (1 << 12)][~open_].tolist(), strict=True):
                    if not connected(x, y):
                        met(x, y)
            return
        down1 = left.fan(a) if a == level else 1
        down2 = right.fan(b) if b == level else 1
        n1, n2 = len(left.levels[a - 1][0] if a == level else left.levels[a][0]), len(right.levels[b - 1][0] if b == level else right.levels[b][0])
        x = (i[:, None] * down1 + np.arange(down1))[:, :, None].repeat(down2, 2).ravel()
        y = (j[:, None] * down2 + np.arange(down2))[:, None, :].repeat(down1, 1).ravel()
        fine = (x < n1) & (y < n2)
        if same:
            fine &= (x <= y) if level > 1 else (x < y)
        pairs = (x[fine], y[fine])


def _joined(rows: dict[str, list], measure: Measure, pairs: list[tuple[int, int]], every: bool, exact: bool) -> list[tuple[int, int]]:
    """Links (as pairs of low) between sets of the given pairs of sides; without ``every`` only such as connect what is not
    connected yet. rows: low, side, n, known, content. Sets with equal known are connected from the start. Without ``exact``
    contents are signatures, and what passes for a link is what the trees cannot rule out."""
    if not rows["low"]:
        return []
    names, side, content = rows["low"], rows["side"], rows["content"]
    _, first, known = np.unique(np.array(rows["known"], np.int64), return_index=True, return_inverse=True)
    # a set that may be linked with one of those that are connected may be linked with another of them only
    parent = first[known].astype(np.int64) if exact else np.arange(len(names))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    sets = [np.frombuffer(m, np.uint64) for m in content] if exact else []
    bits, sizes = _bits([signature(m) for m in sets] if exact else content), np.array(rows["n"], np.int64)
    least = [int(m[0]) if len(m) else 0 for m in sets] if exact else [int(b.argmax()) for b in bits != 0]
    order = sorted(range(len(names)), key=lambda k: (least[k], rows["n"][k], names[k]))
    sides: dict[int, list[int]] = {}
    for k in order:
        sides.setdefault(side[k], []).append(k)
    trees = {k: Tree(bits[own], sizes[own]) for k, own in sides.items()}
    found: list[tuple[int, int]] = []
    for one, two in pairs:
        if one not in sides or two not in sides:
            continue
        a, b = np.array(sides[one]), np.array(sides[two])

        def met(x: int, y: int, a=a, b=b) -> None:
            i, j = int(a[x]), int(b[y])
            if exact:
                overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if not measure.linked(overlap, len(sets[i]), len(sets[j])):
                    return
            found.append((names[i], names[j]))
            parent[find(i)] = find(j)

        def connected(x, y, a=a, b=b):
            same = known[a[x]] == known[b[y]]
            if isinstance(x, int):
                return same or not every and find(a[x]) == find(b[y])
            return same if every else same | (parent[parent[a[x]]] == parent[parent[b[y]]])

        join_trees(trees[one], trees[two], measure, met, connected, one == two)
    return found


TASK_NAMES = ("grp", "task", "side", "low", "n", "known", "content")
TASK = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _tasks(source: DataFrame, dealt: DataFrame, measure: Measure, pairs: list[tuple[int, int]], every: bool = False, exact: bool = True) -> DataFrame:
    """a, b: links found by the tasks. dealt: id, mark, low, high, known, tasks (array of grp, task, side) of sets; the
    pairs of sides are joined in every task, by the sets themselves or by their signatures."""
    dealt = keep(dealt, "dealt-sets")
    marked = dealt.withColumnRenamed("id", "its_id").withColumnRenamed("mark", "its_mark")
    if dealt.agg(F.coalesce(F.sum(F.size("tasks")), F.lit(0))).first()[0] <= FEW_TASKS:
        marked = F.broadcast(marked)  # else all texts would be dealt out to meet a few sets
    wanted = source.join(marked, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))).select("text", "low", "high", "known", "tasks")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), TASK, strict=True)], names=list(TASK_NAMES))

    def run(batches):
        give_back()
        for batch in small_batches(batches, 0, 1 << 20):
            sets = shingle_sets([x or b"" for x in batch.column(0).to_pylist()], measure.width)
            out, held = [], 0
            for s, low, high, known, tasks in zip(sets, *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                # the mark of a text is 64 bits: rows that only share it are not the set that is meant
                if _digest(s) != (low, high):
                    continue
                content = s.tobytes() if exact else signature(s)
                for t in tasks:
                    out.append((t["grp"], t["task"], t["side"], low, len(s), known, content))
                    held += len(content)
                    if held > 4 << 20:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

    def join(key, pdf):
        import pandas as pd

        found = _joined(pdf.drop_duplicates("low").to_dict("list"), measure, pairs, every, exact)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    work = wanted.mapInArrow(run, "grp long, task string, side int, low long, n long, known long, content binary")
    return work.groupBy("grp", "task").applyInPandas(join, "a long, b long")


def _possible(source: DataFrame, classes: DataFrame, active: DataFrame, keyed: DataFrame, measure: Measure) -> DataFrame:
    """low, known, label: the sets that signature trees leave in smaller groups. active: low, known, label; keyed: low, key."""
    maybe = keep(_tasks(source, _in_groups(classes, active, keyed, measure), measure, [(2, 2), (0, 1)], exact=False), "possible-links")
    return components(maybe).join(active.select("low", "known"), F.col("node") == F.col("low")).select("low", "known", "label")


def _around_hubs(classes: DataFrame, met: DataFrame) -> DataFrame:
    """The tasks of the first round: chunks of the sets around each hub (side 1), and the hub in every chunk (side 0)."""
    spokes = met.groupBy("low").agg(F.min("a").alias("hub")).where("hub <> low").join(classes.select("low", "n"), "low")
    spokes = keep(spokes, "spokes")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum(8 * F.col("n")) / CHUNK_BYTES)).cast("int")
    hubs = keep(spokes.groupBy("hub").agg(chunks.alias("chunks")), "hubs")
    own = spokes.join(hubs, "hub").select("low", F.array(F.struct(F.col("hub").alias("grp"), F.pmod(F.xxhash64("low"), F.col("chunks")).cast("string").alias("task"), F.lit(1).alias("side"))).alias("tasks"))
    all_of_them = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.col("hub").alias("grp"), k.cast("string").alias("task"), F.lit(0).alias("side")))
    dealt = own.unionAll(hubs.select(F.col("hub").alias("low"), all_of_them.alias("tasks"))).groupBy("low").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))
    return dealt.join(classes, "low").select("id", "mark", "low", "high", F.col("low").alias("known"), "tasks")


def _in_groups(classes: DataFrame, active: DataFrame, keyed: DataFrame, measure: Measure) -> DataFrame:
    """The tasks of the second round. active: low, known, label (its group); keyed: low, key, of all keys in which two sets
    that are to be joined can meet.

    A group of a block at most is one task. In a larger one the sets of a key go to the key's bucket, a bucket holding
    about a block; the sets of a key that would make up much of a bucket are a group of their own, cut into blocks.
    """
    sizes = [F.count(F.lit(1)).alias("sets"), F.sum(8 * F.col("n")).alias("bytes")]
    weighed = active.join(classes.select("low", "n"), "low")
    large = keep(weighed.groupBy("label").agg(*sizes).where((F.col("sets") > BLOCK_SETS) | (F.col("bytes") > BLOCK_BYTES)).select("label"), "large-groups")
    if large.isEmpty():
        discard(large)
        return _in_blocks(classes, active, measure)
    meeting = keep(weighed.join(large, "label").join(keyed.select("low", "key"), "low").select("label", "key", "low", "known", "n"), "keys-of-large-groups")
    often = (4 * F.col("sets") > BLOCK_SETS) | (4 * F.col("bytes") > BLOCK_BYTES)
    keys = keep(meeting.groupBy("label", "key").agg(*sizes).where("sets > 1").withColumn("often", often), "large-groups-keys")
    buckets = F.greatest(F.ceil(F.sum("sets") / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    rest = keys.where("NOT often").join(keys.where("NOT often").groupBy("label").agg(buckets.alias("buckets")), "label")
    rest = rest.select("label", "key", F.pmod(F.xxhash64("key"), F.col("buckets")).alias("bucket"))
    task = F.struct(F.col("label").alias("grp"), F.concat_ws("-", F.lit("key"), F.col("bucket")).alias("task"), F.lit(2).alias("side"))
    in_buckets = meeting.join(rest, ["label", "key"]).select("low", "known", "label", "bucket").distinct().select("low", "known", F.array(task).alias("tasks"))
    alone = meeting.join(keys.where("often").select("label", "key"), ["label", "key"]).select("low", "known", F.xxhash64("label", "key").alias("label"))
    others = active.join(large, "label", "left_anti").select("low", "known", "label").unionByName(alone)
    dealt = _in_blocks(classes, others, measure).select("low", "known", "tasks").unionByName(in_buckets)
    dealt = dealt.groupBy("low").agg(F.first("known").alias("known"), F.flatten(F.collect_list("tasks")).alias("tasks"))
    return dealt.join(classes, "low").select("id", "mark", "low", "high", "known", "tasks")


def _in_blocks(classes: DataFrame, active: DataFrame, measure: Measure) -> DataFrame:
    """Tasks in which all sets of a group meet. active: low, known, label (its group)."""
    band = sum((F.when(F.col("n") >= int(x), 1).otherwise(0) for x in measure.bands[1:90]), F.lit(0))
    sized = keep(active.join(classes, "low").withColumn("band", band), "active-sets")
    whole = sized.groupBy("label").agg(F.count(F.lit(1)).alias("all_sets"), F.sum(8 * F.col("n")).alias("all_bytes"))
    each = sized.groupBy("label", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum(8 * F.col("n")).alias("bytes"))
    cut = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    small = (F.col("all_sets") <= BLOCK_SETS) & (F.col("all_bytes") <= BLOCK_BYTES)
    plan = each.join(whole, "label").select("label", "band", small.alias("small"), cut.alias("blocks"))
    nxt = plan.select("label", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next_blocks"))
    before = plan.select("label", (F.col("band") + 1).alias("band"), F.col("blocks").alias("before_blocks"))
    plan = keep(plan.join(nxt, ["label", "band"], "left").join(before, ["label", "band"], "left"), "plan-of-blocks")
    placed = sized.join(plan, ["label", "band"]).withColumn("mine", F.pmod(F.xxhash64("low"), F.col("blocks")).cast("int"))
    # tasks of a cut group: a block with itself, with the other blocks of its band, with all blocks of the next band
    grp = F.col("label").alias("grp")
    own = F.array(F.struct(grp, F.concat_ws("-", F.col("band"), F.col("mine")).alias("task"), F.lit(2).alias("side")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("mine"))
    across = F.transform(others, lambda k: F.struct(grp, F.concat_ws("-", F.col("band"), F.least(F.col("mine"), k), F.greatest(F.col("mine"), k)).alias("task"), (k < F.col("mine")).cast("int").alias("side")))
    following = F.transform(F.sequence(F.lit(0), F.col("next_blocks") - 1), lambda k: F.struct(grp, F.concat_ws("-", F.col("band"), F.lit("n"), F.col("mine"), k).alias("task"), F.lit(0).alias("side")))
    preceding = F.transform(F.sequence(F.lit(0), F.col("before_blocks") - 1), lambda k: F.struct(grp, F.concat_ws("-", F.col("band") - 1, F.lit("n"), k, F.col("mine")).alias("task"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<grp:bigint,task:string,side:int>>")
    tasks = F.when(F.col("small"), F.array(F.struct(grp, F.lit("all").alias("task"), F.lit(2).alias("side")))).otherwise(F.concat(own, across, F.coalesce(following, none), F.coalesce(preceding, none)))
    return placed.select("id", "mark", "low", "high", "known", tasks.alias("tasks"))


def _prepared(docs: DataFrame, measure: Measure, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The source with each document once, the sets of documents, one row for each class, and where classes meet."""
    source = _source(docs, id_col, text_col)
    sets, met = _met(source, measure, parts)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))
    classes = sets.groupBy("low", "high").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("least").alias("least"))
    classes = keep(classes.select("low", "high", "first.id", "first.mark", "copies", "n", "least"), "set-classes")
    each = met.select("low", F.col("low").alias("known"), "key")
    each._kept = met._kept
    met = _enough(each, classes)
    if not sets.groupBy("id", "mark").count().where("count > 1").isEmpty():
        source = source.groupBy("id", "mark").agg(F.first("text").alias("text"))
    return source, sets, classes, met


def _components(docs: DataFrame, measure: Measure, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """The sets of documents, and of each class (l, h) the number of documents and the first document that links reach,
    by id, those without one last: struct first(none, id, mark)."""
    source, sets, classes, met = _prepared(docs, measure, id_col, text_col, parts)
    links = keep(_tasks(source, _around_hubs(classes, met), measure, [(0, 1), (1, 1)]), "links")
    near = components(links)
    known = F.coalesce("label", "low").alias("known")
    # keys of sets that are not connected yet
    told = met.select("low", "key").join(near, F.col("low") == F.col("node"), "left").select("low", "key", known)
    open_keys = keep(told.groupBy("key").agg(F.min("known").alias("a"), F.max("known").alias("z")).where("a <> z").select("key", "a"), "open-keys")
    open_sets = keep(told.join(open_keys, "key").select("low", "known", "key", "a"), "open-sets")
    discard(met, open_keys)
    open_sets = _rarest(_enough(open_sets, classes), classes)
    groups = components(open_sets.select("known", "a").distinct().select("a", F.col("known").alias("b")))
    active = keep(open_sets.select("low", "known").distinct().join(groups, F.col("known") == F.col("node")).select("low", "known", "label"), "open-groups")
    possible = _possible(source, classes, active, open_sets, measure)
    more = keep(_tasks(source, _in_groups(classes, possible, open_sets, measure), measure, [(2, 2), (0, 1)]), "links")
    joined = components(links.unionAll(more))
    reached = classes.join(joined, F.col("low") == F.col("node"), "left").withColumn("label", F.coalesce("label", "low"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    answer = reached.join(reached.groupBy("label").agg(first), "label").select(F.col("low").alias("l"), F.col("high").alias("h"), "copies", "first")
    return sets, keep(answer, "set-components")


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", parts: int = 1) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links num/den or more.

    parts: rounds in which the key space is gone through; each round deals out 1/parts of the keys.
    """
    told = _per_document(*_components(docs, Measure(width, num, den), id_col, text_col, parts))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("first.id"))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", parts: int = 1) -> DataFrame:
    """The documents with all their columns without those that links connect to one of smaller id (any id is smaller
    than none). Documents without words stay, and so do rows that repeat id and text of one that stays."""
    told = _per_document(*_components(docs, Measure(width, num, den), id_col, text_col, parts))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    gone = told.where((F.col("n") > 0) & ~stays).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    gone = keep(gone, "near-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("mark"))
    return keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left_anti").select("row.*")


def jaccard_links(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(a, b) of every two linked classes of equal sets, a < b; and id, class, n_shingles, n_links (of other classes) of
    every document. One round, in which no pair is left out for being connected."""
    measure = Measure(width, num, den)
    source, sets, classes, met = _prepared(docs, measure, id_col, text_col, parts)
    met = _rarest(met, classes)
    groups = components(met.select("a", F.col("low").alias("b")).distinct())
    active = groups.select(F.col("node").alias("low"), F.col("node").alias("known"), "label")
    possible = _possible(source, classes, active, met, measure)
    found = _tasks(source, _in_groups(classes, possible, met, measure), measure, [(2, 2), (0, 1)], every=True)
    links = keep(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    counts = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    members = sets.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.col("low")).alias("class"), F.col("n").alias("n_shingles")).join(counts, "class", "left")
    return links, members.select(id_col, "class", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _per_document(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """The sets of documents with their class's first; sets of very many documents are broadcast."""
    total = answer.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    least = max(1000, total // 1000)  # fewer than 1000 sets can have more
    same = (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
    hot = F.broadcast(answer.where(F.col("copies") > least).drop("copies"))
    rest = answer.where(F.col("copies") <= least).drop("copies")
    found = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(rest, same))
    return found.select("id", "mark", "n", "first")
