"""Exact top-k search by inner product, by distributed histogram selection.

Queries come in blocks of at most BLOCK (the block is what is broadcast). For each block:

1. every candidate is scored, and each task counts the scores of each query in BINS bins between the
   bounds that the norms give; the counts are added up over all tasks;
2. the bin that holds a query's kth score becomes its new range, until a bin is a single value;
3. a last pass keeps the scores above the kth value, and of those equal to it the smallest ids, as many
   of each query as a task can contribute at most; a window ranks what is left.

Components become floor(64 x). Vectors that are null or hold null or non-finite components, and rows
without an id, take no part. A query never meets rows of its own id; only vectors of the same length
meet. Of several rows that share a query's id, the smallest vector asks. Repeated candidates each
count. Components beyond 2**62 are clipped there, scores beyond 64 bits at the 64-bit limits. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
BINS = 256
TILE = 1 << 21  # scores held at once by a task
EXACT = 2.0**53


def quantised(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of an Arrow list column: the places of usable vectors, and floor(64 x) of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.flatnonzero(~np.isfinite(values))
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[np.searchsorted(ends, bad, "right")] = False
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(64 * values), -(2.0**62), 2.0**62)
    where = np.flatnonzero(good)
    return where, [whole[ends[k] - sizes[k] : ends[k]] for k in where]


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with rows, as int64."""
    if left.shape[1] * np.abs(left).max(initial=0) * np.abs(right).max(initial=0) < EXACT:
        return (left @ right.T).astype(np.int64)
    big = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in right] for x in left]
    return np.array([[min(max(v, -(2**63)), 2**63 - 1) for v in row] for row in big], np.int64).reshape(len(left), len(right))


class Block:
    """Queries of equal lengths together, with each query's range."""

    def __init__(self, ids: list, vectors: list[np.ndarray], bound: float):
        self.ids = np.array(ids, np.int64)
        self.by_size: dict[int, np.ndarray] = {}
        for k, v in enumerate(vectors):
            self.by_size.setdefault(len(v), []).append(k)
        self.by_size = {n: np.array(k) for n, k in self.by_size.items()}
        self.vectors = {n: np.array([vectors[k] for k in which]).reshape(len(which), n) for n, which in self.by_size.items()}
        norm = np.array([np.sqrt((v * v).sum()) for v in vectors])
        most = [min(int(x) + 2, 2**63 - 1) for x in norm * bound * (1 + 1e-9)]
        self.low = [-x for x in most]
        self.width = [-(-(2 * x + 1) // BINS) for x in most]
        self.span = [BINS * w for w in self.width]
        self.above = [0] * len(ids)
        self.kth: list = [None] * len(ids)

    def tiles(self, batches):
        """(candidates' ids, places of queries, scores); a query's own rows are marked by the third."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            where, vectors = quantised(batch.column(1))
            sizes = np.array([len(v) for v in vectors], np.int64)
            for n, which in self.by_size.items():
                mine = np.flatnonzero(sizes == n)
                step = max(1, TILE // len(which))
                for start in range(0, len(mine), step):
                    part = mine[start : start + step]
                    found = scores(np.array([vectors[k] for k in part]).reshape(len(part), n), self.vectors[n])
                    other = ids[where[part]]
                    yield other, which, found, other[:, None] != self.ids[which][None, :]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def _largest_norm(rows: DataFrame) -> float:
    def run(batches):
        most = 0.0
        for batch in batches:
            for v in quantised(batch.column(1))[1]:
                most = max(most, float(v @ v))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    return float(np.sqrt(rows.mapInArrow(run, "most double").agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]))


def _refine(rows: DataFrame, block: Block, k: int) -> None:
    """One pass: narrows each query's range to the bin that holds its kth score."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = held.value
        low, width, span = (np.array(x, np.float64) for x in (b.low, b.width, b.span))
        exact = max(abs(x) + y for x, y in zip(b.low, b.span, strict=True)) < EXACT
        counts = np.zeros(len(b.ids) * BINS, np.int64)
        for _, which, found, other in b.tiles(batches):
            if exact:
                past = found - low[which]
                at = np.floor_divide(past, width[which]).astype(np.int64)
                at[past >= span[which]] = BINS
            else:
                at = np.array([[min(max((int(x) - b.low[q]) // b.width[q] if int(x) - b.low[q] < b.span[q] else BINS, -1), BINS) for x, q in zip(row, which, strict=True)] for row in found], np.int64)
            fits = other & (at >= 0) & (at < BINS)
            counts += np.bincount((which[None, :] * BINS + at)[fits], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some // BINS), pa.array(some % BINS), pa.array(counts[some])], ["query", "bin", "n"])

    summed = rows.mapInArrow(run, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query").orderBy(F.desc("bin"))  # at most BINS rows each
    reached = summed.withColumn("upto", F.sum("n").over(down))
    needed = F.lit(k) - F.element_at(F.lit(block.above), (F.col("query") + 1).cast("int")) if len(block.above) <= 64 else None
    if needed is None:
        spark = rows.sparkSession
        above = F.broadcast(spark.createDataFrame(list(enumerate(block.above)), "query long, above long"))
        reached = reached.join(above, "query")
        needed = F.lit(k) - F.col("above")
    found = reached.withColumn("needed", needed).where("upto >= needed AND upto - n < needed").select("query", "bin", (F.col("upto") - F.col("n")).alias("over"))
    seen = set()
    for r in found.collect():  # one row for each query of the block
        q = r["query"]
        seen.add(q)
        block.low[q] += r["bin"] * block.width[q]
        block.above[q] += r["over"]
        if block.width[q] == 1:
            block.kth[q] = block.low[q]
        block.span[q] = block.width[q]
        block.width[q] = -(-block.width[q] // BINS)
    for q in range(len(block.ids)):
        if q not in seen and block.kth[q] is None:  # fewer candidates than k: all of them
            block.kth[q], block.width[q] = -(2**63), 1


def _select(rows: DataFrame, block: Block, k: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(block)

    def best(parts: list) -> list:
        query, score, ids = (np.concatenate([p[c] for p in parts]) for c in range(3))
        order = np.lexsort((ids, -score, query)) if len(score) == 0 or score.min() > -(2**63) else np.array(sorted(range(len(ids)), key=lambda i: (query[i], -int(score[i]), ids[i])))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        order = order[place < k]
        return [(query[place < k], score[order], ids[order])]

    def run(batches):
        b = held.value
        kth = np.array(b.kth, np.int64)
        parts, size, room = [], 0, 4 * k * len(b.ids) + 100_000
        for ids, which, found, other in b.tiles(batches):
            row, column = np.nonzero(other & (found >= kth[which]))
            parts.append((which[column], found[row, column], ids[row]))
            size += len(row)
            if size > room:
                parts = best(parts)
                size = len(parts[0][0])
        if size:
            ((query, score, ids),) = best(parts)
            for start in range(0, len(ids), 50_000):
                cut = slice(start, start + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[query[cut]]), pa.array(ids[cut]), pa.array(score[cut])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    asked = _usable(queries, id_col, vector_col)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    asked = asked.where(usable).groupBy("id").agg(F.min("v").alias("v")).orderBy("id")
    largest = _largest_norm(rows)
    out: DataFrame | None = None
    each = ((r["id"], quantised(pa.array([list(map(float, r["v"]))], pa.list_(pa.float64())))[1][0]) for r in asked.toLocalIterator())
    while part := list(itertools.islice(each, block)):
        b = Block([i for i, _ in part], [v for _, v in part], largest)
        while any(x is None for x in b.kth):
            _refine(rows, b, k)
        found = _select(rows, b, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows from each task
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
