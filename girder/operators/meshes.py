"""Meshes: triangles of shells, exact ray hits, filled sections. Kernels run over Arrow batches of whole meshes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from girder.functions import mesh_kernels as kernels

POINT = "struct<x:double,y:double,z:double>"


def _numbers(points: pa.Array) -> np.ndarray:
    """(n, 3) of a flat array of points."""
    return np.stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(3)], 1) if len(points) else np.zeros((0, 3))


def _structs(points: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in range(3)], "xyz")


def triangles_of_shells(shells: DataFrame) -> DataFrame:
    """repr_id, face, a, b, c of shells(repr_id, points, profiles, holes array<struct<profile_id,idx>>).

    A few files of small rows can hold very many shells, so these are dealt out first; points stay Arrow arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = dict(zip(batch.schema.names, batch.columns, strict=True))
            flat = _numbers(each["points"].flatten())
            sizes = pc.fill_null(pc.list_value_length(each["points"]), 0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            shell, face, corners = [], [], []
            for n, (profiles, holes) in enumerate(zip(each["profiles"].to_pylist(), each["holes"].to_pylist(), strict=True)):
                low = int(starts[n])
                points = flat[low : starts[n + 1]].tolist()
                inside: dict[int, list] = {}
                for h in holes or ():
                    inside.setdefault(h["profile_id"], []).append(h["idx"])
                for f, profile in enumerate(profiles or ()):
                    for t in kernels.triangulate(points, profile, inside.get(f, ())):
                        shell.append(n)
                        face.append(f)
                        corners.append((low + t[0], low + t[1], low + t[2]))
            at = np.array(corners, np.int64).reshape(-1, 3)
            columns = [each["repr_id"].take(pa.array(shell, pa.int64())).cast(pa.int64()), pa.array(face, pa.int32()), *[_structs(flat[at[:, k]]) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, ["repr_id", "face", "a", "b", "c"])

    tasks = max(int(shells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * shells.sparkSession.sparkContext.defaultParallelism)
    dealt = shells.select("repr_id", "points", "profiles", "holes").repartition(tasks, "repr_id")  # a number, so that small rows are not put together again
    return dealt.mapInArrow(run, f"repr_id long, face int, a {POINT}, b {POINT}, c {POINT}")


def ray_hits(triangles: DataFrame, origin: tuple, direction: tuple) -> DataFrame:
    """Triangles that a ray hits, with the distance, as column expressions; join candidates by their boxes first."""
    o, d = [F.lit(float(x)) for x in origin], [F.lit(float(x)) for x in direction]
    from girder.functions.geometry import cross, dot

    at = lambda p: [F.col(f"{p}.{x}") for x in "xyz"]
    a, b, c = at("a"), at("b"), at("c")
    e1, e2 = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
    p = cross(d, e2)
    s = [x - y for x, y in zip(o, a, strict=True)]
    w = cross(s, e1)
    rows = triangles.withColumn("_det", dot(e1, p)).where(F.abs("_det") > 1e-12)
    rows = rows.withColumns({"_u": dot(s, p) / F.col("_det"), "_v": dot(d, w) / F.col("_det"), "distance": dot(e2, w) / F.col("_det")})
    return rows.where("_u >= 0 AND _v >= 0 AND _u + _v <= 1 AND distance >= 0").drop("_det", "_u", "_v")


def _contours(flat: np.ndarray) -> list[tuple[bool, list, float]]:
    """closed, points and area of the contours of segments (n, 2, 2)."""
    out = []
    for chain, closed in kernels.stitch(flat):
        area = abs(sum(x * v - u * y for (x, y), (u, v) in zip(chain, chain[1:] + chain[:1], strict=True))) / 2 if closed else 0.0
        out.append((closed, chain, area))
    return out


def section_contours(segments: DataFrame, key: str, axes: tuple[str, str]) -> DataFrame:
    """key, closed, points, area of the contours that a section's segments (p, q) of each key form.

    Keys come in order, many in a batch; the segments of a batch's last key wait for the next batch, so a task holds a batch
    and the segments of one key.
    """
    own = segments.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(own)
        last, waiting = None, []

        def told(keys: list, found: list) -> pa.RecordBatch:
            flat = [p for _, chain, _ in found for p in chain]
            ends = np.concatenate([[0], np.cumsum([len(chain) for _, chain, _ in found])]).astype(np.int32)
            pairs = pa.ListArray.from_arrays(np.arange(0, 2 * len(flat) + 1, 2, dtype=np.int32), pa.array(np.array(flat, float).reshape(-1)))
            columns = [pa.array(keys, kind), pa.array([c for c, _, _ in found], pa.bool_()), pa.ListArray.from_arrays(ends, pairs), pa.array([a for _, _, a in found], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, [key, "closed", "points", "area"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], 1)
            runs = pc.run_end_encode(batch.column(0))
            ends, names, start = runs.run_ends.to_pylist(), runs.values.to_pylist(), 0
            keys, found = [], []
            for name, end in zip(names, ends, strict=True):
                if waiting and name != last:
                    done = _contours(np.concatenate(waiting))
                    keys += [last] * len(done)
                    found += done
                    waiting = []
                last = name
                waiting.append(flat[start:end])
                start = end
            if found:
                yield told(keys, found)
        if waiting:
            done = _contours(np.concatenate(waiting))
            yield told([last] * len(done), done)

    sides = [F.col(f"{e}.{x}").cast("double").alias(f"_{e}{k}") for e in "pq" for k, x in enumerate(axes)]
    # a number, so that small rows are not put together into few tasks
    tasks = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * segments.sparkSession.sparkContext.defaultParallelism)
    ordered = segments.select(key, *sides).repartition(tasks, key).sortWithinPartitions(key)
    return ordered.mapInArrow(run, f"`{key}` {own.simpleString()}, closed boolean, points array<array<double>>, area double")


def geometry_keys(triangles: DataFrame, key: str = "repr_id") -> DataFrame:
    """key and a hash of its shape: counts, area, volume and centroid, rounded; equal shapes share it."""
    from girder.functions.geometry import cross, signed_volume

    a, b, c = ([F.col(f"{p}.{x}") for x in "xyz"] for p in "abc")
    n = cross([y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)])
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    sums = triangles.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"), F.max(area).alias("largest"), F.sum(signed_volume(a, b, c)).alias("volume"), *[F.avg((u + v + w) / 3).alias(x) for u, v, w, x in zip(a, b, c, "xyz", strict=True)]
    )
    return sums.select(key, F.xxhash64("n", *[F.round(c, 4) for c in ("area", "largest", "volume", "x", "y", "z")]).alias("shape"))
