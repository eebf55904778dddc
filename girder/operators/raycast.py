"""Placed samples (full transforms), many rays against many samples, exact hits on triangles.

Rays and boxes meet in cells of a grid: a box is in the cells that it touches, a ray in those that it passes inside the
model's box, so neither side is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions import geometry as geo
from girder.operators.spatial import HIGH, LOW, cells, merged
from girder.operators.traversal import materialise

AXES = "xyz"
POINT = [f"p{a}" for a in AXES]
ACROSS, UP = [f"x{a}" for a in AXES], [f"y{a}" for a in AXES]
#: A matrix as columns, by column and row, without the last row (0, 0, 0, 1). Single columns, as the elements of an array
#: would be written out wherever they are used.
MATRIX = [[f"m{c}{a}" for a in AXES] for c in range(4)]
M = [n for column in MATRIX for n in column]


def placed_samples(samples: DataFrame, transforms: DataFrame, representations: DataFrame) -> DataFrame:
    """Samples with their matrix (global x local) and local box; samples(sample_id, item_id, repr_id, lpx ... lyz: position, x
    and y direction), transforms(item_id, gpx ... gyz), representations(repr_id, box). Components that are not finite count as 0."""
    joined = samples.join(representations.hint("merge"), "repr_id").join(transforms, "item_id")  # boxes are larger than their file tells
    own = ["sample_id", "item_id", "repr_id", *LOW, *HIGH]
    names = [f"{k}{c}" for k in "gl" for c in (*POINT, *ACROSS, *UP)]
    rows = joined.select(*own, *[geo.finite(F.col(c)).alias(c) for c in names])
    z = {f"{k}z{a}": c for k in "gl" for a, c in zip(AXES, geo.cross([F.col(f"{k}{n}") for n in ACROSS], [F.col(f"{k}{n}") for n in UP]), strict=True)}
    rows = rows.select(*own, *names, *[c.alias(n) for n, c in z.items()])

    def turned(column: str) -> list[Column]:
        """A direction or position of the sample under the item's turn."""
        return [F.col(f"gx{a}") * F.col(f"l{column}x") + F.col(f"gy{a}") * F.col(f"l{column}y") + F.col(f"gz{a}") * F.col(f"l{column}z") for a in AXES]

    each = [turned(c) for c in "xyz"] + [[t + F.col(f"gp{a}") for t, a in zip(turned("p"), AXES, strict=True)]]
    return rows.select(*own, *[c.alias(n) for column, names_ in zip(each, MATRIX, strict=True) for c, n in zip(column, names_, strict=True)])


def placed_boxes(placed: DataFrame) -> DataFrame:
    """sample_id, item_id, repr_id and the box in the model around each sample's transformed box, by centre and extent."""
    own = ["sample_id", "item_id", "repr_id"]
    centre = [((F.col(l) + F.col(h)) / 2).alias(f"c{a}") for a, l, h in zip(AXES, LOW, HIGH, strict=True)]
    extent = [((F.col(h) - F.col(l)) / 2).alias(f"e{a}") for a, l, h in zip(AXES, LOW, HIGH, strict=True)]
    rows = placed.select(*own, *M, *centre, *extent)
    middle = [sum((F.col(MATRIX[k][r]) * F.col(f"c{a}") for k, a in enumerate(AXES)), F.col(MATRIX[3][r])).alias(f"o{x}") for r, x in enumerate(AXES)]
    half = [(F.abs(MATRIX[0][r]) * F.col("ex") + F.abs(MATRIX[1][r]) * F.col("ey") + F.abs(MATRIX[2][r]) * F.col("ez")).alias(f"h{x}") for r, x in enumerate(AXES)]
    rows = rows.select(*own, *middle, *half)
    return rows.select(*own, *[(F.col(f"o{a}") - F.col(f"h{a}")).alias(l) for a, l in zip(AXES, LOW, strict=True)], *[(F.col(f"o{a}") + F.col(f"h{a}")).alias(h) for a, h in zip(AXES, HIGH, strict=True)])


def contained(point: list[Column], planes) -> Column:
    """Whether a point lies in all half-spaces n p + c >= 0; planes with an infinite constant do not count."""
    good = F.lit(True)
    for *normal, constant in planes:
        if abs(constant) != float("inf"):
            good = good & (geo.dot(normal, point) + float(constant) >= 0)
    return good


def ray_cells(rays: DataFrame, bounds: DataFrame, size: float) -> DataFrame:
    """Rays(ray_id, ox, oy, oz, dx, dy, dz) with the grid cells that they pass inside bounds (one row: a box).

    The ray is cut into slabs along the axis of its largest component; inside a slab the other two coordinates change by
    one cell at most.
    """
    width = [F.abs(F.col(f"d{a}")) for a in AXES]
    main = F.when((width[0] >= width[1]) & (width[0] >= width[2]), 0).when(width[1] >= width[2], 1).otherwise(2)
    rows = rays.where(F.greatest(*width) > 0).crossJoin(F.broadcast(bounds.select(*LOW, *HIGH))).withColumn("axis", main)

    def turned(prefix: str, step: int) -> Column:
        """Component ``step`` places after the main axis."""
        names = [f"{prefix}{a}" for a in AXES]
        return F.when(F.col("axis") == 0, F.col(names[step])).when(F.col("axis") == 1, F.col(names[(1 + step) % 3])).otherwise(F.col(names[(2 + step) % 3]))

    rows = rows.select(*rays.columns, "axis", *[turned(p, k).alias(f"{n}{k}") for p, n in (("o", "_o"), ("d", "_d"), ("min", "_l"), ("max", "_h")) for k in range(3)])
    ahead = F.col("_d0") > 0
    start = F.when(ahead, F.greatest("_o0", "_l0")).otherwise(F.least("_o0", "_h0"))
    end = F.when(ahead, F.col("_h0")).otherwise(F.col("_l0"))
    rows = rows.withColumns({"_from": start, "_to": end}).where((ahead & (F.col("_from") <= F.col("_to"))) | (~ahead & (F.col("_from") >= F.col("_to"))))
    low, high = F.least("_from", "_to"), F.greatest("_from", "_to")
    rows = rows.withColumn("_c0", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
    ends = [F.greatest(low, F.col("_c0") * size), F.least(high, (F.col("_c0") + 1) * size)]
    for k in (1, 2):
        at = [F.col(f"_o{k}") + (e - F.col("_o0")) * F.col(f"_d{k}") / F.col("_d0") for e in ends]
        inside = [F.greatest(F.least(*at), F.col(f"_l{k}")), F.least(F.greatest(*at), F.col(f"_h{k}"))]
        rows = rows.withColumns({f"_a{k}": inside[0], f"_b{k}": inside[1]})
    rows = rows.where("_a1 <= _b1 + 1e-9 AND _a2 <= _b2 + 1e-9")
    for k in (1, 2):
        rows = rows.withColumn(f"_c{k}", F.explode(F.sequence(F.floor((F.least(f"_a{k}", f"_b{k}") - 1e-9) / size).cast("long"), F.floor((F.greatest(f"_a{k}", f"_b{k}") + 1e-9) / size).cast("long"))))
    place = [F.when(F.col("axis") == 0, F.col(f"_c{a}")).when(F.col("axis") == 1, F.col(f"_c{b}")).otherwise(F.col(f"_c{c}")) for a, b, c in ((0, 2, 1), (1, 0, 2), (2, 1, 0))]
    return rows.select(*rays.columns, *[c.alias(f"cell_{a}") for c, a in zip(place, AXES, strict=True)])


def candidates(rays: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """ray and sample_id of every ray with the boxes that it enters."""
    at = [f"cell_{a}" for a in AXES]
    met = ray_cells(rays, merged(boxes), size).join(cells(boxes, size), at)
    near, far = F.lit(0.0), F.lit(float("inf"))
    inside = F.lit(True)
    for a, l, h in zip(AXES, LOW, HIGH, strict=True):
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        t = [(F.col(l) - o) / F.nullif(d, F.lit(0.0)), (F.col(h) - o) / F.nullif(d, F.lit(0.0))]
        inside = inside & ((d != 0) | ((o >= F.col(l)) & (o <= F.col(h))))
        near = F.greatest(near, F.least(*t))  # null, where the ray runs along the slab, is passed over
        far = F.least(far, F.greatest(*t))
    hits = met.where(inside & (near <= far + 1e-9)).select(*rays.columns, "sample_id")
    return hits.dropDuplicates(["ray_id", "sample_id"])


def hits(rays: DataFrame, placed: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """ray_id, sample_id, item_id, distance: every triangle hit of every ray, exact; triangles(repr_id, a, b, c) are local.

    Distances are in lengths of the ray's direction. Placed samples and candidates are written: both are read twice, and
    each step is planned on its own. What is joined is far larger than the files that it comes from tell (twelve triangles for
    a row of two numbers), so no side is sent to the driver to be broadcast.
    """
    placed = materialise(placed)
    near = materialise(candidates(rays, materialise(placed_boxes(placed)), size))
    rows = near.hint("merge").join(placed.select("sample_id", "item_id", "repr_id", *M), "sample_id").join(triangles.select("repr_id", "a", "b", "c").hint("merge"), "repr_id")
    own, ray = ["ray_id", "sample_id", "item_id"], [f"{k}{a}" for k in "od" for a in AXES]

    def world(p: str) -> list[Column]:
        return [(F.col(MATRIX[0][r]) * F.col(f"{p}.x") + F.col(MATRIX[1][r]) * F.col(f"{p}.y") + F.col(MATRIX[2][r]) * F.col(f"{p}.z") + F.col(MATRIX[3][r])).alias(f"{p}{x}") for r, x in enumerate(AXES)]

    def vector(k: str) -> list[Column]:
        return [F.col(f"{k}{x}") for x in AXES]

    def named(k: str, columns: list[Column]) -> list[Column]:
        return [c.alias(f"{k}{x}") for c, x in zip(columns, AXES, strict=True)]

    def less(p: str, q: str) -> list[Column]:
        return [x - y for x, y in zip(vector(p), vector(q), strict=True)]

    # step by step, so that each product is computed once
    rows = rows.select(*own, *ray, *world("a"), *world("b"), *world("c"))
    rows = rows.select(*own, *vector("d"), *named("e", less("b", "a")), *named("f", less("c", "a")), *named("s", less("o", "a")))
    rows = rows.select(*own, *vector("d"), *vector("e"), *vector("f"), *vector("s"), *named("p", geo.cross(vector("d"), vector("f"))), *named("w", geo.cross(vector("s"), vector("e"))))
    rows = rows.select(*own, *vector("d"), *vector("f"), *vector("s"), *vector("p"), *vector("w"), geo.dot(vector("e"), vector("p")).alias("det"))
    shares = [F.when(F.abs("det") > 1e-12, geo.dot(vector(a), vector(b)) / F.col("det")).alias(n) for n, a, b in (("u", "s", "p"), ("v", "d", "w"), ("distance", "f", "w"))]
    # the task's number keeps the filter above these steps: moved below them, it would hold every product many times over, in
    # a method too long for the JVM to compile
    found = rows.select(*own, *shares, F.spark_partition_id().alias("task"))
    return found.where("u >= 0 AND v >= 0 AND u + v <= 1 AND distance >= 0 AND task >= 0").select(*own, "distance")


def all_hits(found: DataFrame) -> DataFrame:
    """ray_id, sample_id, item_id and the first distance of each sample that a ray hits."""
    return found.groupBy("ray_id", "sample_id", "item_id").agg(F.min("distance").alias("distance"))


def nearest_hits(found: DataFrame) -> DataFrame:
    """The nearest sample of each ray; ties go to the smaller sample."""
    first = F.min(F.struct("distance", "sample_id", "item_id")).alias("h")
    return found.groupBy("ray_id").agg(first).select("ray_id", "h.sample_id", "h.item_id", "h.distance")


def visible_only(found: DataFrame, hidden: DataFrame) -> DataFrame:
    """Hits on items that are not hidden(item_id)."""
    return found.join(hidden.select("item_id").distinct(), "item_id", "left_anti")


def snap_score(ray_square: Column, camera_square: Column) -> Column:
    """What the nearest of two snapping hits has least of: both distances, the ray's 32-fold, or the camera's alone
    where a hit lies on the ray."""
    return F.when(ray_square != 0, 32 * ray_square + camera_square).otherwise(camera_square)


def snap_points(rays: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """ray_id and the point(point_id, x, y, z) within ``reach`` of the ray that scores best; ties by point_id.

    Points meet rays in cells twice as wide as the reach, the ray's cells widened by one on every side.
    """
    size = 2 * reach
    point_cells = points.select("*", *[F.floor(F.col(a) / size).cast("long").alias(f"cell_{a}") for a in AXES])
    inf = float("inf")
    box = points.agg(*[F.coalesce(F.min(a) - reach, F.lit(inf)).alias(l) for a, l in zip(AXES, LOW, strict=True)], *[F.coalesce(F.max(a) + reach, F.lit(-inf)).alias(h) for a, h in zip(AXES, HIGH, strict=True)])
    wide = ray_cells(rays, box, size)
    for a in AXES:
        wide = wide.withColumn(f"cell_{a}", F.explode(F.sequence(F.col(f"cell_{a}") - 1, F.col(f"cell_{a}") + 1)))
    met = wide.dropDuplicates(["ray_id", *[f"cell_{a}" for a in AXES]]).join(point_cells, [f"cell_{a}" for a in AXES])
    o, d, p = [F.col(f"o{a}") for a in AXES], [F.col(f"d{a}") for a in AXES], [F.col(a) for a in AXES]
    to = [x - y for x, y in zip(p, o, strict=True)]
    along = geo.dot(to, d) / geo.dot(d, d)
    off = [t - along * x for t, x in zip(to, d, strict=True)]
    rows = met.select("ray_id", "point_id", along.alias("along"), geo.dot(off, off).alias("ray_square"), geo.dot(to, to).alias("camera_square")).where((F.col("along") >= 0) & (F.col("ray_square") <= reach * reach))
    best = F.min(F.struct(snap_score(F.col("ray_square"), F.col("camera_square")).alias("score"), "point_id")).alias("b")
    return rows.groupBy("ray_id").agg(best).select("ray_id", "b.point_id", "b.score")


def world_hits(found: DataFrame, scale: float) -> DataFrame:
    """Distances of hits in the units of the world."""
    return found.withColumn("distance", F.col("distance") * float(scale))


