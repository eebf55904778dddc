"""Boxes of samples and items, spatial filters, nearest hits, volumes, sections, draw chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = ("minx", "miny", "minz"), ("maxx", "maxy", "maxz")
#: The faces of a box as triangles over its corners (bits x, y, z), outward.
BOX_TRIANGLES = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))


def low() -> list[Column]:
    return [F.col(c) for c in LOW]


def high() -> list[Column]:
    return [F.col(c) for c in HIGH]


def sample_boxes(samples: DataFrame, transforms: DataFrame, representations: DataFrame) -> DataFrame:
    """Samples with their boxes in the model: translations of the item and of the sample applied."""
    joined = samples.join(transforms, "item_id").join(representations, "repr_id")
    move = [F.col(f"g{a}") + F.col(f"l{a}") for a in "xyz"]
    return joined.select("item_id", "repr_id", "material", *[(F.col(c) + m).alias(c) for c, m in zip(LOW + HIGH, move + move, strict=True)])


def merged(boxes: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of each key; without rows, the empty box (+inf, -inf)."""
    grouped = boxes.groupBy(*keys) if keys else boxes
    inf = float("inf")
    low_ = [F.coalesce(F.min(c), F.lit(inf)).alias(c) for c in LOW]
    return grouped.agg(*low_, *[F.coalesce(F.max(c), F.lit(-inf)).alias(c) for c in HIGH])


def nearest(hits: DataFrame, distance: str, *tie: str) -> DataFrame:
    """The hit of the least distance; ties go to the first by ``tie``. One row, by one aggregation."""
    everything = F.struct(F.col(distance), *[F.col(t) for t in tie], *[F.col(c) for c in hits.columns if c not in (distance, *tie)])
    return hits.where(F.col(distance).isNotNull()).agg(F.min(everything).alias("h")).where("h IS NOT NULL").select("h.*")


def box_triangles(boxes: DataFrame) -> DataFrame:
    """The twelve triangles of each box: a, b, c as structs of x, y, z, with the other columns.

    A small constant table of corners is exploded; coordinates are picked from the sides afterwards.
    """
    faces = F.array(*[F.struct(*[F.lit(bool(k >> i & 1)).alias(f"{p}{x}") for p, k in zip("abc", t, strict=True) for i, x in enumerate("xyz")]) for t in BOX_TRIANGLES])
    picked = {p: F.struct(*[F.when(F.col(f"t.{p}{x}"), F.col(h)).otherwise(F.col(l)).alias(x) for x, l, h in zip("xyz", LOW, HIGH, strict=True)]) for p in "abc"}
    return boxes.withColumn("t", F.explode(faces)).select(*boxes.columns, *[c.alias(p) for p, c in picked.items()])


def volumes(triangles: DataFrame, key: str = "item_id") -> DataFrame:
    """key, volume: the absolute sum of signed volumes of an item's triangles."""
    from girder.functions.geometry import signed_volume

    v = signed_volume(*[[F.col(f"{p}.{a}") for a in "xyz"] for p in "abc"])
    return triangles.groupBy(key).agg(F.abs(F.sum(v)).alias("volume"))


def section(triangles: DataFrame, plane: tuple[float, float, float, float]) -> DataFrame:
    """Segments p, q in which triangles cross the plane n x + c = 0 (n, c): those with exactly two crossed edges.

    An edge is crossed if one end is below the plane and the other is not, so a triangle that only touches it gives none.
    Triangles on one side go before any point is computed.
    """
    *normal, constant = (float(x) for x in plane)
    rest = [c for c in triangles.columns if c not in ("a", "b", "c")]

    def height(p: str) -> Column:
        return F.col(f"{p}.x") * normal[0] + F.col(f"{p}.y") * normal[1] + F.col(f"{p}.z") * normal[2] + constant

    rows = triangles.select("*", *[height(p).alias(f"h{p}") for p in "abc"])
    crossing = rows.where((F.least("ha", "hb", "hc") < 0) & (F.greatest("ha", "hb", "hc") >= 0))

    def point(p: str, q: str) -> Column:
        s = F.col(f"h{p}") / (F.col(f"h{p}") - F.col(f"h{q}"))
        return F.struct(*[(F.col(f"{p}.{x}") + (F.col(f"{q}.{x}") - F.col(f"{p}.{x}")) * s).alias(x) for x in "xyz"])

    # exactly two of the three edges are crossed: all but the one whose ends are on one side
    ab, bc = (F.col("ha") < 0) == (F.col("hb") < 0), (F.col("hb") < 0) == (F.col("hc") < 0)
    p = F.when(ab, point("b", "c")).otherwise(point("a", "b"))
    q = F.when(ab | bc, point("c", "a")).otherwise(point("b", "c"))
    return crossing.select(*rest, p.alias("p"), q.alias("q"))


def runs(rows: DataFrame, *keys: str, position: str = "pos", block: int = 1 << 16) -> DataFrame:
    """keys, start, size: stretches of consecutive positions, as draw calls want them.

    Positions are ranked within blocks, so that no task sees all of a key; only stretches that end at a border of
    blocks, two for each block at most, are put together afterwards.
    """
    rows = rows.select(*keys, F.col(position).cast("long").alias("pos")).distinct().withColumn("block", F.floor(F.col("pos") / block))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys, "block").orderBy("pos"))
    local = rows.withColumn("island", island).groupBy(*keys, "block", "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("size"))
    open_ = (F.pmod("start", F.lit(block)) == 0) | (F.pmod(F.col("start") + F.col("size"), F.lit(block)) == 0)
    whole = Window.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce(F.lag(F.col("start") + F.col("size")).over(whole) < F.col("start"), F.lit(True)).cast("long")
    border = local.where(open_).select(*keys, "start", "size", fresh.alias("fresh")).select(*keys, "start", "size", F.sum("fresh").over(whole).alias("run"))
    joined = border.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.sum("size").alias("size"))
    return local.where(~open_).select(*keys, "start", "size").unionByName(joined.select(*keys, "start", "size"))


def cells(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes with every grid cell that they touch, to join many queries by cell instead of with all boxes."""
    spans = [F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")) for a, b in zip(LOW, HIGH, strict=True)]
    out = boxes
    for name, span in zip(("cell_x", "cell_y", "cell_z"), spans, strict=True):
        out = out.withColumn(name, F.explode(span))
    return out


def duplicates(rows: DataFrame, *key: str, row_id: str) -> DataFrame:
    """row_id, keeper: every row with the smallest row that equals it in key."""
    first = rows.groupBy(*key).agg(F.min(row_id).alias("keeper"))
    return rows.join(first, list(key)).select(row_id, "keeper")


def elements(samples: DataFrame, transforms: DataFrame, representations: DataFrame) -> DataFrame:
    """item_id, parts: each item's samples with representation, material and boxes, in a fixed order."""
    joined = sample_boxes(samples, transforms, representations)
    return joined.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("repr_id", "material", *LOW, *HIGH))).alias("parts"))


def rectangle(boxes: DataFrame, planes, fully: bool = False) -> DataFrame:
    """item_id of items that a selection frustum touches with any box, or holds with all of them."""
    from girder.functions.geometry import box_meets

    hit = boxes.withColumn("hit", box_meets(low(), high(), planes, included=fully))
    return hit.groupBy("item_id").agg((F.min("hit") if fully else F.max("hit")).alias("hit")).where("hit").select("item_id")


def tiles(boxes: DataFrame, dimension: float) -> DataFrame:
    """Boxes with the tile they are drawn in: material, snapped centre and size class."""
    def snap(a: str, b: str) -> Column:
        middle = (F.col(a) + F.col(b)) / 2
        return middle - F.expr(f"(({a} + {b}) / 2) % {float(dimension)}")

    square = sum(((F.col(b) - F.col(a)) * (F.col(b) - F.col(a)) for a, b in list(zip(LOW, HIGH, strict=True))[1:]), (F.col(HIGH[0]) - F.col(LOW[0])) * (F.col(HIGH[0]) - F.col(LOW[0])))
    size = F.when(square > 4, "LARGE").when(square > 0.32, "MEDIUM").otherwise("SMALL")
    return boxes.select("*", *[snap(a, b).alias(f"tile_{x}") for a, b, x in zip(LOW, HIGH, "xyz", strict=True)], size.alias("size_class"))


def complement(runs_: DataFrame, total: DataFrame, *keys: str, block: int = 1 << 16) -> DataFrame:
    """keys, start, size of the stretches between runs(keys, start, size), from 0 to total(keys, total).

    What a stretch follows is found within blocks; the first one of a block takes the end of the block before that has
    any. One row for each block is ordered by key.
    """
    rows = runs_.select(*keys, "start", (F.col("start") + F.col("size")).alias("end"), F.floor(F.col("start") / block).alias("block"))
    ends = rows.groupBy(*keys, "block").agg(F.max("end").alias("block_end"))
    ends = ends.withColumn("earlier", F.lag("block_end").over(Window.partitionBy(*keys).orderBy("block"))).drop("block_end")
    before = F.lag("end").over(Window.partitionBy(*keys, "block").orderBy("start"))
    follows = rows.withColumn("before", before).join(ends, [*keys, "block"]).withColumn("from", F.coalesce("before", "earlier", F.lit(0)))
    between = follows.where("start > from").select(*keys, F.col("from").alias("start"), (F.col("start") - F.col("from")).alias("size"))
    last = total.join(rows.groupBy(*keys).agg(F.max("end").alias("end")), list(keys), "left").withColumn("end", F.coalesce("end", F.lit(0)))
    return between.unionByName(last.where("total > end").select(*keys, F.col("end").alias("start"), (F.col("total") - F.col("end")).alias("size")))


def vertex_boxes(triangles: DataFrame, key: str, precision: float | None = None) -> DataFrame:
    """key and the box of all vertices; with a precision, sides are moved outwards to multiples of it."""
    each = {a: [F.col(f"{p}.{a}") for p in "abc"] for a in "xyz"}
    low_ = [F.min(F.least(*each[a])) for a in "xyz"]
    high_ = [F.max(F.greatest(*each[a])) for a in "xyz"]
    if precision is not None:
        p = F.lit(float(precision))
        low_, high_ = [F.floor(F.round(c / p, 9)) * p for c in low_], [F.ceil(F.round(c / p, 9)) * p for c in high_]
    return triangles.groupBy(key).agg(*[c.alias(n) for c, n in zip(low_ + high_, LOW + HIGH, strict=True)])
