"""Registered queries: placed samples, rays, snapping, meshes and contours, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from girder.functions import geometry as geo
from girder.operators import meshes, raycast, spatial
from girder.plans.graded import boxes, graded
from girder.plans.model_sql import BOXES, HITS, PLACED, RAYS, TRANSFORMS
from girder.sources import star_schema as star

CELL = 16.0


def placed(spark, d):
    return raycast.placed_samples(star.placed_samples(spark, d), star.placed_items(spark, d), star.representations(spark, d))


def hits(spark, d):
    triangles = spatial.box_triangles(star.representations(spark, d))
    return raycast.hits(star.rays(spark, d), placed(spark, d), triangles, CELL)


_MIDDLE = "c * size / 2 - s * size / 4 + tx", "s * size / 2 + c * size / 4 + ty"
_HALF = "abs(c) * size / 2 + abs(s) * size / 4", "abs(s) * size / 2 + abs(c) * size / 4"


@graded(f"""WITH {PLACED} SELECT sample_id, item_id, round({_MIDDLE[0]} - ({_HALF[0]}), 4) AS minx, round({_MIDDLE[1]} - ({_HALF[1]}), 4) AS miny, CAST(0 AS DOUBLE) AS minz,
  round({_MIDDLE[0]} + {_HALF[0]}, 4) AS maxx, round({_MIDDLE[1]} + {_HALF[1]}, 4) AS maxy, CAST(1 AS DOUBLE) AS maxz FROM placed""")
def placed_boxes(spark, d):
    found = raycast.placed_boxes(placed(spark, d))
    return found.select("sample_id", "item_id", *[F.round(c, 4).alias(c) for c in spatial.LOW + spatial.HIGH])


@graded(f"WITH {PLACED} SELECT item_id, round(min({_MIDDLE[0]} - ({_HALF[0]})), 4) AS minx, round(max({_MIDDLE[0]} + {_HALF[0]}), 4) AS maxx, round(min({_MIDDLE[1]} - ({_HALF[1]})), 4) AS miny, round(max({_MIDDLE[1]} + {_HALF[1]}), 4) AS maxy FROM placed GROUP BY item_id")
def placed_item_boxes(spark, d):
    found = spatial.merged(raycast.placed_boxes(placed(spark, d)), "item_id")
    return found.select("item_id", *[F.round(c, 4).alias(c) for c in ("minx", "maxx", "miny", "maxy")])


@graded(f"WITH {HITS} SELECT ray_id, sample_id, item_id, round(distance, 4) AS distance FROM hits")
def raycast_all(spark, d):
    found = raycast.all_hits(hits(spark, d))
    return found.select("ray_id", "sample_id", "item_id", F.round("distance", 4).alias("distance"))


@graded(f"WITH {HITS} SELECT ray_id, round(min(distance), 4) AS distance FROM hits GROUP BY ray_id")
def raycast_nearest(spark, d):
    return raycast.nearest_hits(hits(spark, d)).select("ray_id", F.round("distance", 4).alias("distance"))


@graded(f"WITH {HITS} SELECT ray_id, round(min(distance) * 0.3048, 4) AS distance FROM hits JOIN orders ON o_orderkey = item_id WHERE o_orderstatus <> 'F' GROUP BY ray_id")
def raycast_visible(spark, d):
    hidden = star.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    nearest = raycast.nearest_hits(raycast.visible_only(hits(spark, d), hidden))
    return raycast.world_hits(nearest, 0.3048).select("ray_id", F.round("distance", 4).alias("distance"))


_CLIP = ((1.0, 0.0, 0.0, -20.0), (-0.6, 0.8, 0.0, 30.0), (0.0, 1.0, 0.0, float("inf")))


@graded(f"WITH {TRANSFORMS} SELECT item_id FROM transforms WHERE gx - 20 >= 0 AND -0.6 * gx + 0.8 * gy + 30 >= 0")
def points_in_planes(spark, d):
    points = star.global_transforms(spark, d)
    return points.where(raycast.contained([F.col("gx"), F.col("gy"), F.col("gz")], _CLIP)).select("item_id")


@graded(f"""WITH {TRANSFORMS}, {RAYS}, t AS (SELECT ray_id, item_id, gx - ox AS x, gy - oy AS y, gz - oz AS z, dx, dy, dz FROM rays, transforms),
  a AS (SELECT *, (x * dx + y * dy + z * dz) / (dx * dx + dy * dy + dz * dz) AS along FROM t),
  o AS (SELECT ray_id, item_id, pow(x - along * dx, 2) + pow(y - along * dy, 2) + pow(z - along * dz, 2) AS ray, x * x + y * y + z * z AS camera FROM a WHERE along >= 0)
  SELECT ray_id, round(min(32 * ray + camera), 4) AS score FROM o WHERE ray <= 0.25 GROUP BY ray_id""")
def snap_to_points(spark, d):
    points = star.global_transforms(spark, d).select(F.col("item_id").alias("point_id"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"))
    return raycast.snap_points(star.rays(spark, d), points, 0.5).select("ray_id", F.round("score", 4).alias("score"))


# ---- sections -------------------------------------------------------------------------------------------------------


@graded("SELECT p_partkey AS repr_id, true AS closed, round(p_size * (p_size / 2.0), 3) AS area FROM part")
def section_contours(spark, d):
    cut = spatial.section(spatial.box_triangles(star.representations(spark, d)), (0.0, 0.0, 1.0, -0.5))
    return meshes.section_contours(cut, "repr_id", ("x", "y")).select("repr_id", "closed", F.round("area", 3).alias("area"))


@graded(f"""WITH {BOXES}, h AS (SELECT item_id, repr_id, 0.6 * minx - 0.8 * miny AS base, 0.6 * (maxx - minx) AS a, 0.8 * (maxy - miny) AS b FROM boxes)
  SELECT item_id, count(*) AS n FROM h JOIN orders ON o_orderkey = item_id WHERE base - b - 3.0137 < 0 AND base + a - 3.0137 >= 0 AND o_orderpriority NOT LIKE '5%' GROUP BY item_id""")
def section_without_spaces(spark, d):
    """An oblique plane, without the items of one category: how many drawn boxes of each item it cuts."""
    spaces = star.read(spark, d, "orders").where("o_orderpriority LIKE '5%'").select(F.col("o_orderkey").alias("item_id"))
    solid = boxes(spark, d).join(spaces, "item_id", "left_anti")
    plane = (0.6, -0.8, 0.0, -3.0137)
    near = solid.where(geo.box_meets(spatial.low(), spatial.high(), [plane]) & geo.box_meets(spatial.low(), spatial.high(), [tuple(-x for x in plane)]))
    numbered = near.withColumn("box", F.struct("repr_id", "material", *spatial.LOW, F.monotonically_increasing_id().alias("k")))
    cut = spatial.section(spatial.box_triangles(numbered), plane)
    return cut.groupBy("item_id").agg(F.countDistinct("box").alias("n"))


# ---- meshes ---------------------------------------------------------------------------------------------------------

_QUADS = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))


def shells(spark, d):
    """Each part as a box of six faces; the top has a square hole of a quarter of its width."""
    s = F.col("p_size").cast("double")

    def point(x, y, z):
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    zero, one = F.lit(0.0), F.lit(1.0)
    corners = [point(s if k & 1 else zero, s / 2 if k & 2 else zero, one if k & 4 else zero) for k in range(8)]
    hole = [point(s * x, s * y, one) for x, y in ((0.25, 0.125), (0.5, 0.125), (0.5, 0.375), (0.25, 0.375))]
    holes = F.array(F.struct(F.lit(1).alias("profile_id"), F.array(*[F.lit(k) for k in (8, 9, 10, 11)]).alias("idx")))
    profiles = F.array(*[F.array(*[F.lit(k) for k in q]) for q in _QUADS])
    return star.read(spark, d, "part").select(F.col("p_partkey").alias("repr_id"), F.array(*corners, *hole).alias("points"), profiles.alias("profiles"), holes.alias("holes"))


@graded("""SELECT p_partkey AS repr_id, f AS face, round(CASE f WHEN 0 THEN s * s / 2 WHEN 1 THEN s * s / 2 - s * s / 16 WHEN 2 THEN s WHEN 3 THEN s ELSE s / 2 END, 3) AS area
  FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, unnest([0, 1, 2, 3, 4, 5]) AS f FROM part)""")
def shell_triangles(spark, d):
    t = meshes.triangles_of_shells(shells(spark, d))
    a, b, c = ([F.col(f"{p}.{x}") for x in "xyz"] for p in "abc")
    n = geo.cross([y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)])
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    return t.groupBy("repr_id", "face").agg(F.round(F.sum(area), 3).alias("area"))


@graded("SELECT p_partkey AS repr_id, min(p_partkey) OVER (PARTITION BY p_size) AS keeper FROM part")
def geometry_shapes(spark, d):
    """Equal shapes by their triangles: counts, areas, volume and centre."""
    keys = meshes.geometry_keys(spatial.box_triangles(star.representations(spark, d)))
    return spatial.duplicates(keys, "shape", row_id="repr_id")


@graded("""WITH l AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS sample_id, min(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS lx, l_linenumber AS ln FROM lineitem)
  SELECT sample_id, min(sample_id) OVER (PARTITION BY round(lx, 3), ln) AS keeper FROM l""")
def transform_dedup(spark, d):
    """Samples with equal local placements share the first one's."""
    names = [f"l{c}" for c in raycast.POINT + raycast.ACROSS + raycast.UP]
    rounded = star.placed_samples(spark, d).select("sample_id", *[F.round(c, 3).alias(c) for c in names])
    return spatial.duplicates(rounded, *names, row_id="sample_id")


@graded("SELECT p_partkey AS repr_id, CAST(floor(0.0) AS DOUBLE) AS minx, ceil(p_size / 3.0 * 10) / 10 AS maxx, ceil(p_size / 6.0 * 10) / 10 AS maxy FROM part")
def vertex_boxes(spark, d):
    """Boxes of vertices, widened to tenths."""
    third = star.representations(spark, d).select("repr_id", *[(F.col(c) / 3).alias(c) for c in spatial.LOW + spatial.HIGH])
    found = spatial.vertex_boxes(spatial.box_triangles(third), "repr_id", 0.1)
    return found.select("repr_id", *[F.round(c, 4).alias(c) for c in ("minx", "maxx", "maxy")])
