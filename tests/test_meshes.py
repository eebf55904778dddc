"""Kernels by areas and volumes; shells, rays and sections as DataFrames; models as tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from girder.functions import mesh_kernels as mk
from girder.operators import meshes, spatial
from girder.sources import models


def area(points, triangles):
    return sum(np.linalg.norm(np.cross(points[b] - points[a], points[c] - points[a])) / 2 for a, b, c in triangles)


def test_triangulation_keeps_areas():
    ring = np.array([[0, 0, 1], [4, 0, 1], [4, 4, 1], [0, 4, 1], [1, 1, 1], [1, 3, 1], [3, 3, 1], [3, 1, 1]], float)
    assert math.isclose(area(ring, mk.triangulate(ring, [0, 1, 2, 3], [[4, 5, 6, 7]])), 12.0)
    assert math.isclose(area(ring, mk.triangulate(ring, [0, 1, 2, 3], [[7, 6, 5, 4]])), 12.0)
    comb = np.array([[0, 0, 0], [5, 0, 0], [5, 3, 0], [4, 1, 0], [3, 3, 0], [2, 1, 0], [1, 3, 0], [0, 1, 0]], float)
    assert math.isclose(area(comb, mk.triangulate(comb, list(range(8)))), abs(mk.newell(comb)[2]) / 2)
    assert mk.triangulate(comb, [0, 1]) == []


def test_solids():
    for points, triangles, want in ((*mk.box((0, 0, 0), (2, 3, 4)), 24), (*mk.wall(), 0.3), (*mk.extrude(np.array([[0, 0, 0], [0, 1, 0], [1, 0, 0]], float), (0, 0, 1), 2.0), 1.0)):
        assert math.isclose(abs(mk.volume(points, triangles)), want)
    assert len(mk.revolve(np.array([[1, 0, 0], [1, 0, 1]], float))[1]) == 24
    assert np.allclose(np.linalg.norm(mk.arc(), axis=1), 1) and np.allclose(mk.parabola()[[0, -1], 1], [2, 27])
    centre, radius, angle = mk.circle_through((1, 0, 0), (0, 1, 0), (0, -1, 0))
    assert np.allclose(centre, 0) and math.isclose(radius, 1) and math.isclose(angle, 1.5 * math.pi)


def test_contours():
    square = [[[0, 0], [1, 0]], [[1, 1], [1, 0]], [[1, 1], [0, 1]], [[0, 1], [0, 0]], [[5, 5], [6, 5]], [[7, 7], [7, 7]]]
    found = mk.stitch(np.array(square, float))
    assert sorted((len(c), closed) for c, closed in found) == [(2, False), (4, True)]


def test_shells_rays_sections(spark):
    low, high = (0.0, 0.0, 0.0), (2.0, 3.0, 4.0)
    corners = [{"x": (low, high)[k & 1][0], "y": (low, high)[k >> 1 & 1][1], "z": (low, high)[k >> 2][2]} for k in range(8)]
    profiles = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]
    shells = spark.createDataFrame([(1, corners, profiles, [])], "repr_id long, points array<struct<x:double,y:double,z:double>>, profiles array<array<int>>, holes array<struct<profile_id:int,idx:array<int>>>")
    triangles = meshes.triangles_of_shells(shells)
    assert triangles.count() == 12 and [round(r.volume, 9) for r in spatial.volumes(triangles, "repr_id").collect()] == [24.0]
    hits = sorted(round(r.distance, 9) for r in meshes.ray_hits(triangles, (-1.0, 1.1, 1.0), (1.0, 0.0, 0.0)).collect())
    assert hits == [1.0, 3.0]
    contour = meshes.section_contours(spatial.section(triangles, (0.0, 0.0, 1.0, -1.0)), "repr_id", ("x", "y")).collect()
    assert [(r.closed, round(r.area, 3)) for r in contour] == [(True, 6.0)]
    twice = triangles.unionByName(triangles.withColumn("repr_id", F.lit(2).cast("long")))
    assert meshes.geometry_keys(twice).select("shape").distinct().count() == 1


def test_models(spark, tmp_path):
    model = models.new_model(spark, "m")
    items = spark.createDataFrame([("m", 1, 0, "A", None), ("m", 2, 1, "B", "g")], models.SCHEMAS["items"])
    relations = spark.createDataFrame([("m", 1, "R", 0, [2, 9]), ("m", 2, "R", 0, [9])], models.SCHEMAS["relations"])
    full = models.ModelTables(model.tables | {"items": items, "relations": relations})
    part = models.subset(full, items.select("model_id", "local_id"))
    assert [(r.src_id, r.dst_ids) for r in part["relations"].collect()] == [(1, [2])]
    full.write(str(tmp_path))
    assert models.read(spark, str(tmp_path))["items"].count() == 2
    both = full["models"].unionByName(spark.createDataFrame([("n", "g", '{"crs":{"a":1}}', 1, 3.0, 0.0, 0.0)], models.SCHEMAS["models"]))
    assert {r.model_id: r.dx for r in models.aligned(both, "m").collect()} == {"m": 0.0, "n": -3.0}
    assert {r.model_id: r.crs for r in models.coordinate_system(both).collect()} == {"m": None, "n": '{"a":1}'}


def squares(spark, keys, kind):
    sides = [((0, 0), (1, 0)), ((1, 1), (1, 0)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]
    point = lambda p, n: {"x": p[0] * float(n), "y": p[1] * float(n), "z": 0.0}
    rows = [(k, point(p, n + 1), point(q, n + 1)) for p, q in sides for n, k in enumerate(keys)]
    return spark.createDataFrame(rows, f"k {kind}, p struct<x:double,y:double,z:double>, q struct<x:double,y:double,z:double>")


def test_contours_of_keys_that_batches_cut(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for keys, kind in ((list(range(20)), "long"), (["a", None, "b"], "string")):
            found = meshes.section_contours(squares(spark, keys, kind), "k", ("x", "y"))
            assert {r.k: (r.closed, len(r.points), round(r.area, 3)) for r in found.collect()} == {k: (True, 4, float((n + 1) ** 2)) for n, k in enumerate(keys)}
            assert found.count() == len(keys)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # a call for each key


def test_shells_of_one_file_are_dealt_to_many_tasks(spark):
    corners = [{"x": float(x), "y": float(y), "z": 0.0} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (1, 1), (3, 1), (3, 3), (1, 3))]
    kind = "repr_id long, points array<struct<x:double,y:double,z:double>>, profiles array<array<int>>, holes array<struct<profile_id:int,idx:array<int>>>"
    rows = [(k, corners, [[0, 1, 2, 3]], [(0, [4, 5, 6, 7])] if k % 2 else None) for k in range(50)] + [(50, [], [], None)]
    t = meshes.triangles_of_shells(spark.createDataFrame(rows, kind).coalesce(1))
    area = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("c.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))) / 2
    assert {r.repr_id: r.area for r in t.groupBy("repr_id").agg(F.round(F.sum(area), 6).alias("area")).collect()} == {k: 12.0 if k % 2 else 16.0 for k in range(50)}
    assert t.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4
