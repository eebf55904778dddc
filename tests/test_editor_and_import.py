"""Edit batches, packing into files, STEP arguments, rays in cells and trees as text, against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from girder.operators import catalog, editor, ifc, importer, raycast, spatial
from girder.sources import step_text as step


def requests(spark, rows):
    names = editor.NAMES
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], editor.REQUEST)


def tables(spark):
    return {
        "ITEM": spark.createDataFrame([(1, 0.0), (2, 0.0)], "local_id long, value double"),
        "MATERIAL": spark.createDataFrame([(5, 0.0)], "local_id long, value double"),
        "REPRESENTATION": spark.createDataFrame([(6, 0.0)], "local_id long, value double"),
        "SAMPLE": spark.createDataFrame([(10, 1, 6, 5), (11, 2, 6, 5)], "local_id long, item_id long, repr_id long, material_id long"),
    }


def test_batch_with_temporary_ids(spark):
    asked = [
        {"seq": 1, "type": "CREATE_ITEM", "temp_id": "a", "value": 2.0},
        {"seq": 2, "type": "CREATE_SAMPLE", "temp_id": "s", "item_temp": "a", "repr_id": 6, "material_id": 5},
        {"seq": 3, "type": "DELETE_SAMPLE", "local_id": 10},
    ]
    solved = editor.solve_ids(requests(spark, asked), 100)
    after = editor.apply_batch(tables(spark), solved)
    assert {tuple(r) for r in after["SAMPLE"].collect()} == {(11, 2, 6, 5), (101, 100, 6, 5)}
    assert {r.local_id for r in after["ITEM"].collect()} == {1, 2, 100}
    assert {r.item_id for r in editor.affected_items(tables(spark)["SAMPLE"], solved).collect()} == {1}


def test_allocated_ids_do_not_meet_those_in_use(spark, tmp_path):
    """next_id lies below ids in use: what is created is beside what had its number."""
    asked = [
        {"seq": 1, "type": "CREATE_ITEM", "temp_id": "a", "value": 2.0},
        {"seq": 2, "type": "CREATE_SAMPLE", "temp_id": "s", "item_temp": "a", "repr_id": 6, "material_id": 5},
        {"seq": 3, "type": "DELETE_SAMPLE", "local_id": 10},
        {"seq": 4, "type": "UPDATE_ITEM", "local_id": 2, "value": 9.0},
        {"seq": 5, "type": "UPDATE_SAMPLE", "temp_id": "s", "item_temp": "a", "repr_id": 6, "material_id": 5},
    ]
    solved = editor.solve_ids(requests(spark, asked), 10)  # item 10, sample 11
    base = tables(spark) | {"ITEM": spark.createDataFrame([(1, 0.0), (2, 0.0), (10, 0.0)], "local_id long, value double")}
    after = editor.apply_batch(base, solved)
    assert sorted(map(tuple, after["SAMPLE"].collect())) == [(11, 2, 6, 5), (11, 10, 6, 5)]
    assert sorted(map(tuple, after["ITEM"].collect())) == [(1, 0.0), (2, 9.0), (10, 0.0), (10, 2.0)]
    assert sorted(map(tuple, editor.delta({**base, "SAMPLE": base["SAMPLE"].where("local_id = 11")}, solved)["SAMPLE"].collect())) == [(11, 2, 6, 5), (11, 10, 6, 5)]
    late = requests(spark, [{"seq": 1, "type": "CREATE_ITEM", "temp_id": "a"}, {"seq": 2, "type": "DELETE_SAMPLE", "local_id": 10}, {"seq": 3, "type": "UPDATE_ITEM", "local_id": 2}])
    assert editor.affected_items(base["SAMPLE"], solved).collect() == [(1,)]
    assert editor.save(base, editor.solve_ids(late, 3), str(tmp_path / "saved"), 2) == 3


def test_what_is_missing_is_an_error(spark):
    with pytest.raises(Exception, match="unknown temporary id"):
        editor.solve_ids(requests(spark, [{"seq": 1, "type": "CREATE_SAMPLE", "temp_id": "s", "item_temp": "nobody"}]), 100).collect()
    gone = requests(spark, [{"seq": 1, "type": "DELETE_MATERIAL", "local_id": 5}])
    with pytest.raises(Exception, match="material 5 of sample"):
        editor.apply_batch(tables(spark), gone)["SAMPLE"].collect()


@pytest.mark.parametrize("seed", range(4))
def test_packing_phases_follow_the_greedy_rule(seed):
    dice = random.Random(seed)
    sizes = sorted((dice.choice([1, 1, 1, 2, 3, 7, 50]) for _ in range(dice.randrange(1, 200))), reverse=True)
    groups = dice.randrange(1, 7)
    loads, want = [(0, g) for g in range(groups)], []
    for n in sizes:
        load, g = heapq.heappop(loads)
        want.append(g)
        heapq.heappush(loads, (load + n, g))
    counts = [(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)]
    got = [order[k % len(order)] for _, start, stop, order in ifc._phases(counts, groups) for k in range(stop - start)]
    assert got == want


def test_arguments_as_in_python(spark):
    texts = ["", "$", "'a,b',(#1,(#2,#3)),.T.", "'it''s (x', ( 1 ,2),", "IFCLABEL('a;b'),$,*", "((1.,2.),(3.,4.)),'('", " #5 ", None, ",,"]
    got = step.with_arguments(spark.createDataFrame([(t,) for t in texts], "args string"))
    assert [(r.args, r.each) for r in got.collect()] == [(t, step.split_arguments(t)) for t in texts]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_statements_with_either_line_end(spark, tmp_path, end):
    lines = ["ISO-10303-21;", "HEADER;", "ENDSEC;", "DATA;", "#1=IFCWALL('a;b',", "$);", "#2 = IFCDOOR(#1);", "ENDSEC;", "END-ISO-10303-21;", ""]
    (tmp_path / "m.ifc").write_bytes(end.join(lines).encode())
    found = step.parsed(step.statements(spark, str(tmp_path / "m.ifc"))).select("id", "type", "args", "refs").collect()
    assert sorted(map(tuple, found)) == [(1, "IFCWALL", "'a;b', $", []), (2, "IFCDOOR", "#1", [1])]


def test_rays_meet_all_boxes_that_they_enter(spark):
    dice = random.Random(2)
    boxes = [(k, *[x for x in p], *[x + dice.uniform(0.1, 9) for x in p]) for k in range(120) for p in [[dice.uniform(-30, 30) for _ in range(3)]]]
    rays = [(k, *[dice.uniform(-40, 40) for _ in range(3)], *dice.choice([[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [dice.uniform(-1, 1) for _ in range(3)]])) for k in range(40)]
    want = set()
    for r, ox, oy, oz, dx, dy, dz in rays:
        for b, *sides in boxes:
            near, far, inside = 0.0, float("inf"), True
            for o, d, low, high in zip((ox, oy, oz), (dx, dy, dz), sides[:3], sides[3:], strict=True):
                if d == 0:
                    inside &= low <= o <= high
                else:
                    near, far = max(near, min((low - o) / d, (high - o) / d)), min(far, max((low - o) / d, (high - o) / d))
            if inside and near <= far:
                want.add((r, b))
    frame = spark.createDataFrame(boxes, "sample_id long, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    asked = spark.createDataFrame(rays, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert {(r.ray_id, r.sample_id) for r in raycast.candidates(asked, frame, 7.0).collect()} == want


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_runs_and_their_complement(spark, block):
    dice = random.Random(block)
    marked = sorted({dice.randrange(60) for _ in range(35)})
    rows = spark.createDataFrame([("t", p) for p in marked], "tile string, pos long")
    runs = spatial.runs(rows, "tile", block=block)
    assert sorted(p for r in runs.collect() for p in range(r.start, r.start + r.size)) == marked
    assert all(r.start - 1 not in marked and r.start + r.size not in marked for r in runs.collect())
    rest = spatial.complement(runs, spark.createDataFrame([("t", 60), ("none", 3)], "tile string, total long"), "tile", block=block)
    assert sorted((r.tile, p) for r in rest.collect() for p in range(r.start, r.start + r.size)) == sorted([("t", p) for p in range(60) if p not in marked] + [("none", p) for p in range(3)])


def test_tree_as_text(spark):
    nodes = spark.createDataFrame([(1, None, 0, 7, None), (2, 1, 1, None, "B"), (3, 1, 0, None, "A"), (4, 3, 0, 9, None)], "node_id long, parent_node_id long, ord long, local_id long, category string")
    (row,) = catalog.tree_json(nodes).collect()
    assert row.json == '{"localId":7,"children":[{"category":"A","children":[{"localId":9,"children":[]}]},{"category":"B","children":[]}]}'


def test_nodes_reached_twice_are_taken_once(spark):
    edges = spark.createDataFrame([(1, "IsDecomposedBy", 2), (1, "ContainsElements", 3), (2, "ContainsElements", 3), (3, "IsNestedBy", 1)], "src_id long, name string, dst_id long")
    kinds = spark.createDataFrame([(1, "P"), (2, "S"), (3, "W")], "local_id long, category string")
    found = importer.spatial_nodes(edges, kinds.where(F.col("local_id") == 1), kinds)
    assert {(r.local_id, r.parent_node_id) for r in found.where("local_id IS NOT NULL").collect()} == {(1, "root/P"), (2, "1/S"), (3, "1/W")}


def test_arguments_of_relations_are_split_once(spark):
    lines = ["#1=IFCRELAGGREGATES('g',$,'a,(b',$,#5,(#6,#7))", "#2=IFCRELCONTAINEDINSPATIALSTRUCTURE('h',$,$,$,(#8,#9),#5)", "#3=IFCWALL('x',#1)", "#4=IFCRELNESTS('i',$,$,$,#5,())"]
    parsed = step.parsed(spark.createDataFrame([(s,) for s in lines], "statement string"))
    pairs = ifc.relation_pairs(parsed, step.with_arguments)
    assert sorted(map(tuple, pairs.collect())) == [("IFCRELAGGREGATES", 5, 6), ("IFCRELAGGREGATES", 5, 7), ("IFCRELCONTAINEDINSPATIALSTRUCTURE", 5, 8), ("IFCRELCONTAINEDINSPATIALSTRUCTURE", 5, 9)]
    found = ifc.relations(pairs)
    assert found.count() == 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 3  # the generator, and the filter that is inferred from it


def test_exact_hits_send_no_side_to_the_driver(spark):
    box = [(1, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0), (2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    shapes = spark.createDataFrame(box, "repr_id long, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    axes = {"gx": (1.0, 0.0, 0.0), "gy": (0.0, 1.0, 0.0), "lx": (1.0, 0.0, 0.0), "ly": (0.0, 1.0, 0.0), "lp": (0.0, 0.0, 0.0)}
    turns = {f"{k}{a}": F.lit(x) for k, v in axes.items() for a, x in zip("xyz", v, strict=True)}
    samples = spark.createDataFrame([(10, 1, 1), (11, 2, 2)], "sample_id long, item_id long, repr_id long").withColumns({k: v for k, v in turns.items() if k[0] == "l"})
    items = spark.createDataFrame([(1, 5.0, 0.0, 0.0), (2, 20.0, 0.0, 0.0)], "item_id long, gpx double, gpy double, gpz double").withColumns({k: v for k, v in turns.items() if k[0] == "g"})
    rays = spark.createDataFrame([(0, 0.0, 0.6, 0.7, 1.0, 0.0, 0.0), (1, 0.0, 1.6, 0.7, 1.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = raycast.hits(rays, raycast.placed_samples(samples, items, shapes), spatial.box_triangles(shapes), 4.0)
    assert sorted(tuple(r) for r in raycast.all_hits(found).collect()) == [(0, 10, 1, 5.0), (0, 11, 2, 20.0), (1, 10, 1, 5.0)]
    query = found._jdf.queryExecution()
    assert "Broadcast" not in query.executedPlan().toString()
    assert query.optimizedPlan().toString().count(" * ") < 100  # each product once, so the JVM compiles the step


def test_categories_are_found_without_a_broadcast(spark):
    items = spark.createDataFrame([(1, "A"), (2, "B")], "local_id long, category string")
    created = spark.createDataFrame([(2, "LATE"), (3, "C")], "local_id long, category string")
    asked = spark.createDataFrame([(0, 2), (1, 3), (2, 2), (3, 9), (4, None)], "pos long, local_id long")
    found = catalog.categories_of(asked, items, created)
    assert sorted((r.pos, r.category) for r in found.collect()) == [(0, "B"), (1, "C"), (2, "B"), (3, None), (4, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("Initial Plan")[-1]
