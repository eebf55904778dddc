"""Replayed and committed logs, ids, closures on cycles, trees, clusters, packing, STEP text, state, streams."""

import pytest
from pyspark.sql import functions as F

from girder.operators import edits, ifc, spatial, state
from girder.operators import traversal as tr
from girder.sources import step_text
from girder.streaming import edit_stream


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "UPDATE_ITEM", 1, 10.0), (2, "DELETE_ITEM", 2, None), (3, "CREATE_ITEM", 2, 22.0), (4, "CREATE_ITEM", 9, 90.0), (5, "UPDATE_ITEM", 9, 91.0), (6, "DELETE_ITEM", 3, None), (7, "CREATE_ITEM", 1, 77.0), (8, "UPDATE_RELATION", 1, 5.0)]
    return spark.createDataFrame(rows, "seq long, type string, local_id long, value double")


def test_read_and_commit_differ_as_documented(spark, log):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "local_id long, value double")
    read = {r.local_id: r.value for r in edits.read_overlay(base, log, "ITEM", "value").collect()}
    assert read == {1: 77.0, 2: 22.0, 4: None, 9: 91.0}
    saved = {r.local_id: r.value for r in edits.commit(base, log, "ITEM", "value").collect()}
    assert saved == {1: 10.0, 4: None, 9: 91.0}
    assert {r.local_id for r in edits.overlay_ids(base, edits.select(log, 2), "ITEM").collect()} == {1, 3, 4}


def test_ids_are_consecutive(spark):
    asked = spark.createDataFrame([(k * k, f"t{k}", 500 if k == 3 else None) for k in range(50)], "seq long, temp_id string, local_id long")
    got = [r.local_id for r in edits.allocate(asked, 100, blocks=7).orderBy("seq").collect()]
    assert got[3] == 500 and [x for x in got if x != 500] == list(range(100, 149))


def test_closure_on_a_cycle_with_boundary(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)], "a long, b long")
    start = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.depth) for r in tr.closure(start, edges).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    stop = spark.createDataFrame([(4,), (1,)], "id long")
    assert {r.id for r in tr.closure(start, edges, stop).collect()} == {1, 2, 3, 4}


def test_item_data_follows_the_configuration(spark):
    edges = spark.createDataFrame([(1, "IsDefinedBy", 5), (5, "DefinesOccurrence", 1), (5, "HasProperties", 6), (6, "Deeper", 7)], "src_id long, name string, dst_id long")
    config = tr.DataConfig({"IsDefinedBy": tr.Expansion(True, True), "DefinesOccurrence": tr.Expansion(False, False)})
    got = {(r.local_id, r.depth) for r in tr.item_data(edges, spark.createDataFrame([(1,)], "local_id long"), config).collect()}
    assert got == {(1, 0), (5, 1), (6, 2)}


def test_descendants_and_clusters(spark):
    nodes = spark.createDataFrame([(1, None, 10), (2, 1, None), (3, 2, 30), (4, 3, 40), (5, 1, 50)], "node_id long, parent_node_id long, local_id long")
    assert {r.local_id for r in tr.descendants(nodes, spark.createDataFrame([(10,), (30,)], "local_id long")).collect()} == {30, 40, 50}
    links = spark.createDataFrame([(k, k + 1) for k in range(20, 40)], "a long, b long")
    got = {r.id: r.cluster for r in tr.clusters(spark.createDataFrame([(99,)], "id long"), links).collect()}
    assert got == {k: 20 for k in range(20, 41)} | {99: 99}


@pytest.mark.parametrize("n", [1, 32, 33, 64, 100])
def test_pack(spark, n):
    each = spark.createDataFrame([(k, k) for k in range(n)], "id long, cluster long")
    assert sorted(r.group_id for r in ifc.pack(each, n).collect()) == list(range(n))


@pytest.mark.parametrize("n", [0, -1, 1.5, float("nan"), True])
def test_pack_refuses(spark, n):
    with pytest.raises(ValueError):
        ifc.pack(spark.createDataFrame([(1, 1)], "id long, cluster long"), n)


def test_step_text(spark, tmp_path):
    (tmp_path / "a.ifc").write_text("ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n#1=IFCWALL('it''s #9, ok',#2,(#3,#4),$);\n#2 = IFCX(\n #1,#2);\nENDSEC;\n")
    rows = {r.id: r for r in step_text.parsed(step_text.statements(spark, str(tmp_path / "a.ifc"))).collect()}
    assert set(rows) == {1, 2} and rows[1].refs == [9, 2, 3, 4] and rows[2].refs == [1]
    assert step_text.split_arguments(rows[1].args) == ["'it''s #9, ok'", "#2", "(#3,#4)", "$"]
    assert step_text.split_arguments("a,,b,") == ["a", "", "b"] and step_text.split_arguments(None) == []


def test_state(spark):
    config = spark.createDataFrame([(1, True), (2, False), (3, True)], "item_id long, visible boolean")
    two = spark.createDataFrame([(1,), (1,), (2,)], "item_id long")
    assert {r.item_id for r in state.by_visibility(state.set_visible(config, two, None), True).collect()} == {2, 3}
    assert state.by_visibility(state.set_visible(config, None, False), False).count() == 3
    past = spark.createDataFrame([(1, "red", 0.5, True, 1)], "item_id long, color string, opacity double, transparent boolean, rendered_faces int")
    lit = state.highlight(config, two, past, color="blue")
    assert {(r.item_id, r.color, r.opacity) for r in lit.collect()} == {(1, "blue", 0.5), (2, "blue", None)}
    assert {r.highlight_id for r in state.materials(lit).collect()} == {0, 1}


def test_boxes_volume_section(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 3.0, 4.0)], "item_id long, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    triangles = spatial.box_triangles(box)
    assert [round(r.volume, 9) for r in spatial.volumes(triangles).collect()] == [24.0]
    assert spatial.section(triangles, (0.0, 0.0, 1.0, -1.0)).count() == 8
    assert spatial.merged(box.limit(0)).first().minx == float("inf")


def test_stream_keeps_the_latest_state(spark, tmp_path):
    for k in range(3):
        rows = [(10 * k + j, f"2024-01-01 0{k}:00:00", "UPDATE_ITEM", j % 4, float(10 * k + j)) for j in range(6)]
        spark.createDataFrame(rows, "seq long, ts string, type string, local_id long, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = edit_stream.read_log(spark, f"{tmp_path}/log")
    running = stream.writeStream.foreachBatch(edit_stream.upsert(f"{tmp_path}/state")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    running.awaitTermination(120)
    last = sorted((tmp_path / "state").iterdir(), key=lambda p: int(p.name.split("=")[1]))[-1]
    assert {r.local_id: r.value for r in spark.read.parquet(str(last)).collect()} == {0: 24.0, 1: 25.0, 2: 22.0, 3: 23.0}
