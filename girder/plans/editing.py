"""Registered queries: batches of edits over customers as items and orders as samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from girder.operators import edits, editor, traversal
from girder.plans.graded import graded, joined
from girder.sources import star_schema as star

NEXT = 1_000_000


def tables(spark, d) -> dict:
    """Customers are items, order priorities representations, order statuses (by code) materials, orders samples."""
    orders, customers = star.read(spark, d, "orders"), star.read(spark, d, "customer")
    material, shape = F.ascii("o_orderstatus").cast("long"), F.substring("o_orderpriority", 1, 1).cast("long")
    none = F.lit(0.0).alias("value")
    return {
        "ITEM": customers.select(F.col("c_custkey").alias("local_id"), F.col("c_acctbal").alias("value")),
        "MATERIAL": orders.select(material.alias("local_id"), none).distinct(),
        "REPRESENTATION": orders.select(shape.alias("local_id"), none).distinct(),
        "SAMPLE": orders.select(F.col("o_orderkey").alias("local_id"), F.col("o_custkey").alias("item_id"), shape.alias("repr_id"), material.alias("material_id")),
    }


def requests(spark, d):
    """signup: an item and a sample of it by temporary ids; click: a sample's material; error: an item and its samples go."""
    events = star.read(spark, d, "events")
    new = events.where("event_type = 'signup'")
    name = F.concat(F.lit("i"), F.col("event_id").cast("string"))
    out = editor.request(new, F.col("event_id") * 4, "CREATE_ITEM", temp_id=name, value=F.col("value"))
    out = out.unionAll(editor.request(new, F.col("event_id") * 4 + 1, "CREATE_SAMPLE", temp_id=F.concat(F.lit("s"), F.col("event_id").cast("string")), item_temp=name, repr_id=F.lit(1), material_id=F.lit(70)))
    painted = star.read(spark, d, "orders").join(events.where("event_type = 'click'"), F.col("o_orderkey") == F.col("event_id"))
    out = out.unionAll(
        editor.request(painted, F.col("event_id") * 4, "UPDATE_SAMPLE", local_id=F.col("event_id"), item_id=F.col("o_custkey"), repr_id=F.substring("o_orderpriority", 1, 1), material_temp=F.lit("paint"))
    )
    out = out.unionAll(editor.request(spark.range(1), F.lit(-1), "CREATE_MATERIAL", temp_id=F.lit("paint"), local_id=F.lit(88), value=F.lit(1.0)))
    gone = events.where("event_type = 'error'").select(F.col("user_id").alias("local_id"))
    some = star.read(spark, d, "customer").select(F.col("c_custkey").alias("local_id")).join(gone, "local_id", "left_semi")
    return out.unionAll(editor.delete_elements(tables(spark, d), some).where("type IN ('DELETE_ITEM', 'DELETE_SAMPLE')").withColumn("seq", F.lit(1 << 40) + F.col("local_id")))


def solved(spark, d):
    return editor.solve_ids(requests(spark, d), NEXT)


_NEW = f"new AS (SELECT event_id, value, {NEXT} + 2 * (row_number() OVER (ORDER BY event_id) - 1) AS item_id FROM events WHERE event_type = 'signup')"
_GONE = "gone AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error')"
_CLICK = "click AS (SELECT event_id AS id FROM events WHERE event_type = 'click')"
_SAMPLES = """samples AS (SELECT o_orderkey AS local_id, o_custkey AS item_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS repr_id, CASE WHEN o_orderkey IN (SELECT id FROM click) THEN 88 ELSE ascii(o_orderstatus) END AS material_id
    FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone) UNION ALL SELECT item_id + 1, item_id, 1, 70 FROM new)"""


@graded(f"""WITH {_NEW} SELECT 4 * event_id AS seq, 'CREATE_ITEM' AS type, item_id AS local_id, CAST(NULL AS BIGINT) AS item_id FROM new
  UNION ALL SELECT 4 * event_id + 1, 'CREATE_SAMPLE', item_id + 1, item_id FROM new UNION ALL SELECT -1, 'CREATE_MATERIAL', 88, NULL""")
def solve_ids(spark, d):
    return solved(spark, d).where("type LIKE 'CREATE%'").select("seq", "type", "local_id", "item_id")


@graded(f"WITH {_NEW}, {_GONE}, {_CLICK}, {_SAMPLES} SELECT local_id, item_id, repr_id, CAST(material_id AS BIGINT) AS material_id FROM samples")
def apply_batch(spark, d):
    return editor.apply_batch(tables(spark, d), solved(spark, d))["SAMPLE"]


@graded(f"""WITH {_NEW}, {_GONE}, {_CLICK}, {_SAMPLES}, touched AS (SELECT item_id FROM samples WHERE material_id = 88 UNION SELECT item_id FROM new)
  SELECT local_id, item_id, repr_id, CAST(material_id AS BIGINT) AS material_id FROM samples WHERE item_id IN (SELECT item_id FROM touched)""")
def delta_build(spark, d):
    return editor.delta(tables(spark, d), solved(spark, d))["SAMPLE"]


@graded(f"""WITH {_NEW}, {_GONE} SELECT 'item' AS entity, c_custkey AS local_id FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone) UNION ALL SELECT 'item', item_id FROM new
  UNION ALL SELECT 'max', max(item_id) + 1 FROM new UNION ALL SELECT 'material', unnest([70, 79, 80, 88])""")
def save_model(spark, d):
    folder = traversal.scratch(spark, "girder-saved")[0]
    most = editor.save(tables(spark, d), solved(spark, d), folder, NEXT - 1)
    out = spark.createDataFrame([("max", most)], "entity string, local_id long")
    for entity in ("item", "material"):
        out = out.unionAll(spark.read.parquet(f"{folder}/{entity}").select(F.lit(entity), "local_id"))
    return out


@graded("""SELECT s_suppkey * 1048576 AS seq, 'CREATE_ITEM' AS type, 'item-' || s_suppkey AS temp_id, NULL AS item_temp, CAST(NULL AS BIGINT) AS repr_id FROM supplier
  UNION ALL SELECT s_suppkey * 1048576 + k + 1, 'CREATE_SAMPLE', 'sample-' || s_suppkey || '-' || k, 'item-' || s_suppkey, k + 1 FROM supplier, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= s_suppkey % 3""")
def create_elements(spark, d):
    parts = F.transform(F.sequence(F.lit(1), F.col("s_suppkey") % 3 + 1), lambda k: F.struct(k.cast("long").alias("repr_id"), F.lit(70).cast("long").alias("material_id")))
    elements = star.read(spark, d, "supplier").select(F.col("s_suppkey").alias("element"), F.col("s_acctbal").alias("value"), parts.alias("parts"))
    return editor.create_elements(elements).select("seq", "type", "temp_id", "item_temp", "repr_id")


@graded("""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 24), s AS (SELECT o_orderkey, o_custkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS r, ascii(o_orderstatus) AS m FROM orders)
  SELECT 'DELETE_ITEM' AS type, id AS local_id FROM gone UNION ALL SELECT 'DELETE_SAMPLE', o_orderkey FROM s WHERE o_custkey IN (SELECT id FROM gone)
  UNION ALL SELECT 'DELETE_REPRESENTATION', r FROM (SELECT DISTINCT r FROM s WHERE o_custkey IN (SELECT id FROM gone) EXCEPT SELECT r FROM s WHERE o_custkey NOT IN (SELECT id FROM gone))
  UNION ALL SELECT 'DELETE_MATERIAL', m FROM (SELECT DISTINCT m FROM s WHERE o_custkey IN (SELECT id FROM gone) EXCEPT SELECT m FROM s WHERE o_custkey NOT IN (SELECT id FROM gone))""")
def delete_elements(spark, d):
    gone = star.read(spark, d, "customer").where("c_nationkey < 24").select(F.col("c_custkey").alias("local_id"))
    return editor.delete_elements(tables(spark, d), gone).select("type", "local_id")


@graded("""WITH k AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'DELETE_ITEM' WHEN 'signup' THEN 'CREATE_ITEM' WHEN 'view' THEN 'UPDATE_RELATION' WHEN 'click' THEN 'CREATE_INDEX' ELSE 'UPDATE_ITEM' END AS type FROM events)
  SELECT row_number() OVER (ORDER BY CASE type WHEN 'DELETE_ITEM' THEN 0 WHEN 'CREATE_ITEM' THEN 1 WHEN 'UPDATE_ITEM' THEN 2 WHEN 'UPDATE_RELATION' THEN 4 ELSE 6 END, event_id) - 1 AS seq, type, event_id AS local_id FROM k""")
def flush_order(spark, d):
    kind = F.expr("CASE event_type WHEN 'error' THEN 'DELETE_ITEM' WHEN 'signup' THEN 'CREATE_ITEM' WHEN 'view' THEN 'UPDATE_RELATION' WHEN 'click' THEN 'CREATE_INDEX' ELSE 'UPDATE_ITEM' END")
    rows = star.read(spark, d, "events").select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_id").alias("local_id"))
    return editor.flush_order(rows)


@graded("SELECT c_custkey AS local_id, abs(floor(c_acctbal)) + 0.5 AS value FROM customer WHERE c_custkey % 3 = 2")
def element_diff(spark, d):
    """Whole balances of which a third gets a tenth of the precision more, which is no change, and a third 0.5, which is one."""
    customers = star.read(spark, d, "customer")
    third, whole = F.col("c_custkey") % 3, F.abs(F.floor("c_acctbal")).cast("double")
    before = customers.select(F.col("c_custkey").alias("local_id"), whole.alias("value"))
    after = customers.select(F.col("c_custkey").alias("local_id"), (whole + F.when(third == 0, 0.0).when(third == 1, 0.0001).otherwise(0.5)).alias("value"))
    return editor.element_diff(before, after, "local_id", ("value",))


@graded("""WITH m AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS asked, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, count(*) FILTER (o_orderstatus <> 'F') OVER (PARTITION BY o_custkey) AS others FROM orders)
  SELECT o_orderkey AS local_id FROM m WHERE asked AND (others > 0 OR o_orderkey <> first)""")
def sample_deletes(spark, d):
    asked = star.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("local_id"))
    return editor.sample_deletes(tables(spark, d)["SAMPLE"], asked)


@graded(f"WITH {_CLICK} SELECT DISTINCT o_custkey AS item_id FROM orders WHERE o_orderkey IN (SELECT id FROM click) UNION SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')")
def affected_items(spark, d):
    return editor.affected_items(tables(spark, d)["SAMPLE"], solved(spark, d))


@graded("""WITH gone AS (SELECT CAST(user_id AS BIGINT) * 8 + 3 AS id FROM events WHERE event_type = 'error' UNION SELECT 18)
  SELECT CAST(c_nationkey AS BIGINT) * 8 + 2 AS src_id, 'HasCustomers' AS name, string_agg(CAST(c_custkey * 8 + 3 AS VARCHAR), ',' ORDER BY c_custkey) AS dst_ids FROM customer
  WHERE c_custkey * 8 + 3 NOT IN (SELECT id FROM gone) AND c_nationkey * 8 + 2 NOT IN (SELECT id FROM gone) GROUP BY c_nationkey""")
def saved_relations(spark, d):
    lists = star.read(spark, d, "customer").groupBy(star.local_id("c_nationkey", 2).alias("src_id")).agg(F.sort_array(F.collect_list(star.local_id("c_custkey", 3))).alias("dst_ids"))
    gone = star.read(spark, d, "events").where("event_type = 'error'").select(star.local_id("user_id", 3).alias("local_id")).unionAll(spark.createDataFrame([(18,)], "local_id long"))
    return editor.saved_relations(lists.select("src_id", F.lit("HasCustomers").alias("name"), "dst_ids"), gone).select("src_id", "name", joined("dst_ids"))


@graded("""SELECT c_custkey AS local_id, CASE c_custkey % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'modified' END AS change, c_mktsegment AS old, CASE c_custkey % 4 WHEN 1 THEN 'NONE' END AS new FROM customer WHERE c_custkey % 4 < 2
  UNION ALL SELECT -1 - s_suppkey, 'added', NULL, s_name FROM supplier""")
def change_feed(spark, d):
    customers, suppliers = star.read(spark, d, "customer"), star.read(spark, d, "supplier")
    way = F.col("c_custkey") % 4
    before = customers.select(F.col("c_custkey").alias("local_id"), F.col("c_mktsegment").alias("value"))
    after = customers.where(way != 0).select(F.col("c_custkey").alias("local_id"), F.when(way == 1, "NONE").otherwise(F.col("c_mktsegment")).alias("value"))
    return editor.change_feed(before, after.unionAll(suppliers.select(-1 - F.col("s_suppkey"), "s_name")), ["local_id"], "value")


@graded("""SELECT p_partkey AS repr_id, CASE WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 1.0 ELSE CAST(p_size AS DOUBLE) END AS maxx FROM part
  UNION ALL SELECT s_suppkey, 1.0 FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)""")
def merged_geometry(spark, d):
    delta_ = star.read(spark, d, "supplier").select(F.col("s_suppkey").alias("repr_id"), F.lit(1.0).alias("maxx"))
    return editor.merged_read(star.representations(spark, d).select("repr_id", "maxx"), delta_, "repr_id")


@graded("""SELECT event_id AS seq, CAST(user_id AS BIGINT) * 8 + 3 AS local_id FROM events WHERE event_id <= 700 UNION ALL SELECT 701, 3""")
def history_after_undo(spark, d):
    """Undo to an entry, then a new action: what was undone is gone."""
    log = star.edit_log(spark, d).select("seq", "local_id")
    return edits.append_after_undo(log, 700, spark.createDataFrame([(701, 3)], "seq long, local_id long"))


@graded("SELECT CAST(n_nationkey AS BIGINT) + 100 AS node_id, CAST(n_regionkey AS BIGINT) AS parent_node_id FROM nation")
def spatial_copy(spark, d):
    nodes = star.read(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("node_id"), F.col("n_regionkey").cast("long").alias("parent_node_id"), F.lit(None).cast("long").alias("local_id"), F.col("n_name").alias("category"))
    return editor.checked_tree(nodes).select("node_id", "parent_node_id")
