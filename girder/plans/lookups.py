"""Registered queries: ids, names, raw entities, indexes, item state and model tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from girder.operators import catalog, state, traversal
from girder.operators import query as q
from girder.plans.graded import boxes, graded, joined
from girder.plans.model_sql import ATTRIBUTES, BOXES, ITEMS
from girder.sources import models
from girder.sources import star_schema as star

# ---- ids and names --------------------------------------------------------------------------------------------------


@graded(f"WITH {ITEMS} SELECT local_id FROM items")
def all_local_ids(spark, d):
    return star.items(spark, d).select("local_id")


@graded(f"WITH {ITEMS} SELECT guid FROM items WHERE guid IS NOT NULL")
def all_guids(spark, d):
    return star.items(spark, d).select("guid").where("guid IS NOT NULL")


@graded(f"WITH {ITEMS}, asked(pos, local_id) AS (VALUES (0, 26), (1, 62), (2, -5), (3, 26), (4, 21)) SELECT CAST(pos AS BIGINT) AS pos, CAST(a.local_id AS BIGINT) AS local_id, guid FROM asked a LEFT JOIN items i ON i.local_id = a.local_id")
def guids_of_ids(spark, d):
    asked = spark.createDataFrame([(0, 26), (1, 62), (2, -5), (3, 26), (4, 21)], "pos long, local_id long")
    return q.look_up(asked, star.items(spark, d), "local_id", "guid")


@graded(f"WITH {ITEMS} SELECT count(*) AS n, max(local_id) AS max_local_id FROM items")
def item_counts(spark, d):
    return catalog.counts(star.items(spark, d))


_CREATED = "created AS (SELECT CAST(user_id AS BIGINT) * 8 + 100003 AS local_id, 'NEW_' || event_type AS category FROM events WHERE event_type IN ('signup', 'purchase'))"


def _created(spark, d):
    new = star.read(spark, d, "events").where("event_type IN ('signup', 'purchase')")
    return new.select((F.col("user_id").cast("long") * 8 + 100003).alias("local_id"), F.concat(F.lit("NEW_"), F.col("event_type")).alias("category"))


@graded(f"WITH {ITEMS}, {_CREATED} SELECT category FROM items WHERE category IS NOT NULL UNION SELECT category FROM created")
def categories(spark, d):
    return catalog.categories(star.items(spark, d), _created(spark, d))


@graded("""SELECT CAST(c_custkey AS BIGINT) AS pos, CAST(c_custkey AS BIGINT) * 8 + 3 AS local_id, 'CUSTOMER' AS category FROM customer
  UNION ALL SELECT -1, 100000003 * 8, NULL""")
def categories_of_ids(spark, d):
    asked = star.read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), star.local_id("c_custkey", 3).alias("local_id"))
    asked = asked.unionAll(spark.createDataFrame([(-1, 100000003 * 8)], "pos long, local_id long"))
    return catalog.categories_of(asked, star.items(spark, d), _created(spark, d).withColumn("category", F.lit("LATER")).where("local_id > 1000000000"))


@graded("""SELECT DISTINCT unnest(['InRegion', 'HasNations', 'InNation', 'HasCustomers', 'HasSuppliers', 'PlacedBy', 'Placed', 'ContainsPart', 'PartOf', 'SuppliedBy', 'Supplies']) AS name""")
def relation_names(spark, d):
    return catalog.relation_names(star.edges(spark, d))


@graded("""SELECT CAST(n_nationkey AS BIGINT) * 8 + 2 AS local_id, 'HasSuppliers' AS name, string_agg(CAST(CAST(s_suppkey AS BIGINT) * 8 + 4 AS VARCHAR), ',' ORDER BY s_suppkey) AS dst_ids
  FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 3 GROUP BY n_nationkey
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, 'InRegion', CAST(CAST(n_regionkey AS BIGINT) * 8 + 1 AS VARCHAR) FROM nation WHERE n_regionkey <> 3
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, 'MovedTo', '9' FROM nation WHERE n_regionkey = 3""")
def item_relations(spark, d):
    nations = star.read(spark, d, "nation")
    pending = nations.where("n_regionkey = 3").select(star.local_id("n_nationkey", 2).alias("src_id"), F.lit("MovedTo").alias("name"), F.lit(9).cast("long").alias("dst_id"))
    found = catalog.relations_of(star.edges(spark, d, ("HasSuppliers", "InRegion")), pending, nations.select(star.local_id("n_nationkey", 2).alias("local_id")))
    return found.select("local_id", "name", joined("dst_ids"))


def _mesh_items(spark, d):
    """Each drawn instance: order and material; local ids of orders."""
    return star.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.ascii("l_returnflag") % 10).alias("item_id"), star.local_id("l_orderkey", 6).alias("local_id")).distinct()


_MESH = "mesh AS (SELECT DISTINCT l_orderkey * 10 + ascii(l_returnflag) % 10 AS item_id, CAST(l_orderkey AS BIGINT) * 8 + 6 AS local_id FROM lineitem)"


@graded(f"WITH {_MESH} SELECT o_orderkey AS pos, local_id, item_id FROM orders JOIN mesh ON local_id = CAST(o_orderkey AS BIGINT) * 8 + 6")
def item_ids_of_ids(spark, d):
    asked = star.read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), star.local_id("o_orderkey", 6).alias("local_id"))
    return catalog.item_ids(asked, _mesh_items(spark, d))


@graded(f"WITH {_MESH} SELECT local_id, min(item_id) AS pos FROM mesh GROUP BY local_id")
def local_ids_of_items(spark, d):
    mesh = _mesh_items(spark, d)
    asked = mesh.select(F.col("item_id").alias("pos"), "item_id").unionAll(spark.createDataFrame([(-1, -1)], "pos long, item_id long"))
    return q.positions_once(asked, mesh)


@graded(f"WITH {ITEMS} SELECT category, string_agg(CAST(local_id AS VARCHAR), ',' ORDER BY local_id) AS ids FROM items WHERE regexp_matches(category, 'ION$|^SUPP') GROUP BY category")
def ids_by_category(spark, d):
    small = q.Model(star.items(spark, d), star.attributes(spark, d), star.edges(spark, d, ("InRegion",)), parts=star.parts(spark, d)).narrowed(("ION$", "^SUPP"), ()).items
    found = q.items_of_categories(small, ("ION$", "^SUPP")).groupBy("category").agg(F.sort_array(F.collect_list("local_id")).alias("ids"))
    return found.select("category", joined("ids"))


# ---- raw entities ---------------------------------------------------------------------------------------------------

_PARTS_LOG = """plog AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'DELETE_REPRESENTATION' WHEN 'signup' THEN 'CREATE_REPRESENTATION' ELSE 'UPDATE_REPRESENTATION' END AS type,
  CASE WHEN event_type = 'signup' THEN 1000000 + event_id ELSE user_id END AS local_id, value FROM events WHERE event_type IN ('error', 'signup', 'purchase'))"""


def _parts_log(spark, d):
    return star.read(spark, d, "events").where("event_type IN ('error', 'signup', 'purchase')").select(
        F.col("event_id").alias("seq"),
        F.expr("CASE event_type WHEN 'error' THEN 'DELETE_REPRESENTATION' WHEN 'signup' THEN 'CREATE_REPRESENTATION' ELSE 'UPDATE_REPRESENTATION' END").alias("type"),
        F.expr("CASE WHEN event_type = 'signup' THEN 1000000 + event_id ELSE user_id END").alias("local_id"),
        "value",
    )


@graded(f"""WITH {_PARTS_LOG}, l AS (SELECT local_id, arg_max(type, seq) AS type FROM plog WHERE type <> 'UPDATE_REPRESENTATION' GROUP BY local_id)
  SELECT coalesce(p_partkey, local_id) AS local_id FROM part FULL JOIN l ON p_partkey = local_id WHERE type IS NULL OR type LIKE 'CREATE%'""")
def resource_ids(spark, d):
    from girder.operators import edits

    return edits.overlay_ids(star.read(spark, d, "part").select(F.col("p_partkey").alias("local_id")), _parts_log(spark, d), "REPRESENTATION")


@graded(f"""WITH {_PARTS_LOG}, l AS (SELECT local_id, arg_max(type, seq) AS type, arg_max(value, seq) AS value FROM plog GROUP BY local_id)
  SELECT p_partkey AS local_id, CASE WHEN type IS NULL THEN CAST(p_size AS DOUBLE) ELSE value END AS size FROM part LEFT JOIN l ON p_partkey = local_id
  WHERE p_brand = (SELECT min(p_brand) FROM part) AND (type IS NULL OR type <> 'DELETE_REPRESENTATION')""")
def raw_representations(spark, d):
    parts = star.read(spark, d, "part")
    first = parts.agg(F.min("p_brand").alias("p_brand"))
    asked = parts.join(F.broadcast(first), "p_brand", "left_semi").select(F.col("p_partkey").alias("local_id"))
    base = parts.select(F.col("p_partkey").alias("local_id"), F.col("p_size").cast("double").alias("size"))
    return catalog.raw(base, _parts_log(spark, d).withColumnRenamed("value", "size"), "REPRESENTATION", "size", asked)


@graded("SELECT CAST(c_custkey AS BIGINT) * 8 + 3 AS local_id, 'CUSTOMER' AS category, 'CUSTOMER:' || c_custkey AS guid, CAST(3 AS BIGINT) AS n, c_name AS name, c_mktsegment AS segment FROM customer")
def raw_items(spark, d):
    part = next(p for p in star.parts(spark, d) if p.category == "CUSTOMER")
    found = catalog.raw_items(catalog.checked_items(part.items), part.attributes(part.names))
    return found.select("local_id", "category", "guid", F.size("data").cast("long").alias("n"), F.col("data")["c_name"].alias("name"), F.col("data")["c_mktsegment"].alias("segment"))


@graded(f"""WITH {ATTRIBUTES} SELECT local_id, ord, '["' || name || '","' || v_str || '","' || type || '"]' AS data FROM attributes WHERE v_str IS NOT NULL AND name LIKE '%name'""")
def serialized_attributes(spark, d):
    return catalog.serialized(star.attributes(spark, d).where("v_str IS NOT NULL AND name LIKE '%name'"))


@graded("SELECT 'm' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '-DELTA-MODEL-' || o_orderkey ELSE '' END AS model_id, 'm' || o_orderpriority AS root FROM orders")
def root_model_ids(spark, d):
    orders = star.read(spark, d, "orders")
    model_id = F.concat(F.lit("m"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(catalog.DELTA), F.col("o_orderkey").cast("string"))).otherwise(""))
    return orders.select(model_id.alias("model_id")).withColumn("root", catalog.root_model_id(F.col("model_id")))


@graded(f"WITH {BOXES} SELECT item_id, count(*) FILTER (repr_id % 3 > 0) AS n, coalesce(string_agg(CAST(repr_id AS VARCHAR), ',' ORDER BY repr_id) FILTER (repr_id % 3 > 0), '') AS reprs FROM boxes GROUP BY item_id")
def snap_data(spark, d):
    part = F.struct("repr_id", "material", F.when(F.col("repr_id") % 3 > 0, "SHELL").otherwise("CIRCLE_EXTRUSION").alias("class"))
    bundles = boxes(spark, d).groupBy("item_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    found = catalog.snap_data(bundles)
    return found.select("item_id", F.size("parts").cast("long").alias("n"), F.array_join(F.transform("parts", lambda p: p["repr_id"].cast("string")), ",").alias("reprs"))


@graded("""WITH s AS (SELECT s_nationkey, string_agg('{"localId":' || (s_suppkey * 8 + 4) || ',"category":"SUPPLIER","children":[]}', ',' ORDER BY s_suppkey) AS kids FROM supplier GROUP BY s_nationkey),
  n AS (SELECT n_regionkey, string_agg('{"localId":' || (n_nationkey * 8 + 2) || ',"children":[' || coalesce(kids, '') || ']}', ',' ORDER BY n_nationkey) AS kids FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY n_regionkey)
  SELECT CAST(r_regionkey * 8 + 1 AS BIGINT) AS node_id, '{"localId":' || (r_regionkey * 8 + 1) || ',"category":"REGION","children":[' || coalesce(kids, '') || ']}' AS json FROM region LEFT JOIN n ON n_regionkey = r_regionkey""")
def spatial_tree(spark, d):
    region, nation, supplier = (star.read(spark, d, t) for t in ("region", "nation", "supplier"))

    def nodes(rows, key, tag, parent, parent_tag, category):
        me = star.local_id(key, tag)
        above = star.local_id(parent, parent_tag) if parent else F.lit(None).cast("long")
        return rows.select(me.alias("node_id"), above.alias("parent_node_id"), F.col(key).cast("long").alias("ord"), me.alias("local_id"), F.lit(category).cast("string").alias("category"))

    tree = nodes(region, "r_regionkey", 1, None, 0, "REGION").unionAll(nodes(nation, "n_nationkey", 2, "n_regionkey", 1, None)).unionAll(nodes(supplier, "s_suppkey", 4, "s_nationkey", 2, "SUPPLIER"))
    return catalog.tree_json(tree)


# ---- indexes --------------------------------------------------------------------------------------------------------

_INDEX_LOG = [(1, "CREATE_INDEX", "fresh"), (2, "UPDATE_INDEX", "P1"), (3, "DELETE_INDEX", "P2"), (4, "CREATE_INDEX", "gone"), (5, "DELETE_INDEX", "gone")]


def _stored_index(spark, d):
    """One index for each of five sizes: its parts."""
    parts = star.read(spark, d, "part")
    return parts.select(F.concat(F.lit("P"), (F.col("p_size") % 5).cast("string")).alias("name"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("key_num"))


def _index_log(spark):
    return spark.createDataFrame(_INDEX_LOG, "seq long, type string, name string")


@graded("""SELECT name, row_number() OVER (ORDER BY late, place) - 1 AS place FROM (SELECT DISTINCT 'P' || p_size % 5 AS name, 0 AS late, p_size % 5 AS place FROM part WHERE p_size % 5 <> 2 UNION ALL SELECT 'fresh', 1, 1)""")
def index_names(spark, d):
    stored = _stored_index(spark, d).select("name", F.substring("name", 2, 1).cast("long").alias("pos")).distinct()
    return catalog.index_names(stored, _index_log(spark))


@graded("""SELECT 'P' || p_size % 5 AS name, p_partkey AS pos, p_partkey AS key_num FROM part WHERE p_size % 5 NOT IN (1, 2)
  UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'P1' ELSE 'fresh' END, s_suppkey, s_suppkey * 10 FROM supplier""")
def index_lifecycle(spark, d):
    suppliers = star.read(spark, d, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    pending = suppliers.select(F.when(even, 2).otherwise(1).cast("long").alias("seq"), F.when(even, "P1").otherwise("fresh").alias("name"), F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") * 10).alias("key_num"))
    return catalog.index_keys(catalog.index_entries(_stored_index(spark, d), pending, _index_log(spark)))


@graded("SELECT 'P' || p_size % 5 AS name, p_partkey AS pos, p_partkey AS key_num FROM part WHERE p_partkey = 17")
def index_key_at(spark, d):
    return catalog.index_keys(_stored_index(spark, d), 17)


# ---- item state -----------------------------------------------------------------------------------------------------


def _config(spark, d):
    return star.read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderpriority") < "3").alias("visible"))


def _open(spark, d, status="O"):
    return star.read(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("item_id"))


@graded("SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'O' THEN NOT o_orderpriority < '3' ELSE o_orderpriority < '3' END AS visible FROM orders")
def visibility_toggle(spark, d):
    return state.set_visible(_config(spark, d), _open(spark, d), None)


@graded("SELECT o_orderkey AS item_id, true AS visible FROM orders")
def visibility_reset(spark, d):
    return state.reset_visible(_config(spark, d))


@graded("SELECT o_orderkey AS pos, CAST(o_orderkey AS BIGINT) * 8 + 6 AS local_id, o_orderkey AS item_id, o_orderpriority < '3' AS visible FROM orders WHERE o_orderstatus <> 'F'")
def visibility_by_id(spark, d):
    config = state.hide_for_edit(_config(spark, d), _open(spark, d, "F"))
    mesh = star.read(spark, d, "orders").select(star.local_id("o_orderkey", 6).alias("local_id"), F.col("o_orderkey").alias("item_id"))
    return state.visibility_of(config, mesh.select(F.col("item_id").alias("pos"), "local_id"), mesh)


@graded("SELECT o_orderkey AS item_id FROM orders WHERE o_orderpriority < '3' AND o_orderstatus = 'F'")
def items_by_config(spark, d):
    config = state.hide_for_edit(_config(spark, d), _open(spark, d, "F"))
    return state.by_config(config, F.col("visible") & F.col("hidden_for_edit"))


_PAST = "past AS (SELECT o_orderkey AS item_id, o_orderpriority AS color, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END AS opacity FROM orders WHERE o_orderstatus <> 'P')"


def _past(spark, d):
    rows = star.read(spark, d, "orders").where("o_orderstatus <> 'P'")
    return rows.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("color"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).alias("opacity"), F.lit(None).cast("boolean").alias("transparent"), F.lit(None).cast("int").alias("rendered_faces"))


@graded(f"WITH {_PAST} SELECT o_orderkey AS item_id, 'red' AS color, CAST(opacity AS DOUBLE) AS opacity FROM orders LEFT JOIN past ON item_id = o_orderkey WHERE o_orderstatus <> 'O'")
def highlights(spark, d):
    orders = _config(spark, d)
    asked = orders.join(_open(spark, d), "item_id", "left_anti")
    return state.highlight(orders, asked, _past(spark, d), color="red").select("item_id", "color", "opacity")


@graded(f"WITH {_PAST} SELECT item_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE color END AS color, CAST(opacity AS DOUBLE) AS opacity FROM past JOIN orders ON o_orderkey = item_id")
def highlight_reset(spark, d):
    return state.reset_highlight(_past(spark, d), _open(spark, d), "color").select("item_id", "color", "opacity")


@graded(f"""WITH {_PAST}, f AS (SELECT item_id, color, CAST(coalesce(opacity, 1.0) AS DOUBLE) AS opacity FROM past)
  SELECT item_id, CAST(dense_rank() OVER (ORDER BY color, opacity) - 1 AS INTEGER) AS highlight_id FROM f""")
def highlight_materials(spark, d):
    return state.materials(_past(spark, d))


# ---- models ---------------------------------------------------------------------------------------------------------


def regions_as_models(spark, d) -> models.ModelTables:
    """Each region is a model: its nations and their suppliers are items, suppliers are drawn."""
    region, nation, supplier = (star.read(spark, d, t) for t in ("region", "nation", "supplier"))
    model_of = nation.select("n_nationkey", F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model_id"))
    nations = nation.join(model_of, "n_nationkey").select("model_id", star.local_id("n_nationkey", 2).alias("local_id"), F.col("n_nationkey").cast("long").alias("item_ix"), F.lit("NATION").alias("category"), F.col("n_name").alias("guid"))
    drawn = supplier.join(model_of, supplier.s_nationkey == model_of.n_nationkey)
    suppliers = drawn.select("model_id", star.local_id("s_suppkey", 4).alias("local_id"), F.col("s_suppkey").alias("item_ix"), F.lit("SUPPLIER").alias("category"), F.col("s_name").alias("guid"))
    empty = models.new_model(spark, "none")
    t = dict(empty.tables)
    t["models"] = region.select(
        F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("model_id"), F.col("r_name").alias("guid"),
        F.when(F.col("r_regionkey") < 3, F.to_json(F.struct(F.struct(F.col("r_name").alias("name")).alias("crs")))).otherwise("{}").alias("metadata"),
        F.lit(1).cast("long").alias("max_local_id"), F.col("r_regionkey").cast("double").alias("px"), (F.col("r_regionkey") * 2.0).alias("py"), F.lit(0.5).alias("pz"),
    )
    t["items"] = nations.unionAll(suppliers)
    t["attributes"] = t["items"].select("model_id", "local_id", F.lit(0).alias("ord"), F.lit("Name").alias("name"), F.lit("string").alias("value_kind"), F.col("guid").alias("v_str"), *[F.lit(None).cast(k).alias(n) for n, k in (("v_num", "double"), ("v_bool", "boolean"), ("v_json", "string"))], F.lit("IFCLABEL").alias("type"))
    t["relations"] = drawn.groupBy("model_id", star.local_id("s_nationkey", 2).alias("src_id")).agg(F.sort_array(F.collect_list(star.local_id("s_suppkey", 4))).alias("dst_ids")).select("model_id", "src_id", F.lit("HasSuppliers").alias("name"), F.lit(0).alias("rel_ord"), "dst_ids")
    t["mesh_items"] = drawn.select("model_id", F.col("s_suppkey").alias("item_id"), star.local_id("s_suppkey", 4).alias("local_id"), F.col("s_suppkey").alias("gt_id"))
    t["samples"] = drawn.select("model_id", F.col("s_suppkey").alias("sample_ix"), F.col("s_suppkey").alias("sample_id"), F.col("s_suppkey").alias("item_id"), F.lit(0).cast("long").alias("material_ix"), F.lit(0).cast("long").alias("repr_ix"), F.lit(0).cast("long").alias("lt_ix"))
    return models.ModelTables(t)


@graded("SELECT 'm' || r_regionkey AS model_id, CAST(0 - r_regionkey AS DOUBLE) AS dx, CAST(0 - r_regionkey * 2.0 AS DOUBLE) AS dy, CAST(0 AS DOUBLE) AS dz FROM region")
def models_aligned(spark, d):
    return models.aligned(regions_as_models(spark, d)["models"], "m0")


@graded("""SELECT 'm' || r_regionkey AS model_id, CASE WHEN r_regionkey < 3 THEN '{"name":"' || r_name || '"}' END AS crs FROM region""")
def models_crs(spark, d):
    return models.coordinate_system(regions_as_models(spark, d)["models"])


@graded("""SELECT 'm' || n_regionkey AS model_id, '{"model_id":"m' || n_regionkey || '","local_id":' || (n_nationkey * 8 + 2) || ',"item_ix":' || n_nationkey || ',"category":"NATION","guid":"' || n_name || '"}' AS json FROM nation
  UNION ALL SELECT 'm' || n_regionkey, '{"model_id":"m' || n_regionkey || '","local_id":' || (s_suppkey * 8 + 4) || ',"item_ix":' || s_suppkey || ',"category":"SUPPLIER","guid":"' || s_name || '"}' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def model_json(spark, d):
    return regions_as_models(spark, d).to_json("items")


@graded("""SELECT 'm' || n_regionkey AS model_id, 'items' AS kind, CAST(n_nationkey AS BIGINT) * 8 + 2 AS id, '' AS targets FROM nation WHERE n_nationkey < 10
  UNION ALL SELECT 'm' || n_regionkey, 'items', s_suppkey * 8 + 4, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'm' || n_regionkey, 'samples', s_suppkey, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'm' || n_regionkey, 'relations', CAST(n_nationkey AS BIGINT) * 8 + 2, string_agg(CAST(s_suppkey * 8 + 4 AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE s_suppkey % 2 = 0 AND n_nationkey < 10 GROUP BY n_regionkey, n_nationkey""")
def model_subset(spark, d):
    whole = regions_as_models(spark, d)
    wanted = whole["items"].where("(category = 'NATION' AND item_ix < 10) OR (category = 'SUPPLIER' AND item_ix % 2 = 0)").select("model_id", "local_id")
    part = models.subset(whole, wanted)
    none = F.lit("").alias("targets")
    out = part["items"].select("model_id", F.lit("items").alias("kind"), F.col("local_id").alias("id"), none)
    out = out.unionAll(part["samples"].select("model_id", F.lit("samples"), "sample_id", none))
    return out.unionAll(part["relations"].select("model_id", F.lit("relations"), "src_id", F.array_join(F.col("dst_ids").cast("array<string>"), ",")))


@graded("""SELECT 'm' || n_regionkey AS model_id, count(DISTINCT n_nationkey) + count(s_suppkey) AS items, count(s_suppkey) AS drawn FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2) GROUP BY n_regionkey
  UNION ALL SELECT 'new', 0, 0""")
def models_written(spark, d):
    """Models written to a folder and read again beside a new one; two of the five are chosen and one is disposed of."""
    folder = traversal.scratch(spark, "girder-models")[0]
    regions_as_models(spark, d).merged(models.new_model(spark, "new")).write(folder)
    back = models.read(spark, folder).without("m0").without("m3").without("m4")
    counts = back["items"].groupBy("model_id").agg(F.count(F.lit(1)).alias("items"))
    drawn = back["mesh_items"].groupBy("model_id").agg(F.count(F.lit(1)).alias("drawn"))
    zero = F.lit(0).cast("long")
    return back["models"].select("model_id").join(counts, "model_id", "left").join(drawn, "model_id", "left").select("model_id", F.coalesce("items", zero).alias("items"), F.coalesce("drawn", zero).alias("drawn"))


@graded("""SELECT CAST(n_nationkey AS BIGINT) * 8 + 2 AS root, CAST(NULL AS VARCHAR) AS name, CAST(n_nationkey AS BIGINT) * 8 + 2 AS local_id, 0 AS depth FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, 'InRegion', CAST(n_regionkey AS BIGINT) * 8 + 1, 1 FROM nation
  UNION ALL SELECT CAST(a.n_nationkey AS BIGINT) * 8 + 2, 'HasNations', CAST(b.n_nationkey AS BIGINT) * 8 + 2, 2 FROM nation a JOIN nation b USING (n_regionkey)""")
def item_data_cycles(spark, d):
    """Relations that lead back: an item that was met before is named again and not opened again."""
    nations = star.read(spark, d, "nation").select(star.local_id("n_nationkey", 2).alias("local_id"))
    config = traversal.DataConfig({"InRegion": traversal.Expansion(True, True), "HasNations": traversal.Expansion(True, True)})
    found = traversal.item_data(star.edges(spark, d, ("InRegion", "HasNations")), nations, config)
    return found.where("depth < 3").select("root", "name", "local_id", "depth")
