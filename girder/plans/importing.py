"""Registered queries: import and split of STEP models, the star schema written as statements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from girder.operators import ifc, importer, spatial, traversal
from girder.plans.graded import _LINES, GREEDY, _clusters, _elements, _parsed, boxes, graded
from girder.plans.model_sql import BOXES
from girder.sources import star_schema as star
from girder.sources import step_text as step


@graded("""SELECT CAST(NULL AS VARCHAR) AS parent_node_id, 'root/IFCBUILDING' AS node_id, CAST(NULL AS BIGINT) AS local_id, 'IFCBUILDING' AS category, 0 AS depth
  UNION ALL SELECT 'root/IFCBUILDING', CAST(r_regionkey * 8 + 1 AS VARCHAR), CAST(r_regionkey * 8 + 1 AS BIGINT), NULL, 1 FROM region
  UNION ALL SELECT DISTINCT CAST(n_regionkey * 8 + 1 AS VARCHAR), (n_regionkey * 8 + 1) || '/IFCBUILDINGSTOREY', NULL, 'IFCBUILDINGSTOREY', 2 FROM nation
  UNION ALL SELECT (n_regionkey * 8 + 1) || '/IFCBUILDINGSTOREY', CAST(n_nationkey * 8 + 2 AS VARCHAR), CAST(n_nationkey * 8 + 2 AS BIGINT), NULL, 3 FROM nation
  UNION ALL SELECT DISTINCT CAST(c_nationkey * 8 + 2 AS VARCHAR), (c_nationkey * 8 + 2) || '/IFCWALL', NULL, 'IFCWALL', 4 FROM customer
  UNION ALL SELECT (c_nationkey * 8 + 2) || '/IFCWALL', CAST(c_custkey * 8 + 3 AS VARCHAR), c_custkey * 8 + 3, NULL, 5 FROM customer""")
def spatial_build(spark, d):
    region, nation, customer = (star.read(spark, d, t) for t in ("region", "nation", "customer"))
    down = nation.select(star.local_id("n_regionkey", 1).alias("src_id"), F.lit("IsDecomposedBy").alias("name"), star.local_id("n_nationkey", 2).alias("dst_id"))
    down = down.unionAll(customer.select(star.local_id("c_nationkey", 2), F.lit("ContainsElements"), star.local_id("c_custkey", 3)))
    down = down.unionAll(customer.select(star.local_id("c_custkey", 3), F.lit("InNation"), star.local_id("c_nationkey", 2)))  # not followed
    categories = _parsed(spark, d).select(F.col("id").alias("local_id"), F.col("type").alias("category"))
    return importer.spatial_nodes(down, region.select(star.local_id("r_regionkey", 1).alias("local_id")), categories)


@graded("""SELECT CAST(c_custkey AS BIGINT) * 8 + 3 AS id FROM customer UNION ALL SELECT CAST(o_orderkey AS BIGINT) * 8 + 6 FROM orders""")
def element_classes(spark, d):
    return importer.elements(_parsed(spark, d))


@graded("""SELECT CAST(n_nationkey AS BIGINT) * 8 + 2 AS id, 'IFCBUILDINGSTOREY' AS type FROM nation UNION ALL SELECT CAST(c_custkey AS BIGINT) * 8 + 3, 'IFCWALL' FROM customer""")
def import_classes(spark, d):
    every = importer.of_classes(_parsed(spark, d), None, ("IFCOPENINGELEMENT", "IFCRELVOIDSELEMENT"))
    return importer.of_classes(every, ("IFCBUILDINGSTOREY", "IFCWALL")).select("id", "type")


@graded("""SELECT CAST(o_orderkey AS BIGINT) AS id, CASE ascii(o_orderstatus) WHEN 70 THEN 'IFCWALL' WHEN 79 THEN 'IFCSLAB' END AS category FROM orders""")
def category_names(spark, d):
    names = spark.createDataFrame([(70, "IFCWALL"), (79, "IFCSLAB")], "category_id int, category string")
    ids = star.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.ascii("o_orderstatus").alias("category_id"))
    return importer.category_names(ids, names).select("id", "category")


@graded("""SELECT CAST(p_partkey AS BIGINT) * 8 + 5 AS src_id, 'HasProperties' AS name, CAST(p_size AS BIGINT) AS dst_id FROM part UNION ALL SELECT CAST(p_size AS BIGINT), 'MaterialOf', CAST(p_partkey AS BIGINT) * 8 + 5 FROM part""")
def material_inverse(spark, d):
    edges = star.read(spark, d, "part").select(star.local_id("p_partkey", 5).alias("src_id"), F.lit("HasProperties").alias("name"), F.col("p_size").cast("long").alias("dst_id"))
    return importer.property_inverse(edges)


@graded("""SELECT CAST(n_nationkey AS BIGINT) * 8 + 2 AS local_id, 'Elevation' AS name, round((n_nationkey + n_regionkey) * 0.3048, 4) AS v_num FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, 'Height', CAST(n_nationkey AS DOUBLE) FROM nation""")
def storey_elevations(spark, d):
    region, nation = star.read(spark, d, "region"), star.read(spark, d, "nation")
    nodes = region.select(star.local_id("r_regionkey", 1).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_regionkey").cast("double").alias("elevation"))
    nodes = nodes.unionAll(nation.select(star.local_id("n_nationkey", 2), star.local_id("n_regionkey", 1), F.col("n_nationkey").cast("double")))
    own = nation.select(star.local_id("n_nationkey", 2).alias("local_id"), F.explode(F.array(F.lit("Elevation"), F.lit("Height"))).alias("name"), F.col("n_nationkey").cast("double").alias("v_num"))
    found = importer.storey_elevations(own, ifc.absolute_elevations(nodes, ifc.unit_factor(None, "FOOT")))
    return found.select("local_id", "name", F.round("v_num", 4).alias("v_num"))


_HEAD = [
    "#1=IFCPROJECT('0xg',$,'Tower, north','It''s new',$,$,$,(#20),#7)",
    "#2=IFCPROJECTEDCRS('EPSG:25832',$,'ETRS89 (high)',$,$,$,$)",
    "#3=IFCMAPCONVERSION(#20,#2,691000.5,5336000.25,520.,1.,0.,1.)",
]


@graded("""SELECT 'Tower, north' AS name, 'It''s new' AS description, 'EPSG:25832' AS crs, 'ETRS89 (high)' AS datum, 691000.5::DOUBLE AS eastings, 520::DOUBLE AS height""")
def import_metadata(spark, d):
    lines = spark.createDataFrame([(s,) for s in _HEAD], "statement string")
    found = importer.metadata(step.parsed(lines.unionAll(step.star_statements(spark, d))), step.with_arguments)
    get = lambda path: F.get_json_object("json", path)
    return found.select(get("$.name").alias("name"), get("$.description").alias("description"), get("$.crs.name").alias("crs"), get("$.crs.datum").alias("datum"), get("$.crs.eastings").cast("double").alias("eastings"), get("$.crs.height").cast("double").alias("height"))


@graded(f"""WITH {BOXES}, far AS (SELECT item_id, repr_id, minx * 1000 AS a, CASE WHEN repr_id % 2 = 0 THEN minx * 1000 ELSE maxx * 1000 END AS b, minx * 1000 AS c, maxx * 1000 AS e FROM boxes)
  SELECT item_id, count(*) AS n, round(max(least(maxx * 20000, 1000000)), 3) AS far FROM boxes WHERE minx * 1000 <= 100000 GROUP BY item_id""")
def distance_guard(spark, d):
    wide = boxes(spark, d).select("item_id", *[(F.col(c) * 1000).alias(c) for c in spatial.LOW], *[(F.col(c) * 20000).alias(c) for c in spatial.HIGH])
    kept = importer.guarded(wide, spatial.LOW, spatial.HIGH)
    return kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("maxx"), 3).alias("far"))


@graded("""WITH c AS (SELECT p_partkey, p_size % 2 / 2.0 AS r, p_size % 3 / 4.0 AS g, 0.5 AS b, CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE 1.0 END AS a FROM part)
  SELECT p_partkey AS sample_id, dense_rank() OVER (ORDER BY r, g, b, a) - 1 AS material_id FROM c""")
def colour_materials(spark, d):
    size = F.col("p_size")
    samples = star.read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.when(size % 5 == 0, "IFCSPACE").otherwise("IFCWALL").alias("category"), (size % 2 / 2).alias("r"), (size % 3 / 4).alias("g"), F.lit(0.5).alias("b"), F.lit(1.0).alias("a"))
    return importer.colour_materials(samples)[0].select("sample_id", "material_id")


@graded("""SELECT p_partkey AS repr_id, 3 AS n, round(p_size * 2.0 * 1.5, 4) AS area FROM part""")
def boundary_fans(spark, d):
    """Space boundaries: a pentagon for each part, as three triangles around its first point."""
    s = F.col("p_size").cast("double")

    def point(x, y):
        return F.struct(x.alias("x"), F.lit(y).alias("y"))

    loop = F.array(point(s * 0, 0.0), point(s, 0.0), point(s * 2, 1.0), point(s, 2.0), point(s * 0, 2.0))
    t = importer.fan(star.read(spark, d, "part").select(F.col("p_partkey").alias("repr_id"), loop.alias("points")), "repr_id")
    double = (F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("c.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))
    return t.groupBy("repr_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.round(F.sum(F.abs(double)) / 2, 4).alias("area"))


# ---- splitting ------------------------------------------------------------------------------------------------------


@graded("""SELECT CAST(r_regionkey AS BIGINT) * 8 + 1 AS id FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2 FROM nation""")
def split_shared(spark, d):
    parsed = _parsed(spark, d)
    none = spark.createDataFrame([], "type string, relating long, related long, statement_id long")
    return importer.shared_ids(parsed, ifc.references(parsed), none)


@graded(f"WITH RECURSIVE {GREEDY} SELECT group_id, count(*) AS clusters, sum(n) AS elements FROM placed GROUP BY group_id")
def split_loads(spark, d):
    """How many clusters and elements the greedy rule puts into each of four files."""
    clusters = _clusters(spark, d)
    packed = ifc.pack(clusters, 4).join(clusters, "id")
    return packed.groupBy("group_id").agg(F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).cast("decimal(38,0)").alias("elements"))


def _groups(spark, d):
    """Elements by the region of their customer: five files."""
    customer, nation, orders = (star.read(spark, d, t) for t in ("customer", "nation", "orders"))
    of = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_regionkey").alias("group_id"))
    own = of.select("group_id", star.local_id("c_custkey", 3).alias("id"))
    return own.unionAll(orders.join(of, orders.o_custkey == of.c_custkey).select("group_id", star.local_id("o_orderkey", 6).alias("id")))


@graded(f"""WITH {_LINES}, p AS (SELECT CAST(regexp_extract(s, '^#([0-9]+)', 1) AS BIGINT) AS id, s FROM lines),
  g AS (SELECT n_regionkey AS group_id, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
  m AS (SELECT group_id, CAST(c_custkey AS BIGINT) * 8 + 3 AS id FROM g UNION ALL SELECT group_id, CAST(o_orderkey AS BIGINT) * 8 + 6 FROM orders JOIN g ON o_custkey = c_custkey
    UNION ALL SELECT group_id, CAST(o_orderkey AS BIGINT) * 8 + 7 FROM orders JOIN g ON o_custkey = c_custkey
    UNION SELECT group_id, CAST(regexp_extract(c_name, '#0*([0-9]+)', 1) AS BIGINT) FROM g JOIN customer USING (c_custkey) WHERE CAST(regexp_extract(c_name, '#0*([0-9]+)', 1) AS BIGINT) % 8 = 7
    UNION SELECT group_id, id FROM (SELECT DISTINCT group_id FROM g), (SELECT CAST(r_regionkey AS BIGINT) * 8 + 1 AS id FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2 FROM nation))
  SELECT group_id, s || ';' AS line FROM m JOIN p USING (id)""")
def split_files(spark, d):
    """The files of a split, written and read again: shared statements in all, elements and the relations of their voids in
    theirs, with all that these need (numbers after # in names count as references)."""
    parsed = _parsed(spark, d)
    references, elements, own = ifc.references(parsed), _elements(parsed), _groups(spark, d)
    none = spark.createDataFrame([], "type string, relating long, related long, statement_id long")
    shared = importer.shared_ids(parsed, references, none)
    voids = parsed.where("type = 'IFCRELVOIDSELEMENT'").select("id", F.explode("refs").alias("related")).join(own.withColumnRenamed("id", "related"), "related").select("group_id", "id")
    needed = importer.group_closure(own.unionAll(voids), references, elements)
    ids = ifc.with_shared(needed, own, shared)
    rewritten = spark.createDataFrame([], "group_id int, id long, statement string")
    folder = traversal.scratch(spark, "girder-split")[0]
    importer.write_split(importer.statements_of_groups(parsed.select("id", "statement"), ids, rewritten), folder)
    return spark.read.schema("value string, group_id int").text(folder).select("group_id", F.col("value").alias("line"))


@graded("""WITH g AS (SELECT DISTINCT p_size % 3 AS group_id, CAST(p_partkey AS BIGINT) AS id FROM part)
  SELECT group_id, id FROM g UNION SELECT group_id, 1000000 + s_suppkey FROM g JOIN supplier ON s_suppkey = id UNION SELECT group_id, 2000000 + s_nationkey FROM g JOIN supplier ON s_suppkey = id""")
def style_resolution(spark, d):
    """Suppliers as styles of the part with their number, which need a colour each (their nation)."""
    suppliers = star.read(spark, d, "supplier")
    ids = star.read(spark, d, "part").select((F.col("p_size") % 3).alias("group_id"), F.col("p_partkey").alias("id"))
    styles = suppliers.select((1000000 + F.col("s_suppkey")).alias("style_id"), F.col("s_suppkey").alias("target_id"))
    needs = suppliers.select((1000000 + F.col("s_suppkey")).alias("a"), (2000000 + F.col("s_nationkey")).cast("long").alias("b"))
    needs = needs.unionAll(suppliers.select((1000000 + F.col("s_suppkey")), F.col("s_suppkey")))
    return importer.styled(ids, styles, needs, ids.select("id").distinct())
