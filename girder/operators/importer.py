"""Import beyond relations and attributes: class sets, spatial decomposition, metadata, guards, materials, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import traversal

# Names of classes as the schema has them.
SPATIAL = ("IFCPROJECT", "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY")
ELEMENTS = (
    "IFCWALL", "IFCWALLSTANDARDCASE", "IFCWALLELEMENTEDCASE", "IFCSLAB", "IFCSLABSTANDARDCASE", "IFCSLABELEMENTEDCASE", "IFCBEAM", "IFCBEAMSTANDARDCASE",
    "IFCCOLUMN", "IFCCOLUMNSTANDARDCASE", "IFCDOOR", "IFCDOORSTANDARDCASE", "IFCWINDOW", "IFCWINDOWSTANDARDCASE", "IFCROOF", "IFCSTAIR", "IFCSTAIRFLIGHT",
    "IFCRAMP", "IFCRAMPFLIGHT", "IFCCURTAINWALL", "IFCCOVERING", "IFCRAILING", "IFCPLATE", "IFCPLATESTANDARDCASE", "IFCMEMBER", "IFCMEMBERSTANDARDCASE",
    "IFCFOOTING", "IFCPILE", "IFCFURNISHINGELEMENT", "IFCSANITARYTERMINAL", "IFCFLOWSEGMENT", "IFCFLOWTERMINAL", "IFCFLOWCONTROLLER", "IFCFLOWFITTING",
    "IFCFLOWMOVINGDEVICE", "IFCFLOWSTORAGEDEVICE", "IFCFLOWTREATMENTDEVICE", "IFCENERGYCONVERSIONDEVICE", "IFCDISTRIBUTIONFLOWELEMENT",
    "IFCDISTRIBUTIONCONTROLELEMENT", "IFCDISTRIBUTIONELEMENT", "IFCDISTRIBUTIONPORT", "IFCBUILDINGELEMENTPROXY", "IFCBUILDINGELEMENTPART", "IFCOPENINGELEMENT",
    "IFCSPACE", "IFCTRANSPORTELEMENT", "IFCVIRTUALELEMENT", "IFCSHADINGDEVICE", "IFCCHIMNEY", "IFCGEOGRAPHICELEMENT", "IFCPROXY", "IFCMECHANICALFASTENER",
)
#: The relations that the spatial structure follows downwards, from the relating side.
DOWN = ("IsDecomposedBy", "ContainsElements", "ReferencesElements", "IsNestedBy")
FARTHEST = 100_000.0  # metres from the origin beyond which a sample is left out
LARGEST = 1_000_000.0  # metres: sides of boxes are held within


def elements(parsed: DataFrame, classes: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """id of building elements."""
    return parsed.where(F.col("type").isin(*classes)).select("id")


def of_classes(parsed: DataFrame, included: tuple[str, ...] | None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Statements of the classes that are to be imported; None: all but the excluded ones."""
    rows = parsed if included is None else parsed.where(F.col("type").isin(*included))
    return rows.where(~F.col("type").isin(*excluded)) if excluded else rows


def category_names(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with category_id and the category's name by a table names(category_id, category); unknown ids keep a null."""
    return ids.join(names, "category_id", "left")


def spatial_nodes(edges: DataFrame, roots: DataFrame, categories: DataFrame, most: int = 100) -> DataFrame:
    """node_id, parent_node_id, local_id, category, depth: the spatial structure from roots(local_id) along edges
    (src_id, name, dst_id) named in DOWN, with a node for each category below each item.

    Breadth first; an item that can be reached twice is taken at its least depth, from its smallest parent.
    """
    down = traversal.materialise(edges.where(F.col("name").isin(*DOWN)).select("src_id", "dst_id").distinct())
    level = traversal.materialise(roots.select("local_id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    seen = level
    for depth in range(1, most + 1):
        step = level.join(down, F.col("local_id") == F.col("src_id")).groupBy(F.col("dst_id").alias("local_id")).agg(F.min("src_id").alias("parent"))
        level = traversal.materialise(step.join(seen.select("local_id"), "local_id", "left_anti").withColumn("depth", F.lit(depth)).select("local_id", "parent", "depth"))
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    else:
        raise RuntimeError(f"no end after {most} levels")
    named = seen.join(categories.select("local_id", "category"), "local_id", "left")
    group = F.concat(F.coalesce(F.col("parent").cast("string"), F.lit("root")), F.lit("/"), F.coalesce("category", F.lit("")))
    own = named.select(F.col("local_id").cast("string").alias("node_id"), group.alias("parent_node_id"), "local_id", F.lit(None).cast("string").alias("category"), (2 * F.col("depth") + 1).alias("depth"))
    groups = named.select(group.alias("node_id"), F.col("parent").cast("string").alias("parent_node_id"), F.lit(None).cast("long").alias("local_id"), "category", (2 * F.col("depth")).alias("depth")).distinct()
    return own.unionAll(groups)


def property_inverse(edges: DataFrame, name: str = "HasProperties", inverse: str = "MaterialOf") -> DataFrame:
    """Edges with the inverse of one relation beside it."""
    return edges.unionAll(edges.where(F.col("name") == name).select(F.col("dst_id").alias("src_id"), F.lit(inverse).alias("name"), F.col("src_id").alias("dst_id")))


def storey_elevations(attributes: DataFrame, absolute: DataFrame, name: str = "Elevation") -> DataFrame:
    """Attributes (local_id, name, v_num, ...) with the elevation of storeys replaced by the absolute one (id, elevation)."""
    both = attributes.join(absolute.select(F.col("id").alias("local_id"), "elevation"), "local_id", "left")
    return both.withColumn("v_num", F.when((F.col("name") == name) & F.col("elevation").isNotNull(), F.col("elevation")).otherwise(F.col("v_num"))).drop("elevation")


def metadata(parsed: DataFrame, arguments) -> DataFrame:
    """json: schema, name, description and crs of a model, from its project, projected system and map conversion."""
    rows = arguments(parsed.where(F.col("type").isin("IFCPROJECT", "IFCPROJECTEDCRS", "IFCMAPCONVERSION")))

    def argument(type_: str, place: int) -> Column:
        raw = F.get("each", F.lit(place))
        text = F.when(raw.startswith("'"), F.regexp_replace(F.regexp_replace(raw, "^'|'$", ""), "''", "'"))
        return F.min_by(text, F.when(F.col("type") == type_, F.col("id")))

    def number(type_: str, place: int) -> Column:
        return F.min_by(F.get("each", F.lit(place)).try_cast("double"), F.when(F.col("type") == type_, F.col("id")))

    found = rows.agg(
        argument("IFCPROJECT", 2).alias("name"), argument("IFCPROJECT", 3).alias("description"), argument("IFCPROJECTEDCRS", 0).alias("crs_name"), argument("IFCPROJECTEDCRS", 2).alias("datum"),
        number("IFCMAPCONVERSION", 2).alias("eastings"), number("IFCMAPCONVERSION", 3).alias("northings"), number("IFCMAPCONVERSION", 4).alias("height"),
    )
    crs = F.struct(F.col("crs_name").alias("name"), "datum", "eastings", "northings", "height")
    return found.select(F.to_json(F.struct("name", "description", F.when(F.col("crs_name").isNotNull(), crs).alias("crs"))).alias("json"))


def guarded(boxes: DataFrame, low: tuple[str, ...], high: tuple[str, ...]) -> DataFrame:
    """Boxes without those that begin beyond FARTHEST on a positive axis or that are empty, and held within LARGEST."""
    near = F.greatest(*[F.col(c) for c in low]) <= FARTHEST
    some = F.greatest(*[F.col(h) - F.col(l) for l, h in zip(low, high, strict=True)]) > 0
    held = {c: F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) for c in (*low, *high)}
    return boxes.where(near & some).withColumns(held)


def colour_materials(samples: DataFrame, category: str = "IFCSPACE", alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Samples (sample_id, category, r, g, b, a) with material_id, and the materials; equal colours are one material, and a
    category's is translucent. Ids are dense; ranks are within ranges of hashes, with counts of the ranges before."""
    shown = samples.withColumn("a", F.when(F.col("category") == category, F.least(F.col("a"), F.lit(alpha))).otherwise(F.col("a")))
    colours = shown.select("r", "g", "b", "a").distinct().withColumn("_range", F.floor(F.col("r") * 4))
    counts = colours.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("r", "g", "b", "a"))
    materials = colours.withColumn("_rank", rank).join(F.broadcast(before), "_range").select("r", "g", "b", "a", (F.col("_before") + F.col("_rank") - 1).alias("material_id"))  # five ranges
    return shown.join(materials, ["r", "g", "b", "a"]).select("sample_id", "category", "material_id"), materials


def fan(loops: DataFrame, key: str) -> DataFrame:
    """key, a, b, c: triangles of polygon loops (points array) as fans around their first point."""
    points = F.col("points")
    each = F.transform(F.sequence(F.lit(1), F.size(points) - 2), lambda k: F.struct(points[0].alias("a"), F.get(points, k).alias("b"), F.get(points, k + 1).alias("c")))
    return loops.where(F.size("points") >= 3).select(key, F.explode(each).alias("t")).select(key, "t.*")


# ---- splitting ------------------------------------------------------------------------------------------------------


def shared_ids(parsed: DataFrame, references: DataFrame, pairs: DataFrame) -> DataFrame:
    """id: what every file of a split gets: the spatial structure with all it refers to, and aggregates that tie only it."""
    spatial = parsed.where(F.col("type").isin(*SPATIAL)).select("id")
    lists = pairs.where("type = 'IFCRELAGGREGATES'").join(spatial.withColumnRenamed("id", "relating"), "relating", "left_semi")
    inside = lists.join(spatial.select(F.col("id").alias("related"), F.lit(True).alias("in")), "related", "left")
    whole = inside.groupBy("statement_id").agg(F.min(F.coalesce("in", F.lit(False))).alias("all")).where("all").select(F.col("statement_id").alias("id"))
    return traversal.closure(spatial.unionAll(whole), references).select("id")


def styled(ids: DataFrame, styles: DataFrame, references: DataFrame, stop: DataFrame) -> DataFrame:
    """group_id, id: the statements of groups with the styles of what they hold: styles(style_id, target_id) point at it.

    One pass: a style that only another style's target brings is not looked for again.
    """
    hit = styles.join(ids.select("group_id", F.col("id").alias("target_id")), "target_id").select("group_id", F.col("style_id").alias("id")).distinct()
    return ids.unionAll(group_closure(hit, references, stop)).distinct()


def group_closure(start: DataFrame, references: DataFrame, stop: DataFrame, most: int = 1000) -> DataFrame:
    """group_id, id: what each group's start(group_id, id) needs, over references(a, b); stop(id) elements of others are not
    entered."""
    edges = traversal.materialise(references.join(stop.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
    seen = frontier = traversal.materialise(start.select("group_id", "id").distinct())
    for _ in range(most):
        step = frontier.join(edges, F.col("id") == F.col("a")).select("group_id", F.col("b").alias("id")).distinct()
        frontier = traversal.materialise(step.join(seen, ["group_id", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
    raise RuntimeError(f"no end after {most} rounds")


def statements_of_groups(lines: DataFrame, ids: DataFrame, rewritten: DataFrame) -> DataFrame:
    """group_id, id, statement: the lines(id, statement) of each group, with rewritten(group_id, id, statement) in place of
    those relations; relations that lose all their members are in neither."""
    own = lines.join(ids.select("group_id", "id").distinct(), "id").select("group_id", "id", "statement")
    return own.join(rewritten.select("id").distinct(), "id", "left_anti").select("group_id", "id", "statement").unionByName(rewritten)


def write_split(statements: DataFrame, folder: str) -> None:
    """A folder for each group: its statements, in order of id over its part files; groups without statements give none.

    Ranges of (group, id) are dealt to tasks, so that a large group is written by several.
    """
    ordered = statements.repartitionByRange("group_id", "id").sortWithinPartitions("group_id", "id")
    ordered.select("group_id", F.concat(F.col("statement"), F.lit(";")).alias("value")).write.partitionBy("group_id").text(folder)
