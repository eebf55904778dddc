"""What a model holds: ids, names, raw entities, handles of items, with pending edits laid over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import edits

DELTA = "-DELTA-MODEL-"


def counts(items: DataFrame) -> DataFrame:
    """n, max_local_id."""
    return items.agg(F.count(F.lit(1)).alias("n"), F.max("local_id").alias("max_local_id"))


def categories(items: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """category: each once, of stored and of pending items."""
    rows = items.select("category")
    return (rows if created is None else rows.unionAll(created.select("category"))).where("category IS NOT NULL").distinct()


def categories_of(asked: DataFrame, items: DataFrame, created: DataFrame) -> DataFrame:
    """pos, local_id, category: of stored items, else of created ones; null in its place where there is none.

    Both sides are dealt by id and meet by merge, so what is asked for is in no task as a whole, and categories are chosen in
    the order in which the ids come.
    """
    both = items.select("local_id", "category", F.lit(0).alias("late")).unionAll(created.select("local_id", "category", F.lit(1).alias("late")))
    wanted = both.join(asked.select("local_id").hint("merge"), "local_id", "left_semi")
    first = wanted.groupBy("local_id").agg(F.min_by("category", "late").alias("category"))
    return asked.join(first.hint("merge"), "local_id", "left").select("pos", "local_id", "category")


def relation_names(edges: DataFrame) -> DataFrame:
    return edges.select("name").distinct()


def relations_of(edges: DataFrame, pending: DataFrame, ids: DataFrame) -> DataFrame:
    """local_id, name, dst_ids (sorted) of items; what is pending(src_id, name, dst_id) for an item replaces all it had."""
    wanted = ids.select(F.col("local_id").alias("src_id"))
    stored = edges.join(wanted, "src_id", "left_semi").join(pending.select("src_id"), "src_id", "left_anti")
    rows = stored.select("src_id", "name", "dst_id").unionAll(pending.join(wanted, "src_id", "left_semi").select("src_id", "name", "dst_id"))
    return rows.groupBy(F.col("src_id").alias("local_id"), "name").agg(F.sort_array(F.collect_set("dst_id")).alias("dst_ids"))


def item_ids(asked: DataFrame, mesh_items: DataFrame) -> DataFrame:
    """pos, local_id, item_id: the drawn instances of items; unknown ids are skipped."""
    return asked.join(mesh_items.select("local_id", "item_id"), "local_id").select("pos", "local_id", "item_id")


def raw(base: DataFrame, log: DataFrame, entity: str, payload: str, ids: DataFrame | None = None) -> DataFrame:
    """local_id, payload of some (or all) entities of a kind, with the log laid over."""
    if ids is not None:
        wanted = ids.select("local_id")
        base, log = base.join(wanted, "local_id", "left_semi"), log.join(wanted, "local_id", "left_semi")
    return edits.read_overlay(base, log, entity, payload)


def raw_items(items: DataFrame, attributes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """local_id, category, guid and data, a map from attribute names to values as text; of equal names the last counts."""
    if ids is not None:
        items, attributes = (t.join(ids.select("local_id"), "local_id", "left_semi") for t in (items, attributes))
    value = F.coalesce("v_str", F.col("v_num").cast("string"))
    last = attributes.groupBy("local_id", "name").agg(F.max_by(value, "ord").alias("value"))
    maps = last.groupBy("local_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("data"))
    return items.join(maps, "local_id", "left").select("local_id", "category", "guid", F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"))


def serialized(attributes: DataFrame) -> DataFrame:
    """local_id, ord, data: attributes as JSON arrays of name, value and type; names that begin with _ are left out."""
    value = F.when(F.col("value_kind") == "number", F.to_json(F.struct(F.col("v_num").alias("v")))).otherwise(F.to_json(F.struct(F.coalesce("v_str", F.lit("")).alias("v"))))
    inner = F.substring(value, F.lit(6), F.length(value) - 6)  # {"v":...}
    quoted = [F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "") for c in ("name", "type")]
    return attributes.where(~F.col("name").startswith("_")).select("local_id", "ord", F.concat(F.lit("["), quoted[0], F.lit(","), inner, F.lit(","), quoted[1], F.lit("]")).alias("data"))


def checked_items(items: DataFrame) -> DataFrame:
    """The items; one without a category is an error."""
    named = F.when(F.col("category").isNull(), F.raise_error(F.concat(F.lit("no category: item "), F.col("local_id").cast("string"))).cast("string")).otherwise(F.col("category"))
    return items.withColumn("category", named)


def root_model_id(model_id: Column) -> Column:
    """The id of the model that a delta belongs to."""
    return F.substring_index(model_id, DELTA, 1)


def snap_data(elements: DataFrame) -> DataFrame:
    """item_id, parts of element bundles, with shells only and without materials."""
    shells = F.filter("parts", lambda p: p["class"] == "SHELL")
    return elements.select("item_id", F.transform(shells, lambda p: p.dropFields("material")).alias("parts"))


def tree_json(nodes: DataFrame, most: int = 100) -> DataFrame:
    """json of each root of nodes(node_id, parent_node_id, ord, local_id, category): nested localId, category, children.

    Level by level from the deepest: a node's children are put together by an aggregation over their parent.
    """
    from girder.operators.traversal import materialise

    level = materialise(nodes.where("parent_node_id IS NULL").withColumn("depth", F.lit(0)))
    levels = [level]
    while len(levels) <= most:
        above = level.select(F.col("node_id").alias("parent_node_id"))
        level = materialise(nodes.join(above, "parent_node_id", "left_semi").select(*nodes.columns).withColumn("depth", F.lit(len(levels))))
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise RuntimeError(f"no end after {most} levels")

    def text(children: Column) -> Column:
        own = F.to_json(F.struct(F.col("local_id").alias("localId"), F.col("category")))
        return F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.when(own != "{}", ",").otherwise(""), F.lit('"children":['), F.coalesce(children, F.lit("")), F.lit("]}"))

    told = None
    for level in reversed(levels):
        if told is None:
            done = level.withColumn("json", text(F.lit(None).cast("string")))
        else:
            inside = told.groupBy(F.col("parent_node_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ",").alias("inside"))
            done = level.join(inside, "node_id", "left").withColumn("json", text(F.col("inside")))
        told = done.select("node_id", "parent_node_id", "ord", "json")
    return told.select("node_id", "json")


def index_names(stored: DataFrame, log: DataFrame) -> DataFrame:
    """name, place: stored names that are not deleted in their order, then pending ones by when they came.

    stored(name, pos), log(seq, type, name): CREATE_INDEX, UPDATE_INDEX and DELETE_INDEX; the last entry of a name counts.
    """
    last = log.groupBy("name").agg(F.max_by("type", "seq").alias("type"), F.min("seq").alias("first"))
    both = stored.join(last, "name", "full_outer").where("type IS NULL OR type <> 'DELETE_INDEX'")
    order = Window.orderBy(F.col("pos").isNull(), "pos", "first")  # a model's index names: as many as were given by hand
    return both.select("name", (F.row_number().over(order) - 1).alias("place"))


def index_entries(stored: DataFrame, pending: DataFrame, log: DataFrame) -> DataFrame:
    """name, pos, key_num of indexes after edits: a create or update gives all keys anew, a delete takes them.

    pending(seq, name, pos, key_num) belongs to the log's entry seq.
    """
    last = log.groupBy("name").agg(F.max("seq").alias("seq"), F.max_by("type", "seq").alias("type"))
    old = stored.join(last, "name", "left_anti").select("name", "pos", "key_num")
    return old.unionAll(pending.join(last.where("type <> 'DELETE_INDEX'"), ["name", "seq"]).select("name", "pos", "key_num"))


def index_keys(keys: DataFrame, position: int | None = None) -> DataFrame:
    """name, pos, key_num: all keys, or those at one position."""
    return keys.select("name", "pos", "key_num") if position is None else keys.where(F.col("pos") == position).select("name", "pos", "key_num")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
