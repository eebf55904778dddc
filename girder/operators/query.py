"""The item query engine: categories, attributes, relations to items that match a query themselves.

Everything is semi-joins over ``items``, ``attributes`` and ``edges``; filters on names and values reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.patterns import found_in, matches


@dataclass(frozen=True)
class Attribute:
    """name: pattern. value: pattern(s) for strings, or a number or truth value to equal. type: pattern."""

    name: str
    value: object = None
    type: str | None = None
    negate: bool = False


@dataclass(frozen=True)
class Query:
    """categories: patterns, or None for any. attributes with "exclusive" (all hold) or "inclusive" (any does).

    relation: its name; target: the query that an item at its other end must match, None for mere existence.
    local_ids: the only candidates, None for all.
    """

    categories: tuple[str, ...] | None = None
    attributes: tuple[Attribute, ...] | None = None
    aggregation: str = "exclusive"
    relation: str | None = None
    target: Query | None = None
    local_ids: tuple[int, ...] | None = field(default=None)


@dataclass(frozen=True)
class Part:
    """The items of one category: what names their attributes have, and the attributes of given names."""

    category: str
    items: DataFrame
    names: tuple[str, ...]
    attributes: Callable[[tuple[str, ...]], DataFrame]


@dataclass(frozen=True)
class Model:
    """items(local_id, category, guid), attributes(local_id, ord, name, value_kind, v_str, v_num, [v_bool,] type),
    edges(src_id, name, dst_id); heads(src_id, name) where lists of no targets exist too. parts: the items and
    attributes by category, where they are stored so; queries then read no part that cannot match."""

    items: DataFrame
    attributes: DataFrame
    edges: DataFrame
    heads: DataFrame | None = None
    parts: tuple[Part, ...] | None = None

    def narrowed(self, categories: tuple[str, ...] | None, names: tuple[str, ...] | None) -> Model:
        """The model without parts of other categories and without attributes of other names (patterns, None: any)."""
        if self.parts is None:
            return self
        spark = self.items.sparkSession
        kept = [p for p in self.parts if categories is None or found_in(spark, p.category, categories)]
        wanted = [(p, tuple(n for n in p.names if names is None or found_in(spark, n, names))) for p in kept]
        some = [p.attributes(own) for p, own in wanted if own]
        items = reduce(DataFrame.unionAll, [p.items for p in kept]) if kept else self.items.where(F.lit(False))
        return replace(self, items=items, attributes=reduce(DataFrame.unionAll, some) if some else self.attributes.where(F.lit(False)), parts=tuple(kept))


def holds(a: Attribute, strict: bool = False) -> Column:
    """The predicate on a row of attributes, null or false where it does not hold. strict: a type without a value
    never holds."""
    test = matches(F.col("name"), a.name)
    if a.value is not None:
        if isinstance(a.value, bool):
            test = test & (F.col("value_kind") == "boolean") & (F.col("v_bool") == F.lit(a.value))
        elif isinstance(a.value, (int, float)):
            test = test & (F.col("value_kind") == "number") & (F.col("v_num") == F.lit(float(a.value))) & ~F.isnan("v_num")
        else:
            test = test & (F.col("value_kind") == "string") & matches(F.col("v_str"), a.value)
    if a.type is not None:
        test = test & matches(F.col("type"), a.type)
        if strict and a.value is None:
            return F.lit(False)
    return test


def items_of_categories(items: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Items whose category matches any pattern; no pattern matches none, a null category never does."""
    return items.where(matches(F.col("category"), patterns) if patterns else F.lit(False))


def items_by_attributes(model: Model, queries: tuple[Attribute, ...], aggregation: str = "exclusive", categories: tuple[str, ...] | None = None) -> DataFrame:
    """local_id of items (of the categories) that satisfy all (exclusive) or any (inclusive) of the queries; no query
    gives nothing.

    One pass: each attribute row is tested against all queries, a group has a flag for each. Negated queries
    hold for items without a satisfying attribute, also for those without any attribute.
    """
    if not queries:
        return model.items.select("local_id").where(F.lit(False))
    model = model.narrowed(categories, tuple(q.name for q in queries))
    tests = [holds(q) for q in queries]
    rows = model.attributes.where(reduce(Column.__or__, tests))
    if len(queries) == 1 and not queries[0].negate:
        return rows.select("local_id").distinct()
    flags = rows.groupBy("local_id").agg(*[F.max(t).alias(f"q{k}") for k, t in enumerate(tests)])
    wanted = [F.coalesce(F.col(f"q{k}"), F.lit(False)) != F.lit(q.negate) for k, q in enumerate(queries)]
    combined = reduce(Column.__and__ if aggregation == "exclusive" else Column.__or__, wanted)
    if not any(q.negate for q in queries):
        return flags.where(combined).select("local_id")
    return model.items.select("local_id").join(flags, "local_id", "left").where(combined).select("local_id")


def items_by_relation(model: Model, name: str, targets: DataFrame | None) -> DataFrame:
    """local_id of items with the relation; with targets, of those that reach one."""
    if targets is None:
        heads = model.heads if model.heads is not None else model.edges
        return heads.where(F.col("name") == name).select(F.col("src_id").alias("local_id")).distinct()
    mine = model.edges.where(F.col("name") == name)
    return mine.join(targets.select(F.col("local_id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("local_id")).distinct()


def item_query(model: Model, query: Query) -> DataFrame:
    """local_id of matching items, each once. A query without any condition matches nothing."""
    if not query.categories and query.attributes is None and query.relation is None and query.local_ids is None:
        return model.items.select("local_id").where(F.lit(False))
    categories = query.categories or None
    if query.local_ids is not None and query.categories is not None and not query.categories:
        return model.items.select("local_id").where(F.lit(False))
    small = model.narrowed(categories, ())
    found = items_of_categories(small.items, categories) if categories else small.items
    if query.local_ids is not None:
        found = found.where(F.col("local_id").isin(list(query.local_ids)) if query.local_ids else F.lit(False))
    found = found.select("local_id")
    if query.attributes is not None:
        some = items_by_attributes(model, query.attributes, query.aggregation, categories)
        # attributes of a narrowed model are of items of these categories only
        found = some if model.parts is not None and query.local_ids is None else found.join(some, "local_id", "left_semi")
    if query.relation:
        targets = None if query.target is None else item_query(model, query.target)
        found = found.join(items_by_relation(model, query.relation, targets), "local_id", "left_semi")
    return found


@dataclass(frozen=True)
class UniqueSpec:
    """get: pattern of the attribute's name; conditions: on other attributes, any must hold unless exclusive."""

    get: str
    key: str | None = None
    categories: tuple[str, ...] | None = None
    conditions: tuple[Attribute, ...] = ()
    aggregation: str = "inclusive"


def unique_values(model: Model, specs: tuple[UniqueSpec, ...]) -> DataFrame:
    """key, value_kind, v_str, v_num, local_ids (sorted): the values of the first matching attribute of each item."""
    out = []
    for spec in specs:
        rows = model.narrowed(spec.categories, (spec.get,)).attributes.where(matches(F.col("name"), spec.get))
        first = rows.groupBy("local_id").agg(F.min(F.struct("ord", "name", "value_kind", "v_str", "v_num")).alias("a")).select("local_id", "a.*")
        if spec.categories is not None and model.parts is None:
            first = first.join(items_of_categories(model.items, spec.categories).select("local_id"), "local_id", "left_semi")
        if spec.conditions:
            first = first.join(items_by_attributes(model, spec.conditions, spec.aggregation, spec.categories), "local_id", "left_semi")
        out.append(first.withColumn("key", F.lit(spec.key) if spec.key else F.col("name")))
    rows = reduce(DataFrame.unionByName, out)
    return rows.groupBy("key", "value_kind", "v_str", "v_num").agg(F.sort_array(F.collect_set("local_id")).alias("local_ids"))


def attribute_map(model: Model, ids: DataFrame | None = None) -> DataFrame:
    """local_id, attributes: a map from name to value as text; of attributes with equal names the last counts."""
    rows = model.attributes if ids is None else model.attributes.join(ids.select("local_id"), "local_id", "left_semi")
    value = F.coalesce("v_str", F.col("v_num").cast("string"))
    last = rows.groupBy("local_id", "name").agg(F.max_by(value, "ord").alias("value"))
    return last.groupBy("local_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("attributes"))


def relation_map(model: Model, ids: DataFrame | None = None) -> DataFrame:
    """local_id, name, dst_ids (sorted): each relation of each item."""
    rows = model.edges if ids is None else model.edges.join(ids.select(F.col("local_id").alias("src_id")), "src_id", "left_semi")
    return rows.groupBy(F.col("src_id").alias("local_id"), "name").agg(F.sort_array(F.collect_set("dst_id")).alias("dst_ids"))


def inverse_relations(edges: DataFrame, name: str, inverse: str) -> DataFrame:
    """The edges of one relation turned round under another name."""
    return edges.where(F.col("name") == name).select(F.col("dst_id").alias("src_id"), F.lit(inverse).alias("name"), F.col("src_id").alias("dst_id"))


def look_up(asked: DataFrame, items: DataFrame, by: str, get: str) -> DataFrame:
    """Every asked row (pos, by) with what is found, null where nothing is; order and repetition are kept by pos."""
    return asked.join(items.select(by, get), by, "left").select("pos", by, get)


def positions_once(item_ids: DataFrame, mesh_items: DataFrame) -> DataFrame:
    """local_id of (pos, item_id) rows, each once, at its first place; unknown ids are skipped."""
    return item_ids.join(mesh_items, "item_id").groupBy("local_id").agg(F.min("pos").alias("pos"))
