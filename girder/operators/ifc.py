"""Import, split and extraction of STEP models, over parsed statements (id, type, args, refs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import traversal
from girder.sources import step_text as step

#: For relation classes, the places of the relating and of the related argument (from 0), as the schema has them.
RELATION_PLACES = {
    "IFCRELVOIDSELEMENT": (4, 5), "IFCRELFILLSELEMENT": (4, 5), "IFCRELAGGREGATES": (4, 5), "IFCRELCONTAINEDINSPATIALSTRUCTURE": (5, 4),
    "IFCRELDEFINESBYPROPERTIES": (5, 4), "IFCRELDEFINESBYTYPE": (5, 4), "IFCRELASSOCIATESMATERIAL": (5, 4), "IFCRELASSOCIATESCLASSIFICATION": (5, 4),
    "IFCRELNESTS": (4, 5),
}
#: For each class, what the relation is called from the relating and from the related side.
RELATION_NAMES = {
    "IFCRELVOIDSELEMENT": ("HasOpenings", "VoidsElements"), "IFCRELFILLSELEMENT": ("HasFillings", "FillsVoids"), "IFCRELAGGREGATES": ("IsDecomposedBy", "Decomposes"),
    "IFCRELCONTAINEDINSPATIALSTRUCTURE": ("ContainsElements", "ContainedInStructure"), "IFCRELDEFINESBYPROPERTIES": ("DefinesOccurrence", "IsDefinedBy"),
    "IFCRELDEFINESBYTYPE": ("Types", "IsTypedBy"), "IFCRELASSOCIATESMATERIAL": ("AssociatedTo", "HasAssociations"),
    "IFCRELASSOCIATESCLASSIFICATION": ("ClassificationForObjects", "HasAssociations"), "IFCRELNESTS": ("IsNestedBy", "Nests"),
}
LINKING = ("IFCRELVOIDSELEMENT", "IFCRELFILLSELEMENT", "IFCRELAGGREGATES")


def references(parsed: DataFrame) -> DataFrame:
    """a, b: every reference of every statement."""
    return parsed.select(F.col("id").alias("a"), F.explode("refs").alias("b")).distinct()


def relation_pairs(parsed: DataFrame, arguments) -> DataFrame:
    """type, relating, related: relation statements, one row for each related id."""
    rows = arguments(parsed.where(F.col("type").isin(*RELATION_PLACES)))
    one, many = (F.create_map(*[F.lit(x) for t, p in RELATION_PLACES.items() for x in (t, p[k])]) for k in (0, 1))

    def ids(each, place):
        return F.transform(F.regexp_extract_all(F.element_at(each, place[F.col("type")] + 1), F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))

    def tied(each):
        return step.bound(ids(each, many), lambda related: F.flatten(F.transform(ids(each, one), lambda a: F.transform(related, lambda b: F.struct(a.alias("relating"), b.alias("related"))))))

    # arguments are named once, so each statement's are split once
    return rows.select("type", F.explode(step.bound(F.col("each"), tied)).alias("pair")).select("type", "pair.relating", "pair.related")


def relations(pairs: DataFrame) -> DataFrame:
    """src_id, name, dst_id in both directions."""
    forward, back = (F.create_map(*[F.lit(x) for t, n in RELATION_NAMES.items() for x in (t, n[k])])[F.col("type")] for k in (0, 1))
    both = [F.struct(F.col(a).alias("src_id"), name.alias("name"), F.col(b).alias("dst_id")) for a, name, b in (("relating", forward, "related"), ("related", back, "relating"))]
    return pairs.select(F.explode(F.array(*both)).alias("r")).select("r.*")


def element_clusters(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, cluster: elements that openings, fillings or aggregates tie together belong in one file."""
    elements = traversal.materialise(elements.select("id"))  # read three times
    links = pairs.where(F.col("type").isin(*LINKING)).select(F.col("relating").alias("a"), F.col("related").alias("b"))
    inside = links.join(elements.select(F.col("id").alias("a")), "a", "left_semi").join(elements.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return traversal.clusters(elements.select("id"), inside)


def _phases(counts: list[tuple[int, int]], groups: int) -> list[tuple[int, int, int, list[int]]]:
    """size, start, stop, order: of the clusters of one size, those ranked start to stop go to the groups in order, over and
    over. counts: sizes from the largest, with their numbers of clusters.

    The groups that are less than a size above the least loaded one take turns until they reach the next one's load, so there
    is a phase for each group and size at most, however many clusters there are.
    """
    loads, out = [0] * groups, []
    for size, many in counts:
        rank = 0
        while rank < many:
            least = min(loads)
            order = sorted((g for g in range(groups) if loads[g] < least + size), key=lambda g: (loads[g], g))
            above = [x for x in loads if x >= least + size]
            turns = (min(above) - least) // size * len(order) if above else many
            turns = min(turns, many - rank)
            out.append((size, rank, rank + turns, order))
            for place, g in enumerate(order):
                loads[g] += size * (turns // len(order) + (place < turns % len(order)))
            rank += turns
    return out


def pack(clusters: DataFrame, groups: int) -> DataFrame:
    """id, group_id: clusters by falling size, ties by id, each to the group with the least so far (the lowest on a tie).

    The driver sees how many clusters have each size, and says which ranks of a size go where; ranks are counted within
    ranges of ids.
    """
    if isinstance(groups, bool) or not isinstance(groups, int) or groups < 1:
        raise ValueError("the number of groups must be a positive integer")
    sizes = traversal.materialise(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("cluster") / 65536)))
    ranges = sizes.groupBy("n", "range").agg(F.count(F.lit(1)).alias("many"))
    counts = ranges.groupBy("n").agg(F.sum("many").alias("many")).orderBy(F.desc("n")).collect()  # k different sizes take k * k / 2 elements
    told = [(n, start, stop, order) for n, start, stop, order in _phases([(r["n"], r["many"]) for r in counts], groups)]
    phases = clusters.sparkSession.createDataFrame(told, "n long, start long, stop long, order array<int>")
    before = ranges.withColumn("before", F.sum("many").over(Window.partitionBy("n").orderBy("range")) - F.col("many")).drop("many")
    rank = F.row_number().over(Window.partitionBy("n", "range").orderBy("cluster")) - 1
    ranked = sizes.withColumn("rank", rank).join(before, ["n", "range"]).select("cluster", "n", (F.col("before") + F.col("rank")).alias("rank"))
    own = ranked.join(phases, "n").where("rank >= start AND rank < stop")
    placed = own.select("cluster", F.get("order", F.pmod(F.col("rank") - F.col("start"), F.size("order")).cast("int")).alias("group_id"))
    return clusters.join(placed, "cluster").select("id", "group_id")


def extract(parsed: DataFrame, wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """id: the wanted elements and all that they need; other elements are named but not followed."""
    if wanted.join(elements, "id", "left_semi").isEmpty():
        raise ValueError("none of the ids is an element")
    start = wanted.join(elements, "id", "left_semi")
    return traversal.closure(start, references(parsed), stop=elements).select("id")


def split(parsed: DataFrame, members: DataFrame, shared: DataFrame) -> DataFrame:
    """group_id, id: the statements of each file: shared ones in all, members and their references in theirs."""
    needs = references(parsed)
    own = members.select("group_id", "id")
    step = own.join(needs, F.col("id") == F.col("a")).select("group_id", F.col("b").alias("id"))
    groups = members.select("group_id").distinct()
    return own.unionAll(step).unionAll(groups.crossJoin(shared.select("id"))).distinct()


def with_shared(needed: DataFrame, members: DataFrame, shared: DataFrame) -> DataFrame:
    """group_id, id: what each group needs and the shared statements, which stand in the file of every group."""
    groups = members.select("group_id").distinct()
    return needed.select("group_id", "id").unionAll(groups.crossJoin(shared.select("id"))).distinct()


def rewrite_lists(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """type, relating, group_id, related: lists of relations cut down to a group's members; empty ones go."""
    kept = pairs.join(members.select(F.col("id").alias("related"), "group_id"), "related")
    return kept.groupBy("type", "relating", "group_id").agg(F.sort_array(F.collect_set("related")).alias("related"))


def absolute_elevations(nodes: DataFrame, factor: float = 1.0, most: int = 100) -> DataFrame:
    """id, elevation: own plus all elevations above, times a unit factor; nodes(id, parent_id, elevation).

    Level by level from the roots; a null elevation counts as 0.
    """
    rows = nodes.select("id", "parent_id", F.coalesce("elevation", F.lit(0.0)).alias("own"))
    level = traversal.materialise(rows.where("parent_id IS NULL").select("id", F.col("own").alias("elevation")))
    out = level
    for _ in range(most):
        above = level.select(F.col("id").alias("parent_id"), F.col("elevation").alias("above"))
        level = traversal.materialise(rows.join(above, "parent_id").select("id", (F.col("own") + F.col("above")).alias("elevation")))
        if level.isEmpty():
            return out.select("id", (F.col("elevation") * factor).alias("elevation"))
        out = out.unionByName(level)
    raise RuntimeError(f"no end after {most} levels")


def unit_factor(prefix: str | None, unit: str) -> float:
    """Metres in a length unit."""
    return {"METRE": 1.0, "FOOT": 0.3048}[unit] * {None: 1.0, "MILLI": 1e-3, "CENTI": 1e-2, "DECI": 1e-1}[prefix]


def attributes(parsed: DataFrame, arguments, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, ord, name, value_kind, v_str, v_num, type of scalar arguments; names: of each class's arguments in order.

    References and lists of references are relations, $ and * are nothing, 'text' is a string, .T. and .F. are
    truth values, TYPE(value) is unwrapped and keeps its type.
    """
    table = F.create_map(*[x for t, each in names.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in each]))])
    rows = arguments(parsed.where(F.col("type").isin(*names)).withColumn("names", table[F.col("type")]))
    each = rows.select("id", "names", F.posexplode("each").alias("ord", "raw"))
    typed = F.regexp_extract("raw", r"^([A-Z][A-Z0-9]*)\((.*)\)$", 1)
    inner = F.when(typed != "", F.regexp_extract("raw", r"^([A-Z][A-Z0-9]*)\((.*)\)$", 2)).otherwise(F.col("raw"))
    out = each.select("id", "ord", F.get("names", F.col("ord")).alias("name"), inner.alias("value"), typed.alias("typed"))
    out = out.where("name IS NOT NULL AND value NOT IN ('$', '*') AND NOT value RLIKE '^#|^\\\\(' ")
    text, truth = F.col("value").startswith("'"), F.col("value").isin(".T.", ".F.")
    number = F.expr("try_cast(value AS double)")
    kind = F.when(text, "string").when(truth, "boolean").when(number.isNotNull(), "number").otherwise("string")
    body = F.when(text, F.regexp_replace(F.regexp_replace("value", r"^'|'$", ""), "''", "'")).when(~truth & number.isNull(), F.regexp_replace("value", r"^\.|\.$", ""))
    guess = F.when(kind == "number", F.when(F.col("value").rlike(r"^-?\d+$"), "IFCINTEGER").otherwise("IFCREAL")).when(kind == "boolean", "IFCBOOLEAN").otherwise("IFCLABEL")
    return out.select("id", "ord", "name", kind.alias("value_kind"), body.alias("v_str"), F.when(kind == "number", number).alias("v_num"), F.when(truth, F.col("value") == ".T.").alias("v_bool"), F.when(F.col("typed") != "", F.col("typed")).otherwise(guess).alias("type"))
