"""The item model over an ordinary star schema.

Every row of region, nation, customer, supplier, part and orders is an item with
``local_id = key * 8 + tag``; its other columns are attributes, foreign keys are relations in both
directions, and rows of lineitem are samples (drawn instances) of parts for orders. One description drives
the DataFrames here and the SQL of the tests.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.query import Part

#: table, tag, key column, attribute columns with their kind
TABLES = (
    ("region", 1, "r_regionkey", (("r_name", "string"),)),
    ("nation", 2, "n_nationkey", (("n_name", "string"),)),
    ("customer", 3, "c_custkey", (("c_name", "string"), ("c_acctbal", "number"), ("c_mktsegment", "string"))),
    ("supplier", 4, "s_suppkey", (("s_name", "string"), ("s_acctbal", "number"))),
    ("part", 5, "p_partkey", (("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "number"), ("p_retailprice", "number"))),
    ("orders", 6, "o_orderkey", (("o_orderstatus", "string"), ("o_totalprice", "number"), ("o_orderdate", "date"), ("o_orderpriority", "string"))),
)
#: name, inverse name, table that holds the keys, source (key column, tag), target (key column, tag)
RELATIONS = (
    ("InRegion", "HasNations", "nation", ("n_nationkey", 2), ("n_regionkey", 1)),
    ("InNation", "HasCustomers", "customer", ("c_custkey", 3), ("c_nationkey", 2)),
    ("InNation", "HasSuppliers", "supplier", ("s_suppkey", 4), ("s_nationkey", 2)),
    ("PlacedBy", "Placed", "orders", ("o_orderkey", 6), ("o_custkey", 3)),
    ("ContainsPart", "PartOf", "lineitem", ("l_orderkey", 6), ("l_partkey", 5)),
    ("SuppliedBy", "Supplies", "lineitem", ("l_partkey", 5), ("l_suppkey", 4)),
)
TAGS = {name: tag for name, tag, *_ in TABLES}


_read: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Before a query is built: tables are looked up anew."""
    _read.clear()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; while a query is built, each is looked up once."""
    key = (id(spark), sf_dir, name)
    if key not in _read:
        _read[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _read[key]


def local_id(key: str, tag: int) -> Column:
    return F.col(key).cast("long") * 8 + tag


def _items_of(spark: SparkSession, sf_dir: str, name: str, tag: int, key: str) -> DataFrame:
    return read(spark, sf_dir, name).select(local_id(key, tag).alias("local_id"), F.lit(name.upper()).alias("category"), F.concat(F.lit(f"{name.upper()}:"), F.col(key).cast("string")).alias("guid"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local_id, category, guid."""
    return reduce(DataFrame.unionAll, [_items_of(spark, sf_dir, name, tag, key) for name, tag, key, _ in TABLES])


def _attribute(ord_: int, column: str, kind: str) -> list[Column]:
    text = F.date_format(column, "yyyy-MM-dd") if kind == "date" else F.col(column)
    none = F.lit(None)
    return [
        F.lit(ord_).alias("ord"),
        F.lit(column).alias("name"),
        F.lit("number" if kind == "number" else "string").alias("value_kind"),
        (none if kind == "number" else text).cast("string").alias("v_str"),
        (F.col(column) if kind == "number" else none).cast("double").alias("v_num"),
        F.lit({"number": "IFCREAL", "string": "IFCLABEL", "date": "IFCDATE"}[kind]).alias("type"),
    ]


def _attributes_of(spark: SparkSession, sf_dir: str, name: str, tag: int, key: str, columns: tuple, only: tuple[str, ...]) -> DataFrame:
    """One scan of one table: one attribute is selected, several become an array of structs, which is exploded."""
    each = [_attribute(ord_, column, kind) for ord_, (column, kind) in enumerate(columns) if column in only]
    rows, me = read(spark, sf_dir, name), local_id(key, tag).alias("local_id")
    if len(each) == 1:
        return rows.select(me, *each[0])
    return rows.select(me, F.explode(F.array(*[F.struct(*a) for a in each])).alias("a")).select("local_id", "a.*")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local_id, ord, name, value_kind, v_str, v_num, type: one row for each attribute of each item."""
    return reduce(DataFrame.unionAll, [_attributes_of(spark, sf_dir, name, tag, key, columns, tuple(c for c, _ in columns)) for name, tag, key, columns in TABLES])


def parts(spark: SparkSession, sf_dir: str) -> tuple[Part, ...]:
    """The same by category, for queries that name what they want."""
    return tuple(
        Part(name.upper(), _items_of(spark, sf_dir, name, tag, key), tuple(c for c, _ in columns), partial(_attributes_of, spark, sf_dir, name, tag, key, columns))
        for name, tag, key, columns in TABLES
    )


def edges(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """src_id, name, dst_id in both directions; ``only`` names the relations that are wanted, before any scan."""
    parts = []
    for name, inverse, table, (source, source_tag), (target, target_tag) in RELATIONS:
        wanted = [n for n in (name, inverse) if only is None or n in only]
        if not wanted:
            continue
        pairs = read(spark, sf_dir, table).select(local_id(source, source_tag).alias("a"), local_id(target, target_tag).alias("b"))
        if table == "lineitem":
            pairs = pairs.distinct()
        for n in wanted:
            a, b = ("a", "b") if n == name else ("b", "a")
            parts.append(pairs.select(F.col(a).alias("src_id"), F.lit(n).alias("name"), F.col(b).alias("dst_id")))
    return reduce(DataFrame.unionAll, parts)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with what they refer to: item, representation, material, both translations."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_partkey").alias("repr_id"),
        F.concat("l_returnflag", "l_linestatus").alias("material"),
        F.col("l_quantity").alias("lx"),
        (F.col("l_discount") * 100).alias("ly"),
        (F.col("l_tax") * 100).alias("lz"),
    )


def global_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and its translation: (order key mod 100, nation of the customer, 0)."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 100).cast("double").alias("gx"), F.col("c_nationkey").cast("double").alias("gy"), F.lit(0.0).alias("gz")
    )


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repr_id and its box: [0,0,0] to [size, size/2, 1]."""
    size = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("repr_id"), zero.alias("minx"), zero.alias("miny"), zero.alias("minz"), size.alias("maxx"), (size / 2).alias("maxy"), F.lit(1.0).alias("maxz"))


def placed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with full local placements: lines of one order and number are one sample, of the smallest part; every
    other number is turned about z."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("repr_id"), F.min("l_quantity").alias("lpx"))
    turned = F.col("l_linenumber") % 2 == 1
    zero = F.lit(0.0)
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id"), F.col("l_orderkey").alias("item_id"), "repr_id", "lpx", (F.col("l_linenumber") * 2.0).alias("lpy"), zero.alias("lpz"),
        F.when(turned, 0.6).otherwise(1.0).alias("lxx"), F.when(turned, 0.8).otherwise(0.0).alias("lxy"), zero.alias("lxz"),
        F.when(turned, -0.8).otherwise(0.0).alias("lyx"), F.when(turned, 0.6).otherwise(1.0).alias("lyy"), zero.alias("lyz"),
    )


def placed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with full global placements: as global_transforms, turned about z in one of three ways."""
    way = F.col("item_id") % 3
    zero = F.lit(0.0)
    return global_transforms(spark, sf_dir).select(
        "item_id", F.col("gx").alias("gpx"), F.col("gy").alias("gpy"), F.col("gz").alias("gpz"),
        F.when(way == 0, 1.0).when(way == 1, 0.0).otherwise(0.8).alias("gxx"), F.when(way == 0, 0.0).when(way == 1, 1.0).otherwise(-0.6).alias("gxy"), zero.alias("gxz"),
        F.when(way == 0, 0.0).when(way == 1, -1.0).otherwise(0.6).alias("gyx"), F.when(way == 0, 1.0).when(way == 1, 0.0).otherwise(0.8).alias("gyy"), zero.alias("gyz"),
    )


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ray for each nation: ray_id, origin and direction. It passes the heights of the model within half a unit of x."""
    k = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(
        k.alias("ray_id"), F.lit(-60.0).alias("ox"), (0.37 + k % 25).alias("oy"), (0.11 - ((k * 7) % 100 + 60) * 2.0).alias("oz"),
        F.lit(1.0).alias("dx"), ((k % 11) * 0.0137 - 0.05).alias("dy"), ((k % 13) * 0.0002 + 2.0).alias("dz"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, type, local_id, value: events as edits of customers."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'CREATE_ITEM' WHEN 'error' THEN 'DELETE_ITEM' WHEN 'view' THEN 'UPDATE_RELATION' ELSE 'UPDATE_ITEM' END")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("type"), local_id("user_id", 3).alias("local_id"), "value")
