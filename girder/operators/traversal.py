"""Trees and graphs: closures, descendants, item data, clusters.

Graphs may hold cycles, so closures are loops: join the frontier with the edges, leave out what was seen, write the
round's table. The driver sees one number a round.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one of this machine where that is unset and everything runs here (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "girder-rounds")
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> tuple:
    """A path of its own in the shared folder, which goes when the application ends, with its file system."""
    folder = f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return f"{folder}/table", system, where


def materialise(df: DataFrame) -> DataFrame:
    """A table in the shared folder of spark.checkpoint.dir, read again; cuts the lineage and outlives executors."""
    path, *written = scratch(df.sparkSession, "girder-rounds")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = tuple(written)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() has written and that nothing will read any more."""
    for df in tables:
        system, where = df._written
        system.delete(where, True)


def closure(start: DataFrame, edges: DataFrame, stop: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """id, depth: everything that is reached from start(id) along edges(a, b), the start included.

    stop(id): places that are reached but not passed (a start is passed in any case).
    """
    seen = materialise(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, most + 1):
        walk = frontier if stop is None or depth == 1 else frontier.join(stop.select("id"), "id", "left_anti")
        reached = walk.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = materialise(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"no end after {most} rounds")


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """local_id of all that lies below roots(local_id) in nodes(node_id, parent_node_id, local_id).

    Nodes without a local id group others and are passed, not returned; a root is returned only if it lies
    below another.
    """
    kept = materialise(nodes.select("node_id", "parent_node_id", "local_id"))
    top = kept.join(roots, "local_id", "left_semi").select(F.col("node_id").alias("a"))
    children = kept.where("parent_node_id IS NOT NULL").select(F.col("parent_node_id").alias("a"), F.col("node_id").alias("b"))
    first = children.join(top, "a", "left_semi").select(F.col("b").alias("id"))
    below = closure(first, children).select("id")
    return kept.join(below, kept.node_id == below.id, "left_semi").where("local_id IS NOT NULL").select("local_id").distinct()


@dataclass(frozen=True)
class Expansion:
    """Whether a related item brings its attributes and its own relations."""

    attributes: bool = False
    relations: bool = False


@dataclass(frozen=True)
class DataConfig:
    """relations: for each relation's name its expansion; a child of an unnamed relation takes its parent's."""

    relations: dict[str, Expansion] = field(default_factory=dict)
    default: Expansion = field(default_factory=Expansion)


def item_data(edges: DataFrame, roots: DataFrame, config: DataConfig, most: int = 100) -> DataFrame:
    """root, parent, name, local_id, depth, with_attributes: every related item that the configuration opens.

    A related item that was met before below the same root is named again but not opened again.
    """
    rules = [(n, e.attributes, e.relations) for n, e in config.relations.items()]

    def pick(own, above, which: str):
        out = F.lit(getattr(config.default, which))
        chain = None
        for n, a, r in rules:
            flag = F.lit(a if which == "attributes" else r)
            chain = F.when(above == n, flag) if chain is None else chain.when(above == n, flag)
        out = chain.otherwise(out) if chain is not None else out
        chain = None
        for n, a, r in rules:
            flag = F.lit(a if which == "attributes" else r)
            chain = F.when(own == n, flag) if chain is None else chain.when(own == n, flag)
        return chain.otherwise(out) if chain is not None else out

    base = roots.select(F.col("local_id").alias("root"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("name"), "local_id", F.lit(0).alias("depth"), F.lit(True).alias("with_attributes"), F.lit(True).alias("opens"))
    seen = materialise(base)
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.where("opens").select("root", F.col("local_id").alias("src_id"), F.col("name").alias("above")).join(edges, "src_id")
        step = step.withColumn("with_attributes", pick(F.col("name"), F.col("above"), "attributes")).withColumn("opens", pick(F.col("name"), F.col("above"), "relations"))
        step = step.where("with_attributes OR opens").select("root", F.col("src_id").alias("parent"), "name", F.col("dst_id").alias("local_id"), F.lit(depth).alias("depth"), "with_attributes", "opens")
        known = seen.select("root", "local_id").distinct().withColumn("known", F.lit(True))
        step = step.join(known, ["root", "local_id"], "left").withColumn("opens", F.col("opens") & F.col("known").isNull()).select(*seen.columns)
        frontier = materialise(step)
        if frontier.isEmpty():
            return seen.drop("opens")
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"no end after {most} rounds")


def clusters(nodes: DataFrame, links: DataFrame, most: int = 1000) -> DataFrame:
    """id, cluster: the smallest id that links(a, b) lead to, in either direction; nodes(id) without links are alone."""
    both = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.select("id").unionAll(both.select(F.col("a").alias("id"))).distinct().withColumn("cluster", F.col("id")))
    for _ in range(most):
        told = both.join(labels, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "cluster")
        heard = told.unionAll(labels).groupBy("id").agg(F.min("cluster").alias("cluster"))
        jump = heard.select(F.col("id").alias("to"), F.col("cluster").alias("further"))
        after = materialise(heard.join(jump, F.col("cluster") == F.col("to")).select("id", F.least("cluster", "further").alias("cluster")))
        settled = after.join(labels.withColumnRenamed("cluster", "before"), "id").where("cluster <> before").isEmpty()
        discard(labels)
        if settled:
            discard(both)
            return after
        labels = after
    raise RuntimeError(f"no end after {most} rounds")
