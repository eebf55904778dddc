"""The edit log and what is read through it.

The log is append-only: seq, type (CREATE_ITEM, UPDATE_ITEM, DELETE_ITEM ...), local_id, a payload column. A
version is a prefix of it; undone entries are inactive. Reading replays in order (a create after a delete brings
an entity back); committing lets deletes win whatever their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of(log: DataFrame, entity: str) -> DataFrame:
    """The entries on one kind of entity, as create, update or delete."""
    return log.where(F.col("type").isin(f"CREATE_{entity}", f"UPDATE_{entity}", f"DELETE_{entity}")).withColumn("action", F.substring_index("type", "_", 1))


def select(log: DataFrame, version: int) -> DataFrame:
    """The log as of an entry: undo and redo move the version."""
    return log.where(F.col("seq") <= version)


def append_after_undo(log: DataFrame, version: int, new: DataFrame) -> DataFrame:
    """A new action removes what was undone."""
    return select(log, version).unionByName(new)


def latest(log: DataFrame, entity: str, payload: str) -> DataFrame:
    """local_id, action, payload of the last entry of each entity: one aggregation, no sort."""
    rows = of(log, entity)
    return rows.groupBy("local_id").agg(F.max_by(F.struct("action", payload), "seq").alias("last")).select("local_id", "last.action", F.col(f"last.{payload}").alias(payload))


def read_overlay(base: DataFrame, log: DataFrame, entity: str, payload: str) -> DataFrame:
    """local_id, payload: the base with the last action on each entity applied."""
    last = latest(log, entity, payload).withColumnRenamed(payload, "_new")
    both = base.select("local_id", payload).join(last, "local_id", "full_outer")
    return both.where("action IS NULL OR action <> 'DELETE'").select("local_id", F.when(F.col("action").isNull(), F.col(payload)).otherwise(F.col("_new")).alias(payload))


def commit(base: DataFrame, log: DataFrame, entity: str, payload: str, keys: tuple[str, ...] = ("local_id",)) -> DataFrame:
    """keys, payload: as saved. Deletes win; the last update replaces; creates of ids that exist are ignored."""
    rows = of(log, entity)
    state = rows.groupBy(*keys).agg(
        F.max(F.col("action") == "DELETE").alias("deleted"),
        F.max(F.col("action") == "CREATE").alias("created"),
        F.max(F.col("action") == "UPDATE").alias("updated"),
        F.max_by(payload, F.when(F.col("action") == "UPDATE", F.col("seq"))).alias("_updated"),
        F.min_by(payload, F.when(F.col("action") == "CREATE", F.col("seq"))).alias("_created"),
    )
    both = base.select(*keys, payload, F.lit(True).alias("there")).join(state, list(keys), "full_outer")
    kept = both.where("NOT coalesce(deleted, false) AND (there OR created)")
    value = F.when(F.coalesce("updated", F.lit(False)), F.col("_updated")).when(F.col("there"), F.col(payload)).otherwise(F.col("_created"))
    return kept.select(*keys, value.alias(payload))


def overlay_ids(base: DataFrame, log: DataFrame, entity: str) -> DataFrame:
    """local_id: deletes remove and creates add, in order; updates change nothing."""
    rows = of(log, entity).where("action <> 'UPDATE'")
    last = rows.groupBy("local_id").agg(F.max_by("action", "seq").alias("action"))
    both = base.select("local_id", F.lit(True).alias("there")).join(last, "local_id", "full_outer")
    return both.where("action = 'CREATE' OR (there AND action IS NULL)").select("local_id")


def latest_document(log: DataFrame, type_: str, payload: str) -> DataFrame:
    """The last entry of a kind that replaces a whole document (metadata, spatial structure)."""
    return log.where(F.col("type") == type_).agg(F.max_by(payload, "seq").alias(payload), F.max("seq").alias("seq"))


def allocate(requests: DataFrame, next_id: Column | int, blocks: int = 64) -> DataFrame:
    """seq, temp_id, local_id: requests without an id get consecutive ones in order of seq.

    Sequence numbers are ranked in ranges of equal width: counts of the ranges give each its first id, and a
    window ranks within a range only, so that no task sees all requests.
    """
    bounds = requests.agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    ranged = requests.crossJoin(F.broadcast(bounds)).withColumn("range", F.floor((F.col("seq") - F.col("low")) * blocks / (F.col("high") - F.col("low") + 1))).drop("low", "high")
    counts = ranged.where("local_id IS NULL").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # at most ``blocks`` rows
    rank = F.row_number().over(Window.partitionBy("range", F.col("local_id").isNull()).orderBy("seq"))
    numbered = ranged.withColumn("rank", rank).join(F.broadcast(firsts), "range", "left")
    fresh = (next_id if isinstance(next_id, Column) else F.lit(next_id)) + F.col("before") + F.col("rank") - 1
    return numbered.select("seq", "temp_id", F.coalesce("local_id", fresh).cast("long").alias("local_id"))


def relate(edges: DataFrame, added: DataFrame, removed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges (src_id, name, dst_id) with some added and some removed; edges of deleted(local_id) items go."""
    keys = ["src_id", "name", "dst_id"]
    now = edges.select(*keys).join(removed.select(*keys), keys, "left_anti").unionByName(added.select(*keys)).distinct()
    gone = deleted.select("local_id")
    return now.join(gone.withColumnRenamed("local_id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("local_id", "dst_id"), "dst_id", "left_anti").select(*keys)


def delta_ids(samples: DataFrame, propagating: DataFrame, still: DataFrame, columns: tuple[str, ...] = ("item_id", "repr_id", "material")) -> DataFrame:
    """kind, id: what a change touches.

    samples: what each instance refers to. propagating(kind, id): changed resources; every sample that uses one brings its
    item. still(kind, id): resources that are only used by edited samples. Then all that samples of touched items, or
    samples on propagating resources, refer to is in the delta.
    """
    def users(kind: str, of_: DataFrame) -> DataFrame:
        ids = of_.where(F.col("kind") == kind).select(F.col("id").alias(kind))
        return samples.join(ids.select(F.col(kind).cast(samples.schema[kind].dataType)), kind, "left_semi")

    touched = None
    for kind in columns:
        part = users(kind, propagating).select("item_id")
        touched = part if touched is None else touched.unionAll(part)
    touched = touched.distinct()
    direct = samples.join(touched, "item_id", "left_semi")
    found = propagating.select("kind", F.col("id").cast("string").alias("id")).unionAll(still.select("kind", F.col("id").cast("string").alias("id")))
    pairs = direct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("id")) for k in columns])).alias("p")).select("p.kind", "p.id")
    return found.unionAll(pairs).distinct()


def unused(resources: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Resources that nothing uses any more, safe to delete."""
    return resources.join(used.select(key), key, "left_anti")


def affected_items(samples: DataFrame, edited: DataFrame) -> DataFrame:
    """item_id of the samples that are updated or deleted."""
    return samples.join(edited.select("sample_id"), "sample_id", "left_semi").select("item_id").distinct()
