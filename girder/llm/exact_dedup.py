"""Exact deduplication by skew-safe combining. DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space becomes one space.
Three combining steps, each of which groups by digest *and* full content:

1. within a task (the map-side half of the first aggregation), 2. by digest and salt, where the
salt is the task that read the rows, 3. by digest, over the winners of the salts.

A group of copies, however large, is one row for each task after step 1 and at most ``salts`` rows
after step 2, so no key is hot. Giving every document its group again is a join by digest: groups
of more than 1/1000 of all rows (fewer than 1000 can exist) are broadcast, the others are joined by
shuffle. Should two contents ever share a digest, the documents of that digest are joined by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

WHITE = r"[\x20\x09-\x0D]+"
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """digest, keep_id, group_size, content for each distinct normalised text.

    Null text counts as empty. A null id loses to any other; a group of null ids only keeps null.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.select("_id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Of rows that repeat both id and text, all are
    marked kept (they are one document written twice). Null text is empty; a null id is never kept
    unless its whole group has none. Empty tables give an empty result; other columns are not read.
    """
    groups = keep(exact_groups(docs, id_col, text_col, salts, digest).drop("content"), "exact-groups")
    clashing = groups.groupBy("digest").count().where("count > 1").select("digest")
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.select("_id", digest(F.col("content")).alias("digest"), sha256(F.col("content")).alias("text_sha256"), "content")
    if clashing.isEmpty():
        found = _with_groups(rows.drop("content"), groups)
    else:
        apart = keep(clashing, "clashing-digests")
        full = exact_groups(docs, id_col, text_col, salts, digest).join(apart, "digest", "left_semi")
        full = full.select(F.col("digest").alias("d"), F.col("content").alias("c"), "keep_id", "group_size")
        clear = _with_groups(rows.join(apart, "digest", "left_anti").drop("content"), groups)
        mixed = rows.join(apart, "digest", "left_semi").join(full, (F.col("digest") == F.col("d")) & (F.col("content") == F.col("c")))
        found = clear.unionByName(mixed.select(*clear.columns))
    kept = F.col("keep_id").eqNullSafe(F.col("_id"))
    return found.select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = groups.where(F.col("group_size") > max(total // HOT_SHARE, HOT_SHARE)).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    rest = groups.where(F.col("group_size") <= max(total // HOT_SHARE, HOT_SHARE)).withColumnRenamed("digest", "group_digest")
    # fewer than HOT_SHARE groups can each hold more than 1/HOT_SHARE of the rows
    first = rows.join(F.broadcast(hot), "digest", "left")
    # rows of a hot group have their answer: a key of their own spreads them over the tasks
    alone = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    both = first.withColumn("group_digest", alone).join(rest, "group_digest", "left")
    return both.select(
        "_id", "text_sha256",
        F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")).alias("keep_id"),
        F.coalesce("hot_size", "group_size").alias("group_size"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; for a pipeline stage.

    Where ids are unique the winners are joined back by id. Where some repeat, they are joined by digest
    and id, and of rows that repeat both one stays.
    """
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        kept = keep(exact_groups(docs, id_col, text_col).select("keep_id"), "exact-kept")
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"))
        return packed.join(kept, F.col("_id").eqNullSafe(F.col("keep_id")), "left_semi").select("row.*")
    kept = keep(exact_groups(docs, id_col, text_col).select("digest", "keep_id"), "exact-kept")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), sha256(normalised(F.col(text_col))).alias("_digest"))
    stay = packed.join(kept, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("keep_id")), "left_semi")
    return stay.dropDuplicates(["_digest"]).select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
