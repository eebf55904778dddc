"""Visibility and highlights of items: item_config(item_id, visible, highlight_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPERTIES = ("color", "opacity", "transparent", "rendered_faces")
MOST_HIGHLIGHTS = 65536


def set_visible(config: DataFrame, ids: DataFrame | None, visible: bool | None) -> DataFrame:
    """The configuration with some (or all) items shown, hidden or, with None, toggled."""
    value = ~F.col("visible") if visible is None else F.lit(visible)
    if ids is None:
        return config.withColumn("visible", value)
    hit = ids.select("item_id").distinct().withColumn("_hit", F.lit(True))
    return config.join(hit, "item_id", "left").withColumn("visible", F.when(F.col("_hit"), value).otherwise(F.col("visible"))).drop("_hit")


def by_visibility(config: DataFrame, visible: bool) -> DataFrame:
    return config.where(F.col("visible") == F.lit(visible)).select("item_id")


def highlight(config: DataFrame, ids: DataFrame, past: DataFrame, **explicit) -> DataFrame:
    """item_id and the properties of its highlight: what is given, else what it had."""
    unknown = set(explicit) - set(PROPERTIES)
    if unknown:
        raise ValueError(f"no such properties: {sorted(unknown)}")
    rows = config.join(ids.select("item_id").distinct(), "item_id", "left_semi").join(past, "item_id", "left")
    return rows.select("item_id", *[F.coalesce(F.lit(explicit.get(p)), F.col(p)).alias(p) for p in PROPERTIES])


def materials(highlights: DataFrame) -> DataFrame:
    """Highlights as distinct materials with dense ids; opacity 1 and faces 0 where nothing is said."""
    filled = highlights.select("item_id", "color", F.coalesce("opacity", F.lit(1.0)).alias("opacity"), F.coalesce("rendered_faces", F.lit(0)).alias("rendered_faces"))
    distinct = filled.select("color", "opacity", "rendered_faces").distinct().limit(MOST_HIGHLIGHTS + 1)
    from pyspark.sql import Window

    ids = distinct.withColumn("highlight_id", F.row_number().over(Window.orderBy("color", "opacity", "rendered_faces")) - 1)  # at most MOST_HIGHLIGHTS rows
    checked = ids.withColumn("highlight_id", F.when(F.col("highlight_id") < MOST_HIGHLIGHTS, F.col("highlight_id")).otherwise(F.raise_error(F.lit("too many highlights")).cast("int")))
    same = filled["color"].eqNullSafe(checked["color"]) & (filled["opacity"] == checked["opacity"]) & (filled["rendered_faces"] == checked["rendered_faces"])
    return filled.join(checked, same).select("item_id", "highlight_id")


def reset_visible(config: DataFrame) -> DataFrame:
    return set_visible(config, None, True)


def hide_for_edit(config: DataFrame, ids: DataFrame | None, hidden: bool = True) -> DataFrame:
    """Marks items that an editor draws itself; all of them without ids."""
    if "hidden_for_edit" not in config.columns:
        config = config.withColumn("hidden_for_edit", F.lit(False))
    if ids is None:
        return config.withColumn("hidden_for_edit", F.lit(hidden))
    hit = ids.select("item_id").distinct().withColumn("_hit", F.lit(True))
    return config.join(hit, "item_id", "left").withColumn("hidden_for_edit", F.when(F.col("_hit"), F.lit(hidden)).otherwise(F.col("hidden_for_edit"))).drop("_hit")


def visibility_of(config: DataFrame, asked: DataFrame, mesh_items: DataFrame) -> DataFrame:
    """pos, local_id, item_id, visible of every drawn instance of asked(pos, local_id); those hidden for edit are skipped."""
    shown = config.where(~F.col("hidden_for_edit")) if "hidden_for_edit" in config.columns else config
    return asked.join(mesh_items.select("local_id", "item_id"), "local_id").join(shown.select("item_id", "visible"), "item_id").select("pos", "local_id", "item_id", "visible")


def by_config(config: DataFrame, predicate) -> DataFrame:
    """item_id of items whose configuration fulfils a predicate, a column expression over it."""
    return config.where(predicate).select("item_id")


def reset_highlight(past: DataFrame, ids: DataFrame | None, *properties: str) -> DataFrame:
    """Highlights without some of their properties (all of them if none is named) on some or all items."""
    gone = set(properties or PROPERTIES)
    hit = F.lit(True)
    if ids is not None:
        past = past.join(ids.select("item_id").distinct().withColumn("_hit", F.lit(True)), "item_id", "left")
        hit = F.coalesce("_hit", F.lit(False))
    return past.select("item_id", *[(F.when(~hit, F.col(p)) if p in gone else F.col(p)).alias(p) for p in PROPERTIES])
