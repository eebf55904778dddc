"""User-defined look-up indexes: keys with none, one or a slice of values.

Tables: index_keys(name, pos, key_num, key_str, start, stop), index_values(name, pos, value_num, value_str).
A one-to-one index has the slice [pos, pos + 1), a linear one [previous end, end), a non-linear one
[start, end); an end that is not past the start gives an empty list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("keysOnly", "oneToOne", "oneToNLinear", "oneToNNonLinear")
LARGEST = 2**32 - 1


class InvalidIndex(ValueError):
    """cause: what is wrong, as a dictionary."""

    def __init__(self, message: str, cause: dict):
        super().__init__(message)
        self.cause = cause


def validate(keys: list, values: list | None = None, end: list | None = None, start: list | None = None) -> str:
    """The mode of an index given as lists, or InvalidIndex."""
    for label, numbers in (("key", keys), ("value", values or ())):
        for at, x in enumerate(numbers):
            if not isinstance(x, str) and (isinstance(x, bool) or not isinstance(x, int) or not 0 <= x <= LARGEST):
                raise InvalidIndex(f"{label} {at} is no unsigned 32-bit integer", {"type": "invalid-number", "field": label, "index": at, "value": x})
    if values is None:
        return "keysOnly"
    if end is None:
        if len(values) != len(keys):
            raise InvalidIndex("one value for each key", {"type": "invalid-length", "field": "key values", "expected": len(keys), "actual": len(values)})
        return "oneToOne"
    for label, bounds in (("key end", end), ("key start", start)):
        if bounds is not None and len(bounds) != len(keys):
            raise InvalidIndex(f"one {label} for each key", {"type": "invalid-length", "field": label, "expected": len(keys), "actual": len(bounds)})
    first = start if start is not None else [0, *end[:-1]]
    bad = [{"index": k, "start": a, "end": b} for k, (a, b) in enumerate(zip(first, end, strict=True)) if a < 0 or b < a or b > len(values)]
    if bad:
        raise InvalidIndex("slices out of bounds", {"type": "invalid-bounds", "bounds": bad})
    return "oneToNLinear" if start is None else "oneToNNonLinear"


def entries(keys: DataFrame, values: DataFrame) -> DataFrame:
    """name, pos, key_num, key_str, ord, value_num, value_str: every value of every key, by the keys' slices."""
    v = values.select(F.col("name").alias("of"), F.col("pos").alias("at"), "value_num", "value_str")
    spread = keys.where("stop > start").withColumn("at", F.explode(F.sequence("start", F.col("stop") - 1)))
    return spread.join(v, (F.col("name") == F.col("of")) & (spread["at"] == v["at"])).select("name", "pos", "key_num", "key_str", (spread["at"] - F.col("start")).alias("ord"), "value_num", "value_str")


def linear(ends: DataFrame) -> DataFrame:
    """Adds start to (name, pos, stop): where the key before ends."""
    before = Window.partitionBy("name").orderBy("pos")
    return ends.withColumn("start", F.coalesce(F.lag("stop").over(before), F.lit(0)))


def forward(asked: DataFrame, keys: DataFrame, values: DataFrame) -> DataFrame:
    """name, key_num, values: of each asked (name, key_num), the last such key's values in order; null if there is no key.

    Only slices of asked keys are spread out.
    """
    mine = keys.join(asked.select("name", "key_num").distinct(), ["name", "key_num"], "left_semi")
    last = mine.groupBy("name", "key_num").agg(F.max_by(F.struct("pos", "start", "stop"), "pos").alias("k")).select("name", "key_num", "k.*")
    each = entries(last.withColumn("key_str", F.lit(None).cast("string")), values).groupBy("name", "pos")
    each = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value_num"))), lambda x: x["value_num"]).alias("values"))
    found = asked.join(last.select("name", "key_num", "pos"), ["name", "key_num"], "left").join(each, ["name", "pos"], "left")
    return found.select("name", "key_num", F.when(F.col("pos").isNotNull(), F.coalesce("values", F.array().cast("array<bigint>"))).alias("values"))


def inverse(asked: DataFrame, keys: DataFrame, values: DataFrame) -> DataFrame:
    """name, value_num, keys: of each asked (name, value_num), its keys in their order, repeated ones too."""
    hit = entries(keys, values).join(asked, ["name", "value_num"])
    return hit.groupBy("name", "value_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ord", "key_num"))), lambda x: x["key_num"]).alias("keys"))


def has(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """name, key_num, present."""
    there = keys.select("name", "key_num").distinct().withColumn("there", F.lit(True))
    return asked.join(there, ["name", "key_num"], "left").select("name", "key_num", F.coalesce("there", F.lit(False)).alias("present"))


def distinct_values(values: DataFrame) -> DataFrame:
    """name, value_num, value_str, first_pos: each value once, with its first place; nulls are left out."""
    return values.where("value_num IS NOT NULL OR value_str IS NOT NULL").groupBy("name", "value_num", "value_str").agg(F.min("pos").alias("first_pos"))


def info(keys: DataFrame, values: DataFrame) -> DataFrame:
    """name, mode, key_type, value_type, size, from what is filled in; declared modes come with the keys."""
    k = keys.groupBy("name").agg(F.first("mode").alias("mode"), F.count(F.lit(1)).alias("size"), F.count("key_str").alias("strings"))
    v = values.groupBy("name").agg(F.count("value_str").alias("value_strings"), F.count("value_num").alias("value_numbers"))
    kind = F.when(F.col("value_strings") > 0, "string").when(F.col("value_numbers") > 0, "number").otherwise("none")
    return k.join(v, "name", "left").select("name", "mode", F.when(F.col("strings") > 0, "string").otherwise("number").alias("key_type"), kind.alias("value_type"), "size")
