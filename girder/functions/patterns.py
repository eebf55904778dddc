"""Regular expressions of queries, translated for the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def translate(pattern: str, flags: str = "") -> str:
    """A JavaScript pattern as a Java one. Stateful flags are rejected: a test must not depend on earlier tests."""
    if set(flags) - set("ims u".replace(" ", "")):
        raise ValueError(f"flags {flags!r}: only i, m, s and u can be used")
    out = pattern.replace("[^]", r"[\s\S]").replace(r"\/", "/")
    out = re.sub(r"\[\[(?!:)", r"[\\[", out)
    kept = "".join(f for f in "ims" if f in flags) + ("i" in flags and "u" in flags) * "u"
    return f"(?{kept}){out}" if kept else out


def matches(column: Column, patterns: str | list[str] | tuple[str, ...]) -> Column:
    """Whether any of the patterns is found somewhere in the column; null (which a filter drops) if the column is null."""
    each = [patterns] if isinstance(patterns, str) else list(patterns)
    return reduce(Column.__or__, [column.rlike(translate(p)) for p in each]) if each else F.lit(False)


def found_in(spark: SparkSession, text: str, patterns: str | list[str] | tuple[str, ...]) -> bool:
    """The same for one string, on the driver, by the JVM's own expressions."""
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    each = [patterns] if isinstance(patterns, str) else list(patterns)
    return any(pattern.compile(translate(p)).matcher(text).find() for p in each)
