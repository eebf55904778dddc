"""STEP text files: reading statements, and the star schema written as statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.sources.star_schema import local_id, read

HEAD = r"^\s*#(\d+)\s*=\s*([A-Z0-9_]+)"


def _line_end(spark: SparkSession, path: str) -> str:
    """How lines of a file end, by its first 64 KB."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, 1 << 16)))
    finally:
        stream.close()
    return "\r\n" if b"\r\n" in head else "\n"


def statements(spark: SparkSession, path: str) -> DataFrame:
    """path, statement: what lies between DATA; and ENDSEC; of each file, one row for each statement.

    A statement ends where a semicolon ends a line. Files are cut there by the reader, so large ones are split; lines
    may end with \\r\\n, as the head of each file tells.
    """
    files = spark.read.text(path).inputFiles()
    ends: dict[str, list[str]] = {}
    for file in files:
        ends.setdefault(_line_end(spark, file), []).append(file)
    parts = [spark.read.text(group, lineSep=f";{end}").select(F.input_file_name().alias("path"), F.col("value")) for end, group in sorted(ends.items())]
    if not parts:
        return spark.createDataFrame([], "path string, statement string")
    # a file that mixes line ends still has some inside a record
    each = reduce(DataFrame.unionAll, parts).select("path", F.explode(F.split("value", r";[ \t]*\r?\n")).alias("statement"))
    cleaned = each.select("path", F.regexp_replace(F.trim(F.regexp_replace("statement", r"[\r\n]+", " ")), r";\s*$", "").alias("statement"))
    return cleaned.where(F.col("statement").rlike(HEAD))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: what a select names is written out wherever a later one uses it, in
    lambdas for each element, but a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(lines: DataFrame, column: str = "statement") -> DataFrame:
    """id, type, args, refs and the statement. References inside strings count; id 0 and references to itself do not."""
    me = F.regexp_extract(column, HEAD, 1).try_cast("long")
    refs = F.transform(F.regexp_extract_all(F.col(column), F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    rows = lines.where(F.col(column).rlike(HEAD)).select(
        me.alias("id"), F.regexp_extract(column, HEAD, 2).alias("type"), F.regexp_extract(column, r"^[^(]*\((.*)\)[^)]*$", 1).alias("args"), refs.alias("all_refs"), F.col(column).alias("statement")
    )
    others = bound(F.col("id"), lambda i: F.filter("all_refs", lambda x: (x > 0) & (x != i)))
    return rows.where("id > 0").select("id", "type", "args", others.alias("refs"), "statement")


def split_arguments(text: str | None) -> list[str]:
    """Arguments at depth 0, outside single quotes, trimmed; an empty last one is left out."""
    out, depth, quoted, start = [], 0, False, 0
    for at, c in enumerate(text or ""):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(text[start:at].strip())
                start = at + 1
    last = (text or "")[start:].strip()
    return [*out, last] if last else out


HIDDEN = "\u0001\u0002\u0003"


def with_arguments(rows: DataFrame, column: str = "args", name: str = "each") -> DataFrame:
    """Adds split_arguments of a column as an array, by column expressions alone.

    Commas and brackets in quotes are hidden first; pieces between commas are counted through once, and an argument
    starts with every piece at depth 0. Control characters 1 to 3 do not occur in STEP text.
    """
    hidden = F.array_join(F.transform(F.split(column, "'"), lambda x, i: F.when(i % 2 == 1, F.translate(x, ",()", HIDDEN)).otherwise(x)), "'")

    def deeper(piece: Column) -> Column:
        return F.length(F.translate(piece, ")", "")) - F.length(F.translate(piece, "(", ""))

    def starts(pieces: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            pieces,
            first,
            lambda s, p: F.struct((s["at"] + 1).alias("at"), (s["depth"] + deeper(p)).alias("depth"), F.when(s["depth"] == 0, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts")),
            lambda s: s["starts"],
        )

    def cut(pieces: Column, begins: Column) -> Column:
        return F.transform(begins, lambda a, k: F.trim(F.translate(F.array_join(F.slice(pieces, a + 1, F.coalesce(F.get(begins, k + 1), F.size(pieces)) - a), ","), HIDDEN, ",()")))

    def ended(each: Column) -> Column:
        return F.when(F.element_at(each, -1) == "", F.slice(each, 1, F.size(each) - 1)).otherwise(each)

    each = bound(F.split(F.coalesce(hidden, F.lit("")), ","), lambda pieces: bound(starts(pieces), lambda begins: bound(cut(pieces, begins), ended)))
    return rows.select("*", each.alias(name))


def star_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement: regions as buildings, nations as storeys, customers as walls, orders as openings in them."""

    def line(id_: Column, type_: str, *args) -> Column:
        return F.concat(F.lit("#"), id_.cast("string"), F.lit(f"= {type_}("), F.array_join(F.array(*args), ","), F.lit(")"))

    def text(prefix: str, column: str) -> Column:
        return F.concat(F.lit(f"'{prefix}"), F.col(column).cast("string"), F.lit("'"))

    def ref(id_: Column) -> Column:
        return F.concat(F.lit("#"), id_.cast("string"))

    none = F.lit("$")
    regions, nations, customers, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    order, customer = local_id("o_orderkey", 6), local_id("o_custkey", 3)
    rows = [
        regions.select(line(local_id("r_regionkey", 1), "IFCBUILDING", text("REGION:", "r_regionkey"), none, text("", "r_name")).alias("statement")),
        nations.select(line(local_id("n_nationkey", 2), "IFCBUILDINGSTOREY", text("NATION:", "n_nationkey"), ref(local_id("n_regionkey", 1)), text("", "n_name"))),
        customers.select(line(local_id("c_custkey", 3), "IFCWALL", text("CUSTOMER:", "c_custkey"), ref(local_id("c_nationkey", 2)), text("", "c_name"))),
        orders.select(line(order, "IFCOPENINGELEMENT", text("ORDERS:", "o_orderkey"), none, text("", "o_orderpriority"))),
        orders.select(line(F.col("o_orderkey").cast("long") * 8 + 7, "IFCRELVOIDSELEMENT", text("VOID:", "o_orderkey"), none, none, none, ref(customer), ref(order))),
    ]
    return reduce(DataFrame.unionAll, rows)
