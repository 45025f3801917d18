"""Symbol tables: definitions, spans, nearest definitions, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import once


def latest_files(file_result: DataFrame) -> DataFrame:
    return once(file_result.where("file_id is not null and filename is not null"), "file_id", "scanned_at")


def definitions(files: DataFrame) -> DataFrame:
    """(file_id, kind, owner, name, params, return_type, start_line, end_line): classes, functions
    and methods as rows."""
    base = files.select("file_id", "classes", "functions")
    shape = [F.col("d.name").alias("name"), F.col("d.start_line").cast("long").alias("start_line"), F.col("d.end_line").cast("long").alias("end_line")]
    none = F.lit(None)
    classes = base.select("file_id", F.explode("classes").alias("d")).select("file_id", F.lit("class").alias("kind"), none.cast("string").alias("owner"), *shape, none.cast("array<string>").alias("params"), none.cast("string").alias("return_type"))
    functions = base.select("file_id", F.explode("functions").alias("d")).select("file_id", F.lit("function").alias("kind"), none.cast("string").alias("owner"), *shape, F.col("d.params").alias("params"), F.col("d.return_type").alias("return_type"))
    methods = base.select("file_id", F.explode("classes").alias("c")).select("file_id", F.col("c.name").alias("owner"), F.explode("c.methods").alias("d"))
    methods = methods.select("file_id", F.lit("method").alias("kind"), "owner", *shape, F.col("d.params").alias("params"), F.col("d.return_type").alias("return_type"))
    return classes.unionByName(functions).unionByName(methods)


def estimated_ends(defs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(file_id, kind, name, start_line, est_end): each top-level item ends before the next one
    starts, the last with its file; of a class and a function that begin together the class holds."""
    tops = defs.where("kind <> 'method' and start_line > 0")
    after = F.lead("start_line").over(W.partitionBy("file_id").orderBy("start_line", "kind", "name"))
    return tops.withColumn("after", after).join(lengths, "file_id", "left").select("file_id", "kind", "name", "start_line", F.greatest("start_line", F.coalesce(F.col("after") - 1, F.col("lines"), F.col("start_line"))).alias("est_end"))


def contained(defs: DataFrame) -> DataFrame:
    """(file_id, name, start_line, class_name): functions within the span of a class of their file,
    with the first such class. Pairs are formed inside of a file only."""
    inner = defs.where("kind = 'function'").select("file_id", "name", "start_line", "end_line")
    outer = defs.where("kind = 'class' and end_line > 0").select("file_id", F.col("name").alias("class_name"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    both = inner.join(outer, "file_id").where("start_line >= c_start and end_line <= c_end")
    return both.groupBy("file_id", "name", "start_line").agg(F.min_by("class_name", F.struct("c_start", "class_name")).alias("class_name"))


def nearest_before(points: DataFrame, defs: DataFrame) -> DataFrame:
    """(file_id, line, name, def_line): for each point the last definition that starts at or before
    it, by one sorted pass over both per file."""
    marked = defs.where("start_line > 0").groupBy("file_id", F.col("start_line").alias("line")).agg(F.min("name").alias("name")).withColumn("def_line", F.col("line")).withColumn("is_point", F.lit(0))
    asked = points.select("file_id", "line", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("def_line"), F.lit(1).alias("is_point"))
    back = W.partitionBy("file_id").orderBy("line", "is_point").rowsBetween(W.unboundedPreceding, 0)
    filled = marked.unionByName(asked).select("file_id", "line", "is_point", F.last("name", True).over(back).alias("name"), F.last("def_line", True).over(back).alias("def_line"))
    return filled.where("is_point = 1 and name is not null").drop("is_point")


def python_imports(lines: DataFrame, text: str) -> DataFrame:
    """Adds (module, name, is_relative) for each import of Python source lines. An alias is the name;
    `import a.b` has the name of its last part."""
    line = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\t]", " "), r"\s*#.*$", ""))
    rows = lines.withColumn("_l", line)
    from_ = rows.where(F.col("_l").rlike(r"^from +\S+ +import +[\w*]")).select(*lines.columns, F.regexp_extract("_l", r"^from +(\S+) +import", 1).alias("module"), F.explode(F.split(F.regexp_replace(F.regexp_extract("_l", r" import +(.*)$", 1), "[()]", ""), ",")).alias("_n"))
    plain = rows.where(F.col("_l").rlike(r"^import +\w")).select(*lines.columns, F.explode(F.split(F.regexp_extract("_l", r"^import +(.*)$", 1), ",")).alias("_n"))
    plain = plain.withColumn("module", F.regexp_extract("_n", r"^ *(\S+)", 1))
    alias = F.regexp_extract("_n", r" as +(\w+) *$", 1)
    named = F.when(alias != "", alias)
    from_ = from_.select(*lines.columns, "module", F.coalesce(named, F.trim("_n")).alias("name"))
    plain = plain.select(*lines.columns, "module", F.coalesce(named, F.regexp_extract("module", r"([^.]*)$", 1)).alias("name"))
    return from_.unionByName(plain).where("name <> ''").withColumn("is_relative", F.col("module").startswith("."))
