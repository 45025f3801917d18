"""Retrieval chunks from symbols and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_slug, module_name, signature

COLUMNS = ("id", "chunk_type", "content", "filename", "name")


def import_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file with imports: a line for each, in order."""
    line = F.transform("imports", lambda i: F.when(F.coalesce(i["name"], F.lit("")) == "", F.concat(F.lit("- "), i["module"])).otherwise(F.concat(F.lit("- "), i["name"], F.lit(" from "), i["module"])))
    content = F.concat(F.lit("File "), "filename", F.lit(" imports:\n"), F.array_join(line, "\n"), F.lit("\n"))
    return files.where("size(imports) > 0").select(F.concat("filename", F.lit("#imports")).alias("id"), F.lit("import").alias("chunk_type"), content.alias("content"), "filename", F.lit(None).cast("string").alias("name"))


def class_chunks(files: DataFrame) -> DataFrame:
    """Header, bases, decorators and method list of every class."""
    c = files.select("filename", F.explode("classes").alias("c"))
    bases = F.when(F.size("c.bases") > 0, F.concat(F.lit(" extends "), F.array_join("c.bases", ", "))).otherwise("")
    marks = F.when(F.size("c.decorators") > 0, F.concat(F.lit(" [decorators: "), F.array_join("c.decorators", ", "), F.lit("]"))).otherwise("")
    methods = F.when(F.size("c.methods") > 0, F.concat(F.lit("Methods:\n"), F.array_join(F.transform("c.methods", lambda m: F.concat(F.lit("- "), signature(m["name"], m["params"], m["return_type"]))), "\n"), F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("Class "), "c.name", bases, marks, F.lit("\n"), methods)
    return c.select(F.concat_ws("#", "filename", "c.name").alias("id"), F.lit("class").alias("chunk_type"), content.alias("content"), "filename", F.col("c.name").alias("name"))


def function_chunks(files: DataFrame) -> DataFrame:
    """Signature and decorators of every function."""
    f = files.select("filename", F.explode("functions").alias("f"))
    marks = F.when(F.size("f.decorators") > 0, F.concat(F.lit(" [decorators: "), F.array_join("f.decorators", ", "), F.lit("]"))).otherwise("")
    content = F.concat(F.lit("Function "), signature(F.col("f.name"), F.col("f.params"), F.col("f.return_type")), marks, F.lit("\n"))
    return f.select(F.concat_ws("#", "filename", "f.name").alias("id"), F.lit("function").alias("chunk_type"), content.alias("content"), "filename", F.col("f.name").alias("name"))


def module_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file that has no symbol and no import."""
    empty = files.where("coalesce(size(imports), 0) <= 0 and coalesce(size(classes), 0) <= 0 and coalesce(size(functions), 0) <= 0")
    return empty.select(F.concat("filename", F.lit("#module")).alias("id"), F.lit("module").alias("chunk_type"), F.concat(F.lit("File: "), "filename", F.lit("\n")).alias("content"), "filename", module_name(F.col("filename")).alias("name"))


def file_chunks(files: DataFrame) -> DataFrame:
    out = import_chunks(files)
    for part in (class_chunks, function_chunks, module_chunks):
        out = out.unionByName(part(files))
    return out


def with_source(chunks: DataFrame, files: DataFrame, most: int = 60) -> DataFrame:
    """Appends up to `most` source lines to chunks that have (filename, start_line, end_line)."""
    lines = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")
    taken = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.lit(0), F.least(F.col("end_line"), F.col("start_line") + most - 1, F.size(lines)) - F.col("start_line") + 1)), "\n")
    usable = (F.col("start_line") > 0) & (F.col("end_line") > F.col("start_line")) & F.col("text").isNotNull()
    both = chunks.join(files.select("filename", F.col("content").alias("text")), "filename", "left")
    return both.withColumn("content", F.when(usable, F.concat("content", F.lit("\n```\n"), F.regexp_replace(taken, r"\s+$", ""), F.lit("\n```\n"))).otherwise(F.col("content"))).drop("text")


def document_sections(docs: DataFrame, key: str, text: str, most: int = 800) -> DataFrame:
    """(key, section_no, heading, id, content): the parts of a text below its second-level headings.
    What stands before the first one is left out, and so are blank parts; longer ones are cut."""
    parts = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.concat(F.lit("\n"), text), "\n## ")).alias("section_no", "part")).where("section_no > 0")
    heading = F.trim(F.split_part("part", F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.when(F.instr("part", "\n") > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise(""), r"^\s+|\s+$", "")
    rows = parts.select(key, F.col("section_no").cast("long").alias("section_no"), heading.alias("heading"), body.alias("body")).where("body <> ''")
    cut = F.when(F.length("body") > most, F.concat(F.substring("body", 1, most), F.lit("..."))).otherwise(F.col("body"))
    return rows.select(key, "section_no", "heading", F.concat(F.lit("wiki/"), F.col(key).cast("string"), F.lit("#"), chunk_slug(F.col("heading"))).alias("id"), cut.alias("content"))
