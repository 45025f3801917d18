"""Source files that do not parse (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread
from .grammar.languages import language


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def valid(extension: str, text: str) -> bool | None:
    """Whether any dialect of the language accepts the text; None for other languages."""
    spoken = language(extension)
    return None if spoken is None else spoken.accepts(text)


def parsed(df: DataFrame, key: str, filename: str, text: str, when: str | None = None, *more: str) -> DataFrame:
    """(key, filename, more columns, language, valid) of every file, from its latest delivery.

    valid is false where every dialect of the extension's language rejects the text, null where the
    language isn't supported or the text or name is null. An empty text is valid unless its language
    asks for a package clause. Null keys are left out; other columns are ignored. Texts are parsed
    where they are read; only the verdicts are shuffled.
    """
    at = F.col(when) if when else F.lit(None).cast("timestamp")
    rows = df.select(F.col(key).alias("key"), at.alias("at"), F.struct(F.col(filename).alias("name"), *[F.col(c).alias(f"c_{c}") for c in more]).alias("also"), extension(F.col(filename)).alias("ext"), F.col(text).alias("text"))
    rows = spread(rows.where("key is not null"))
    schema = rows.drop("text").schema.add("valid", "boolean")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [None if e is None or t is None else valid(e, t) for e, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(verdicts, pa.bool_())], ["key", "at", "also", "ext", "valid"])

    done = rows.mapInArrow(parse, schema)
    once = done.groupBy("key").agg(F.max_by(F.struct("also", "ext", "valid"), F.coalesce("at", F.lit("1900-01-01").cast("timestamp"))).alias("x"))
    return once.select(F.col("key").alias(key), F.col("x.also.name").alias(filename), *[F.col(f"x.also.c_{c}").alias(c) for c in more], F.nullif(F.col("x.ext"), F.lit("")).alias("language"), F.col("x.valid").alias("valid"))


def invalid_rates(files: DataFrame, *by: str) -> DataFrame:
    """(by columns, files, invalid, rate) over the files of supported languages."""
    bad = F.sum((~F.col("valid")).cast("long"))
    return files.where("valid is not null").groupBy(*by).agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate"))
