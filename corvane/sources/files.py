"""Reading source trees, documents and stores; writing indexes."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import EXTENSIONS, SKIPPED

VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("source_file", T.StringType())])


def wanted(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a scan takes a path: a source file outside of hidden and skipped folders, no declaration
    file and no source map."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*extensions) & ~F.exists(folders, lambda x: x.isin(*SKIPPED) | x.startswith(".")) & ~path.rlike(r"\.d\.ts$|\.js\.map$|\.d\.ts\.map$")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, ext, mtime, size, text) of the source files below a folder. Hidden and skipped folders
    below it, declaration files and source maps are left out; file names are filtered while listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    full = F.regexp_replace("path", "^file:/*", "/")
    root = "/" + folder.removeprefix("file:").strip("/") + "/"
    path = F.when(full.startswith(root), F.substring(full, len(root) + 1, 1 << 20)).otherwise(full)
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(wanted(F.col("path"), extensions)).select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"), "mtime", "size", "text")


def documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("md", "markdown", "txt", "rst", "adoc")) -> DataFrame:
    """(name, text) of the texts directly in a folder, without their front matter."""
    raw = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^./]*$", 1).alias("name"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n+", "").alias("text"))


def line_range(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Adds `source`: the lines from start to end (from 1), clamped to the text, without trailing blanks."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    first = F.greatest(F.lit(1), F.col(start))
    taken = F.slice(lines, first, F.greatest(F.lit(0), F.least(F.col(end), F.size(lines)) - first + 1))
    return df.withColumn("source", F.regexp_replace(F.array_join(taken, "\n"), r"\s+$", ""))


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, source_file) of a store kept as one JSON array."""
    return spark.read.schema(VECTORS).option("multiLine", "true").json(path)


def from_blob(blob):
    """A column of little-endian 32-bit floats as an array; null where the length isn't a multiple of 4."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def decode(values):
        import numpy as np

        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return decode(blob)


def write_index(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces an index table."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def to_blob(vector: Column) -> Column:
    """Arrays of numbers as little-endian 32-bit floats."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)


def write_json_store(df: DataFrame, path: str) -> None:
    """(id, vector, source_file) as one JSON object a line, in as many files as there are parts."""
    df.select("id", "vector", "source_file").write.mode("overwrite").json(path)


class SqliteStore(DataSource):
    """A vector store kept in a SQLite file that all executors can read, as a data source: option
    `path`, and `parts` for the number of ranges of row numbers that are read side by side."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_vectors"

    def schema(self) -> str:
        return "id string, vector binary, source_file string"

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.table, self.parts = options["path"], options.get("table", "vectors"), int(options.get("parts", "8"))

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with closing(self._connect()) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = (high - low) // self.parts + 1
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with closing(self._connect()) as c:
            yield from c.execute(f'SELECT id, vector, source_file FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', partition.value)


def read_sqlite_store(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """(id, vector, source_file) of a SQLite store, its blobs as arrays."""
    spark.dataSource.register(SqliteStore)
    rows = spark.read.format("sqlite_vectors").option("path", path).option("parts", str(parts)).load()
    return rows.withColumn("vector", from_blob(F.col("vector")))


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a question suite kept as one JSON object with a list `cases`."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")


def keep_newest(spark: SparkSession, folder: str, n: int = 10) -> list[str]:
    """Removes all but the n version folders that are last by name; gives what it removed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True)
    for name in names[n:]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name), True)
    return names[n:]


def write_texts(df: DataFrame, folder: str, name: str, text: str) -> None:
    """One file for each row, written where the row lies; names may have folders. A task that runs
    again writes the same files."""
    target = str(folder)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Path(target, n)
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(t, encoding="utf-8")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    rows = df.where(F.col(name).isNotNull() & ~F.col(name).contains("..")).select(F.col(name).alias("name"), F.coalesce(text, F.lit("")).alias("text"))
    rows.mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
