"""Keeping an index up to date from a stream of deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_folder


def _work_folder(spark: SparkSession) -> str:
    """A folder that all executors share: beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"


def index_stream(spark: SparkSession, schema: StructType, path: str, target: str, state: str, key: str, *order: str, files_per_batch: int = 64, compact_every: int = 32) -> None:
    """Read what is new below a path and add it, batch by batch, to an index.

    A batch writes only its own latest rows, as a delta that its number names; every
    `compact_every`-th one writes a new base from the last base and the deltas since, and removes what
    the base before it needed. A batch that is repeated after a failure writes the same folder again,
    so that nothing counts twice, and reads none that it writes itself.
    """
    if path.rstrip("/").endswith(".parquet"):
        folder, _, name = path.rstrip("/").rpartition("/")
        reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch)
        stream = reader.parquet(f"{folder}/{name[: -len('.parquet')]}*.parquet")
    else:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    rows = stream.where(F.col(key).isNotNull()).select(key, *[c for c in order if c != key]).withColumn("_seq", F.struct(*order))

    def apply(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max("_seq").alias("_seq")).write.mode("overwrite").parquet(f"{target}/delta={number}")
        if number and number % compact_every == 0:
            read_index(spark, target, key, upto=number - 1).write.mode("overwrite").parquet(f"{target}/base={number - 1}")
            fs, folder = _folder(spark, target)
            for kind, n in _parts(spark, target):
                if n < number - 1 - compact_every or kind == "delta" and n < number - compact_every:
                    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{kind}={n}"), True)

    query = rows.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def _folder(spark: SparkSession, target: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _parts(spark: SparkSession, target: str) -> list[tuple[str, int]]:
    """(kind, number) of the finished folders of an index; kind is base or delta."""
    fs, folder = _folder(spark, target)
    if not fs.exists(folder):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return [(n.partition("=")[0], int(n.partition("=")[2])) for n in names if n.startswith(("base=", "delta=")) and fs.exists(path(f"{target}/{n}/_SUCCESS"))]


def read_index(spark: SparkSession, target: str, key: str, upto: int | None = None) -> DataFrame | None:
    """(key, _seq) of an index, up to a batch: the last base and the deltas behind it; None without any."""
    parts = [(k, n) for k, n in _parts(spark, target) if upto is None or n <= upto]
    base = max((n for k, n in parts if k == "base"), default=-1)
    names = [f"{target}/base={base}"] if base >= 0 else []
    names += [f"{target}/delta={n}" for k, n in sorted(parts) if k == "delta" and n > base]
    if not names:
        return None
    return spark.read.parquet(*names).groupBy(key).agg(F.max("_seq").alias("_seq"))


def run_once(spark: SparkSession, schema: StructType, path: str, key: str, *order: str) -> DataFrame:
    """The index after one run over everything that is there."""
    work = _work_folder(spark)
    index_stream(spark, schema, path, f"{work}/index", f"{work}/state", key, *order)
    index = read_index(spark, f"{work}/index", key)
    if index is None:
        return spark.createDataFrame([], StructType([schema[key], *[schema[c] for c in order]]))
    return index.select(key, "_seq.*")
