"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Only a session that runs on one machine (tests) may go
    without: it takes a folder of its own, which is removed at the end."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that several readers compute it once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer parts than there are cores, as a single small
    file has; larger inputs stay as they are read. For stages that spend long on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: str, when: str, *values: Column) -> DataFrame:
    """One row per key, taken from its latest delivery. Give narrow value columns: only these are
    shuffled. Rows whose key is null are dropped, as they can't be named in a result."""
    names = [f"_v{i}" for i in range(len(values))]
    picked = df.where(F.col(key).isNotNull()).select(key, when, *[v.alias(n) for v, n in zip(values, names)])
    return picked.groupBy(key).agg(
        F.max_by(F.struct(*names), F.coalesce(F.col(when), F.lit("1900-01-01").cast("timestamp"))).alias("_latest")
    ).select(key, *[F.col(f"_latest.{n}").alias(n) for n in names])


def latest_rows(df: DataFrame, key: str, when: str, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of the latest delivery of each key, whole; of equal ones any. Rows with a null key are
    left out. Only keys and times are shuffled: few keys come several times as a rule, and these are
    broadcast up to a stated number; beyond it the rows are joined by key."""
    at = F.coalesce(F.col(when), F.lit("1900-01-01").cast("timestamp"))
    rows = df.where(F.col(key).isNotNull())
    again = cut_lineage(rows.select(key, at.alias("_at")).groupBy(key).agg(F.max("_at").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    n = again.count()
    if not n:
        return rows
    marked = rows.join(F.broadcast(again) if n <= broadcast_rows else again.hint("merge"), key, "left")
    single = marked.where("_last is null").select(*df.columns)
    return single.unionByName(marked.where(at == F.col("_last")).dropDuplicates([key]).select(*df.columns))


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of rows that share the first columns, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for x in cols:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(x[a] for x in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)
