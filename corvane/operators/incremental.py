"""Manifests of files, changed and vanished ones, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(index: DataFrame) -> DataFrame:
    """One state per path: the latest by time, then by size."""
    return index.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("x")).select("path", "x.mtime", "x.size")


def changed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, mtime, size, is_new): files that are unknown or differ in time or size."""
    old = manifest.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("known"))
    both = current.join(old, "path", "left")
    return both.where("known is null or not (mtime <=> old_mtime and size <=> old_size)").select("path", "mtime", "size", F.col("known").isNull().alias("is_new"))


def vanished(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.select("path").join(current.select("path"), "path", "left_anti")


def kept(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(current.select("path"), "path", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of all rows of a key the one with the largest order; ties go to the new ones."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = old.columns
    rest = [c for c in columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_x"))
    return best.select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def pending(chunks: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Chunks whose key has no stored vector yet, each once."""
    return chunks.select(key).distinct().join(stored.select(key).distinct(), key, "left_anti")
