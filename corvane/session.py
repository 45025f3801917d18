"""Sessions, tables and shared helpers of plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "corvane", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Hands the package to the executors of a cluster where it isn't installed."""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corvane-")
    archive = Path(folder, "corvane.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("corvane", file.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a session that runs on one machine (tests) may go
    without: it takes a folder of its own, which is removed at the end."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="corvane-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder. The session's cleaner removes what nothing refers
    to any more where spark.cleaner.referenceTracking.cleanCheckpoints is set, as `session` does."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer parts than there are cores, as a single small file
    has; larger inputs stay as they are read. For stages that spend long on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, key: str, when: str) -> DataFrame:
    """The latest delivery of every key."""
    columns = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.coalesce(F.col(when), F.lit("1900-01-01").cast("timestamp"))).alias("_x"))
    return picked.select(key, *[F.col(f"_x.{c}").alias(c) for c in columns])


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Row numbers from 1 over the whole order, without bringing all rows into one task: rows are
    sorted by ranges, and each range begins where the ranges before it end."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("_part", F.shiftright("_id", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # a row per partition
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts[r["_part"]] = total
        total += r["_n"]
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    return placed.withColumn(name, (F.element_at(base, F.col("_part")) + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_id", "_part")


def value_at(df: DataFrame, column: str, index: int) -> float | None:
    """The value at a place (from 0) of the ascending order: a bracket of approximate quantiles is
    narrowed by exact counts until few values are left, which alone are sorted."""
    n = df.count()
    if not 0 <= index < n:
        return None
    values = df.select(F.col(column).alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while True:
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        k = inside.count()
        if k <= 100_000 or low == high:
            return inside.orderBy("v").offset(index - below).limit(1).collect()[0]["v"] if low != high else low
        middle = inside.stat.approxQuantile("v", [(index - below) / k], 0.001)[0]
        smaller, equal = inside.agg(F.sum((F.col("v") < middle).cast("long")), F.sum((F.col("v") == middle).cast("long"))).first()
        if index - below < smaller:
            high = inside.where(F.col("v") < middle).agg(F.max("v")).first()[0]
        elif index - below < smaller + equal:
            return middle
        else:
            below += smaller + equal
            low = inside.where(F.col("v") > middle).agg(F.min("v")).first()[0]
