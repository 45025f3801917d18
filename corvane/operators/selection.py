"""What to show of a code collection: members of groups, core modules, classes, functions, snippets,
clusters of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_noise
from ..session import cut_lineage, global_rank


def ranked_within(df: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    """Adds each row's place within its group. Rows are ranked over all groups by ranges and counted
    from their group's first, so that no task needs to hold a whole group."""
    ranked = cut_lineage(global_rank(df, *[F.asc(k) for k in keys], *order, name="_r"))
    firsts = ranked.groupBy(*keys).agg(F.min("_r").alias("_f"))
    return ranked.join(firsts, keys).withColumn(name, F.col("_r") - F.col("_f") + 1).drop("_r", "_f")


def most(df: DataFrame, *order: Column) -> DataFrame:
    """The first row in an order, by a top-1 per task and one over these."""
    return df.orderBy(*order).limit(1)


def core_modules(facts: DataFrame) -> DataFrame:
    """(name, reason, amount): the first entry point, of the others the one with most dependents, of
    the rest the one with most classes. facts: name, n_in, n_out, classes; tests and the like are
    left out. At most three rows."""
    clean = cut_lineage(facts.where(~is_noise(F.col("name"))))
    entry = cut_lineage(most(clean.where("n_in = 0 and n_out > 0"), F.asc("name")).select("name", F.lit("entry").alias("reason"), F.lit(0).cast("long").alias("amount")))
    hub = cut_lineage(most(clean.join(entry, "name", "left_anti").where("n_in > 0"), F.desc("n_in"), F.asc("name")).select("name", F.lit("hub").alias("reason"), F.col("n_in").alias("amount")))
    taken = entry.unionByName(hub)
    rich = most(clean.join(taken, "name", "left_anti").where("classes > 0"), F.desc("classes"), F.asc("name")).select("name", F.lit("classes").alias("reason"), F.col("classes").alias("amount"))
    return taken.unionByName(rich)


def core_classes(classes: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """(name, module, score): the n classes of the highest ranked modules, each name once."""
    scored = classes.join(scores, "module").select("name", "module", F.round("score", 10).alias("score"))
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("below"), "module")).alias("x")).select("name", "x.module", (-F.col("x.below")).alias("score"))
    return best.orderBy(F.desc("score"), "name").limit(n)


def snippet_span(defs: DataFrame) -> DataFrame:
    """Definitions with a start; a missing end is 20 lines on for functions, 30 for classes."""
    missing = F.when(F.col("kind") == "class", 30).otherwise(20)
    return defs.where("start_line > 0").withColumn("end_line", F.when(F.coalesce(F.col("end_line"), F.lit(0)) > F.col("start_line"), F.col("end_line")).otherwise(F.col("start_line") + missing).cast("long"))


def keyword_overlap(source: Column, target: Column) -> Column:
    """How many parts of the target, of two bytes at least, the source contains."""
    parts = F.filter(F.split(target, r"[/\\_\- ]+"), lambda p: F.octet_length(p) >= 2)
    return F.size(F.filter(parts, lambda p: source.contains(p)))


def folder_clusters(files: DataFrame, large: int = 100, small: int = 3, shown: int = 20) -> DataFrame:
    """(dir, modules): modules by top folder, folders of more than `large` by their second level;
    clusters of fewer than `small` join the one whose name shares most parts with theirs, the first
    by name of equal ones, and stay alone where none does; the `shown` largest come out."""
    parts = F.split("filename", "/")
    tops = files.select("filename", parts[0].alias("top"), F.when(F.size(parts) > 1, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0]).alias("second"))
    sizes = tops.groupBy("top").agg(F.count("*").alias("n"))
    raw = tops.join(sizes, "top").groupBy(F.when(F.col("n") > large, F.col("second")).otherwise(F.col("top")).alias("dir")).agg(F.count("*").alias("modules"))
    raw = cut_lineage(raw)
    big, tiny = raw.where(F.col("modules") >= small), raw.where(F.col("modules") < small)
    # Folders that share a part, by that part: no pair without one is formed.
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"[/\\_\- ]+"), lambda p: F.octet_length(p) >= 2)))
    near = tiny.select(F.col("dir").alias("from"), words(F.col("dir")).alias("w")).join(big.select(F.col("dir").alias("to"), words(F.col("dir")).alias("w")), "w").groupBy("from", "to").agg(F.count("*").alias("k"))
    best = near.groupBy("from").agg(F.min(F.struct((-F.col("k")).alias("k"), "to")).alias("x")).select(F.col("from").alias("dir"), F.col("x.to").alias("to"))
    merged = raw.join(best, "dir", "left").groupBy(F.coalesce("to", "dir").alias("dir")).agg(F.sum("modules").alias("modules"))
    return merged.orderBy(F.desc("modules"), "dir").limit(shown)


def top_functions(functions: DataFrame, calls: DataFrame, most_rows: int = 0) -> DataFrame:
    """(module, name, layer): the functions to describe. Their number is all below 300, half up to
    600, else four tenths, ten at least; the best 35 % of it come first by calls to and from them,
    then up to two of each module (three from 20 functions on, four from 50), then the best of the
    rest. Ties by module and name."""
    distinct = functions.select("module", "name").distinct()
    n_in = calls.groupBy(F.col("to_module").alias("module"), F.col("to_name").alias("name")).agg(F.count("*").alias("calls_in"))
    n_out = calls.groupBy(F.col("from_module").alias("module"), F.col("from_name").alias("name")).agg(F.count("*").alias("calls_out"))
    scored = distinct.join(n_in, ["module", "name"], "left").join(n_out, ["module", "name"], "left").select("module", "name", (F.coalesce("calls_in", F.lit(0)) * 2 + F.coalesce("calls_out", F.lit(0))).alias("score"))
    scored = cut_lineage(ranked_within(scored, ["module"], F.desc("score"), F.asc("name"), name="own"))
    total = scored.count()
    target = total if total < 300 else total // 2 if total <= 600 else int(total * 0.4)
    target = min(max(target, min(10, total)), most_rows or total)
    head = int(target * 0.35)
    placed = cut_lineage(global_rank(scored, F.desc("score"), F.asc("module"), F.asc("name")))
    sizes = placed.groupBy("module").agg(F.count("*").alias("k"))
    quota = F.when(F.col("k") >= 50, 4).when(F.col("k") >= 20, 3).otherwise(2)
    layered = placed.join(sizes, "module").withColumn("layer", F.when(F.col("rank") <= head, 1).when(F.col("own") <= quota, 2).otherwise(3))
    return global_rank(layered, F.asc("layer"), F.asc("rank"), name="place").where(F.col("place") <= target).select("module", "name", "layer", "place")


