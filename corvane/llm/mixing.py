"""Mixing sources to target shares (problem 9).

The largest total is taken at which no source needs a document more often than allowed. Each document
then has the same expected number of copies as the others of its source: a whole part and a fraction.
Fractions are rounded by the pivotal method: two documents trade tokens at random until one of them
is decided, so that a source's tokens stay what they should be up to one document. Blocks of documents
are rounded by themselves, large ones first; what each leaves undecided meets in a tree of further rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, grouped

EDGE = 1e-9


def _chance(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the pair alone, so that a repeated task repeats it."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivotal(keys: list[int], weights: list[float], parts: list[float], seed: int) -> list[float]:
    """Probabilities after rounding; at most one stays strictly between 0 and 1.

    Of two open documents one gains tokens and the other loses as many, by the largest amount that
    decides one of them, with such chances that neither's expectation changes.
    """
    p = list(parts)
    held = -1
    for k in range(len(p)):
        if not EDGE < p[k] < 1 - EDGE:
            p[k] = float(round(p[k]))
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        wi, wj = max(weights[i], EDGE), max(weights[j], EDGE)
        up = min((1 - p[i]) * wi, p[j] * wj)
        down = min(p[i] * wi, (1 - p[j]) * wj)
        move = up if _chance(seed, keys[i], keys[j]) < down / (up + down) else -down
        p[i] += move / wi
        p[j] -= move / wj
        for x in (i, j):
            if p[x] < EDGE or p[x] > 1 - EDGE:
                p[x] = float(round(p[x]))
        open_ones = [x for x in (i, j) if 0 < p[x] < 1]
        held = open_ones[0] if open_ones else -1
    return p


def _round_blocks(df: DataFrame, seed: int) -> DataFrame:
    """Pivotal rounding within (source, block); documents are paired in the order of their size."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped((b.select(["source", "block", "doc_id", "tokens", "part"]) for b in batches), 2):
            table = table.combine_chunks()
            p = pivotal(table.column("doc_id").to_pylist(), table.column("tokens").to_pylist(), table.column("part").to_pylist(), seed)
            yield from table.set_column(4, "part", pa.array(p, pa.float64())).to_batches()

    return df.select("source", "block", "doc_id", "tokens", "part").repartition("source", "block").sortWithinPartitions("source", "block", F.col("tokens").desc(), "doc_id").mapInArrow(step, "source string, block long, doc_id long, tokens long, part double")


def _rounded(rows: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(doc_id, part) with every part 0 or 1: blocks first, then a tree that brings 64 blocks'
    remainders together at each level. At most one document of a source is left at last; its own
    chance decides."""
    open_ones = cut_lineage(_round_blocks(rows, seed))
    decided = [open_ones.where("part = 0 or part = 1")]
    while blocks > 1:
        rest = open_ones.where("part > 0 and part < 1").withColumn("block", F.floor(F.col("block") / 64))
        blocks = -(-blocks // 64)
        open_ones = cut_lineage(_round_blocks(rest, seed + blocks))
        decided.append(open_ones.where("part = 0 or part = 1"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    decided.append(open_ones.where("part > 0 and part < 1").withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0)))
    return reduce(DataFrame.unionByName, decided).select("doc_id", "part")


def aims(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, max_repeats, aim): the tokens each target source should give. The total is the largest
    at which every source reaches its share within its cap without any document that has more tokens
    than the share itself. Leaving such documents out can lower the total and so leave out more, which
    is repeated until nothing changes; the total only falls, past the size of one document at least
    each time. One row per target source."""
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", F.col("target_share").cast("double").alias("share"), "max_repeats").dropDuplicates(["source"])
    bounds = cut_lineage(wanted.withColumn("aim", F.lit(float("inf"))))
    total = None
    while True:
        held = sized.join(F.broadcast(bounds), "source").where(F.col("tokens") <= F.col("aim") + 0.5).groupBy("source").agg(F.sum("tokens").alias("held"))
        per_source = held.join(wanted, "source")
        row = per_source.agg(F.min(F.col("held") * F.col("max_repeats") / F.col("share")).alias("total")).collect()[0]
        if row["total"] is None or row["total"] == total:
            return bounds.where(F.lit(total is not None)).select("source", "max_repeats", "aim")
        total = row["total"]
        bounds = cut_lineage(per_source.select("source", "share", "max_repeats", (F.col("share") * F.lit(total)).alias("aim")))


def _sized(sizes: DataFrame) -> DataFrame:
    return cut_lineage(sizes.where("doc_id is not null and source is not null and tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("tokens").cast("long").alias("tokens")))


def mixed(sizes: DataFrame, targets: DataFrame, block_rows: int = 50_000, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents that are used, copies from 1 to the cap.

    sizes has doc_id (unique), source and tokens; targets source, target_share and max_repeats.
    Documents of other sources, without a source or of 0 tokens are not used; a source whose target
    is null or 0 isn't either. A target source without tokens makes its share unreachable and is left
    out, the others keep their proportions. Totals and documents that are too large for any such
    mixture: see aims; left_out names them. Documents are rounded from the largest to the smallest,
    so that what is undecided at last is small.
    """
    sized = _sized(sizes)
    wanted = aims(sized, targets)
    # At most one row for each target source.
    usable = sized.join(F.broadcast(wanted), "source").where(F.col("tokens") <= F.col("aim") + 0.5)
    rates = usable.groupBy("source", "aim", "max_repeats").agg(F.sum("tokens").alias("held"), F.count("*").alias("docs"))
    rates = cut_lineage(rates.select("source", F.least(F.col("max_repeats").cast("double"), F.col("aim") / F.col("held")).alias("rate"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_rows)).cast("int").alias("blocks")))
    blocks = rates.agg(F.max("blocks").alias("b")).collect()[0]["b"] or 1
    whole = F.floor(F.col("rate") + EDGE)
    rows = usable.join(F.broadcast(rates), "source").select(
        "source", "doc_id", "tokens", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("part"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("long").alias("block")
    )
    rows = cut_lineage(rows)
    done = rows.select("doc_id", "source", "tokens", "whole").join(_rounded(rows, blocks, seed), "doc_id")
    return done.select("doc_id", "source", "tokens", (F.col("whole") + F.col("part").cast("int")).alias("copies")).where("copies > 0")


def left_out(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, aim) of the documents that have more tokens than their source may give."""
    sized = _sized(sizes)
    return sized.join(F.broadcast(aims(sized, targets)), "source").where(F.col("tokens") > F.col("aim") + 0.5).select("doc_id", "source", "tokens", F.round("aim", 1).alias("aim"))


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, documents, most_copies) of each target source."""
    per = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share").join(per, "source", "left").crossJoin(total)
    return out.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
