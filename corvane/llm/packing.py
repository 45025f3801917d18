"""Filling containers of a fixed capacity (problem 8).

Only the histogram of lengths, which has at most as many entries as the capacity, is seen as a whole.
Combinations of up to three different lengths that fill a container are enumerated, non-negative
least squares tells how often each should come, and what rounding leaves is packed greedily, all on
the histogram. Items then find their container by their rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def combinations(lengths: np.ndarray, capacity: int, least_fill: float = 0.98) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, copies), ...) of at most three different lengths that fill the window
    [least_fill * capacity, capacity]; for each length a few numbers of copies, for each of these
    the partners that close the gap with one, two, three or five copies, then one item more."""
    present = np.sort(lengths)
    below = lambda x: int(present[i - 1]) if (i := np.searchsorted(present, x, side="right")) else 0
    found: set[tuple[tuple[int, int], ...]] = set()
    for a in present.tolist():
        most = capacity // a
        for p in sorted({1, 2, most // 2, most - 1, most} & set(range(1, most + 1))):
            gap = capacity - p * a
            partners = {below(gap // q) for q in (1, 2, 3, 5)} if gap else {0}
            for b in partners | {0}:
                parts = {a: p}
                rest = gap
                if b and b <= rest:
                    q = rest // b if b != below(rest) else 1
                    parts[b] = parts.get(b, 0) + q
                    rest -= q * b
                c = below(rest)
                if c:
                    parts[c] = parts.get(c, 0) + 1
                    rest -= c
                if capacity - rest >= least_fill * capacity:
                    found.add(tuple(sorted(parts.items())))
    return sorted(found)


def least_squares(columns: list[tuple[tuple[int, int], ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats x that bring the columns' sum close to the counts, each length's error
    weighed by its size: scaled gradient steps, projected onto x >= 0."""
    place = {int(v): i for i, v in enumerate(lengths)}
    rows = np.array([place[v] for c in columns for v, _ in c], np.int64)
    cols = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    many = np.array([m for c in columns for _, m in c], float)
    per_row = np.bincount(rows, many, len(lengths))
    per_col = np.bincount(cols, many, len(columns))
    x = np.zeros(len(columns))
    for _ in range(rounds):
        error = counts - np.bincount(rows, many * x[cols], len(lengths))
        step = np.bincount(cols, many * (error / np.maximum(per_row, 1e-9))[rows], len(columns)) / per_col
        x = np.maximum(0.0, x + step)
    return x


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """(combination, repeats) that use up a histogram of lengths from 1 to the capacity."""
    left = {v: n for v, n in histogram.items() if n > 0}
    out: Plan = []
    if not left:
        return out
    lengths = np.array(sorted(left), np.int64)
    columns = combinations(lengths, capacity)
    if columns:
        x = least_squares(columns, lengths, np.array([left[v] for v in lengths.tolist()], float))
        for k in np.argsort(-x, kind="stable").tolist():
            repeats = min([int(x[k]), *(left[v] // m for v, m in columns[k])])
            if repeats <= 0:
                continue
            out.append((columns[k], repeats))
            for v, m in columns[k]:
                left[v] -= m * repeats
    # What rounding leaves: the largest length first, then whatever is largest and fits.
    while True:
        present = np.array(sorted(v for v, n in left.items() if n > 0), np.int64)
        if not len(present):
            return out
        room, parts = capacity, {}
        top = len(present)
        while top and room >= present[0]:
            top = min(top, int(np.searchsorted(present, room, side="right")))
            if not top:
                break
            v = int(present[top - 1])
            m = min(left[v], room // v)
            parts[v] = m
            room -= m * v
            top -= 1
        repeats = min(left[v] // m for v, m in parts.items())
        out.append((tuple(sorted(parts.items())), repeats))
        for v, m in parts.items():
            left[v] -= m * repeats


def packed(sizes: DataFrame, key: str, capacity: int, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """(key, piece_no, start, tokens, container) for every item; containers are numbered from 0.

    sizes has the key and `tokens`. An item larger than the capacity is cut into full containers and
    a rest, which is packed like any other item; other items stay whole. Items of 0 or null tokens
    need no container: theirs is null. Repeated keys are separate items. Nothing but the histogram
    (at most `capacity` entries) and the plan made from it is held in one place.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    rows = sizes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    pieces = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1))))
    start = F.col("piece_no").cast("long") * capacity
    pieces = pieces.select("key", "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).cast("int").alias("size"))
    pieces = cut_lineage(pieces)
    counted = pieces.groupBy("size").agg(F.count("*").alias("n")).collect()
    histogram = {r["size"]: r["n"] for r in counted if r["size"] > 0}
    made = plan(histogram, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for parts, repeats in made:
        for v, m in parts:
            slots.setdefault(v, []).append((used.get(v, 0), first, m))
            used[v] = used.get(v, 0) + m * repeats
        first += repeats
    tables = {v: tuple(np.array(x, np.int64) for x in zip(*s)) for v, s in slots.items()}
    shared = sizes.sparkSession.sparkContext.broadcast(tables)

    # Ranks within a length: counted in buckets, so that a length that many items share is ranked
    # by many tasks. The bases are at most capacity x buckets numbers.
    buckets = max(16, sum(r["n"] for r in counted) // rows_per_bucket)
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece_no"), F.lit(buckets)).cast("int"))
    bases = spread.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    bases = bases.select("size", "bucket", (F.sum("n").over(W.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("base"))
    ranked = spread.withColumn("local", F.row_number().over(W.partitionBy("size", "bucket").orderBy("key", "piece_no")) - 1)
    ranked = ranked.join(bases, ["size", "bucket"]).select("key", "piece_no", "start", "size", (F.col("base") + F.col("local")).alias("rank"))
    key_type = ranked.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            container = np.full(len(size), -1, np.int64)
            for v in np.unique(size).tolist():
                if v in shared.value:
                    begins, firsts, many = shared.value[v]
                    at = np.flatnonzero(size == v)
                    k = np.searchsorted(begins, rank[at], side="right") - 1
                    container[at] = firsts[k] + (rank[at] - begins[k]) // many[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container, mask=container < 0)], ["key", "piece_no", "start", "tokens", "container"])

    return ranked.mapInArrow(place, f"key {key_type}, piece_no int, start long, tokens int, container long").withColumnRenamed("key", key)


def fill_report(assigned: DataFrame, capacity: int) -> DataFrame:
    """(items, containers, tokens, fill): one row."""
    per = assigned.where("container is not null")
    # The number of containers is one more than the largest, as they are numbered without gaps.
    return per.agg(F.count("*").alias("items"), F.coalesce(F.max("container") + 1, F.lit(0)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("fill", F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6))
