"""Most similar vectors by additive quantisation (problem 2).

A unit vector is written as a sum of one codeword from each of several full-dimensional codebooks,
each trained on what the earlier ones left over. Encoding keeps a beam of the best partial sums. A
query is scored against a code by adding its dot products with the codewords (looked up in a table)
and dividing by the stored norm of the sum; the best are then scored exactly.

For pairs above a threshold the length of what a code leaves over bounds the error of its dot products,
so that only few pairs are scored exactly and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, grouped, latest


@dataclass
class Codebooks:
    """books: (stages, words, dim). cross[i, j]: dot products of the words of stages i and j."""

    books: np.ndarray

    def __post_init__(self) -> None:
        self.cross = np.einsum("iad,jbd->ijab", self.books, self.books, optimize=True).astype(np.float32)
        self.own = np.einsum("iad,iad->ia", self.books, self.books).astype(np.float32)

    def __getstate__(self) -> dict:
        return {"books": self.books}

    def __setstate__(self, state: dict) -> None:
        self.books = state["books"]
        self.__post_init__()


def _kmeans(x: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        order = np.argsort(near, kind="stable")
        edges = np.searchsorted(near[order], np.arange(words + 1))
        full = edges[1:] > edges[:-1]
        sums = np.add.reduceat(x[order], np.minimum(edges[:-1], len(x) - 1), axis=0)
        centres[full] = sums[full] / (edges[1:] - edges[:-1])[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def train(sample: np.ndarray, stages: int = 12, words: int = 128, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Codebooks from unit vectors, each on the residuals of the ones before."""
    rng = np.random.default_rng(seed)
    rest, books = sample.astype(np.float32), []
    for _ in range(stages):
        centres = _kmeans(rest, words, rounds, rng)
        rest = rest - centres[(rest @ centres.T - (centres**2).sum(1) / 2).argmax(1)]
        books.append(centres)
    return Codebooks(np.stack(books))


def encode(x: np.ndarray, c: Codebooks, beam: int = 4, wide: int = 16, cell_stages: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, norms, cells) of unit vectors. The first stages keep a beam of `wide` sums, which are
    the vector's cells (best first), later ones of `beam`."""
    n, (stages, words, _) = len(x), c.books.shape
    dots = np.einsum("nd,iad->ina", x, c.books, optimize=True).astype(np.float32)
    codes = np.zeros((n, 1, 0), np.int32)
    cost = np.zeros((n, 1), np.float32)
    cells = np.zeros((n, 0), np.int64)
    for i in range(stages):
        # |x - s - w|² = |x - s|² + |w|² - 2 w·x + 2 w·s, up to what all words share
        step = cost[:, :, None] + (c.own[i] - 2 * dots[i])[:, None, :]
        for j in range(i):
            step += 2 * c.cross[j, i][codes[:, :, j]]
        flat = step.reshape(n, -1)
        keep = min(wide if i < cell_stages else beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
        score = np.take_along_axis(flat, best, 1)
        order = np.argsort(score, axis=1, kind="stable")
        best, cost = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None].astype(np.int32)], axis=2)
        if i == cell_stages - 1:
            cells = np.zeros((n, keep), np.int64)
            for j in range(cell_stages):
                cells = cells * words + codes[:, :, j]
    codes = codes[:, 0].astype(np.uint8)
    sums = sum(c.books[i][codes[:, i]] for i in range(stages))
    return codes, np.linalg.norm(sums, axis=1).astype(np.float32), cells


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def unit_vectors(df: DataFrame, key: str, vector: str, when: str | None = None) -> DataFrame:
    """(key, dim, unit): usable vectors scaled to length 1, as packed 32-bit floats.

    Null keys and vectors, vectors with null, infinite or NaN entries, empty and all-zero ones are
    left out. A key that comes several times counts once, with its latest vector.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), (F.col(when) if when else F.lit(None).cast("timestamp")).alias("at"))
    rows = latest(rows, "key", "at", F.col("v")).toDF("key", "v").where("v is not null and size(v) > 0")

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, units = [], [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array(v, np.float64)
                length = np.sqrt(x @ x)
                if np.isfinite(length) and length > 0:
                    keys.append(k)
                    dims.append(len(x))
                    units.append((x / length).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["key", "dim", "unit"])

    return rows.mapInArrow(scale, "key long, dim int, unit binary")


def unpacked(unit: Column) -> Column:
    """Packed 32-bit floats as an array."""

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(b, np.float32))

    return unpack(unit)


def fit(units: DataFrame, sample_size: int = 16384, stages: int = 12, words: int = 128) -> dict[int, Codebooks]:
    """Codebooks for each vector length, from the `sample_size` keys with the smallest hash."""
    books = {}
    for row in units.groupBy("dim").count().collect():
        # No more rows than about twice the sample are sorted, however many there are.
        share = min(1.0, 2 * sample_size / row["count"] + 1e-6)
        drawn = units.where((F.col("dim") == row["dim"]) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
        sample = drawn.orderBy(F.xxhash64("key"), "key").limit(sample_size).select("unit").toArrow()
        x = _matrix(sample.column(0).combine_chunks() if sample.num_rows else sample.column(0), row["dim"])
        # With a word for every vector or so nothing is left over for later codebooks, and the cells of
        # a beam would differ in nothing but the number of an empty word.
        books[row["dim"]] = train(x, stages, min(words, max(2, len(x) // 16)))
    return books


def index(units: DataFrame, books: dict[int, Codebooks], beam: int = 4, wide: int = 16, cell_stages: int = 2) -> DataFrame:
    """(key, dim, codes, norm, rest, cells): every vector encoded. rest is the length of what the
    sum of the codewords leaves over; cells are the best first sums, the nearest first."""
    shared = units.sparkSession.sparkContext.broadcast(books)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims):
                    own = pa.array(np.flatnonzero(dims == dim))
                    c, x = shared.value[int(dim)], _matrix(batch.column(2).take(own), int(dim))
                    codes, norms, cells = encode(x, c, beam, wide, cell_stages)
                    rest = np.linalg.norm(x - sum(c.books[i][codes[:, i]] for i in range(len(c.books))), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(own), batch.column(1).take(own), batch.column(2).take(own), pa.array([r.tobytes() for r in codes], pa.binary()),
                            pa.array(norms), pa.array(rest.astype(np.float32)), pa.array(list(cells), pa.list_(pa.int64())),
                        ],
                        ["key", "dim", "unit", "codes", "norm", "rest", "cells"],
                    )

    return units.mapInArrow(quantise, "key long, dim int, unit binary, codes binary, norm float, rest float, cells array<long>")


def _scores(q: np.ndarray, codes: np.ndarray, norms: np.ndarray, c: Codebooks) -> np.ndarray:
    """Approximate cosines of queries and codes: table lookups, added up, over the stored norms."""
    table = np.einsum("qd,iad->iaq", q, c.books, optimize=True).astype(np.float32)
    total = table[0][codes[:, 0]]
    for i in range(1, len(c.books)):
        total += table[i][codes[:, i]]
    return (total / norms[:, None]).T


def _cells(n: int, per_cell: int, words: int) -> tuple[int, int]:
    """(codebooks that name a cell, cells that list a vector) for so many vectors."""
    stages, wide = 2, 16
    while stages < 4 and n * wide > per_cell * words**stages:
        stages, wide = stages + 1, wide * 4
    return stages, wide


def similar_pairs(df: DataFrame, key: str, vector: str, when: str | None = None, threshold: float = 0.92, block: int = 8192, per_cell: int = 1024, **fitting) -> tuple[DataFrame, DataFrame]:
    """Links of different vectors with a cosine of at least the threshold, and the membership of
    equal ones.

    Returns (links, members): links (a, b, similarity), a < b, between representatives; members
    (key, rep) for every usable vector, rep being the smallest key with the same unit vector.
    All pairs are found: every vector meets the codes of all others of its length, and by the
    inequality of Cauchy and Schwarz what a code leaves over adds at most its length to a dot product.
    So the codes only decide which pairs are scored exactly, and neither their sample nor the number of
    rows has a part in the result; the work grows as the square of the rows. Rows meet in blocks of four
    times `block`, each block with half of the others. per_cell has no influence any more. Nulls,
    zeros, repeated rows: see unit_vectors; other columns are ignored. Vectors of different lengths
    are never compared.
    """
    units = cut_lineage(unit_vectors(df, key, vector, when))
    distinct = units.groupBy("dim", "unit").agg(F.min("key").alias("key")).select("key", "dim", "unit")
    members = units.join(distinct.withColumnRenamed("key", "rep").hint("merge"), ["dim", "unit"]).select("key", "rep")
    books = fit(units, **fitting)
    indexed = cut_lineage(index(distinct, books))
    shared = units.sparkSession.sparkContext.broadcast(books)
    # The number of blocks only decides which task scores a pair.
    blocks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-indexed.count() // (4 * block)))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    none = F.lit(0.0).cast("float")
    asking = indexed.select("dim", own.alias("block"), F.lit(-1).alias("part"), "key", F.col("unit").alias("data"), none.alias("rest"))
    listed = indexed.select("dim", own.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks // 2))).alias("before"), "key", "codes", "rest")
    listed = listed.select("dim", F.pmod(F.col("part") - F.col("before"), F.lit(blocks)).alias("block"), "part", "key", F.col("codes").alias("data"), "rest")
    meeting = asking.unionByName(listed).repartition("dim", "block").sortWithinPartitions("dim", "block", "part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for table in grouped(batches, 3):
            dim, at, part = (table.column(i)[0].as_py() for i in range(3))
            keys, data = table.column("key").to_numpy(), table.column("data").combine_chunks()
            if part < 0:
                here, asked, q = (dim, at), keys, _matrix(data, dim)
            if part < 0 or here != (dim, at):
                continue
            c, rests = shared.value[dim], table.column("rest").to_numpy()
            codes = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, len(c.books))
            for low in range(0, len(codes), 1024):
                near = codes[low : low + 1024]
                sums = sum(c.books[i][near[:, i]] for i in range(len(c.books)))
                # 1e-4: more than 32-bit sums are wrong by.
                least = (threshold - 1e-4 - rests[low : low + 1024])[:, None]
                for start in range(0, len(q), 1024):
                    j, i = np.nonzero(sums @ q[start : start + 1024].T >= least)
                    a, b = asked[start + i], keys[low + j]
                    other = a != b
                    a, b = np.minimum(a, b)[other], np.maximum(a, b)[other]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = meeting.mapInArrow(score, "a long, b long").distinct()
    full = indexed.select("key", "unit")
    both = found.join(full.toDF("a", "ua").hint("merge"), "a").join(full.toDF("b", "ub").hint("merge"), "b").select("a", "b", "ua", "ub")
    return both.mapInArrow(_exact, "a long, b long, similarity double").where(F.col("similarity") >= threshold), members


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [float(np.frombuffer(x, np.float32).astype(np.float64) @ np.frombuffer(y, np.float32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])


def most_similar(df: DataFrame, key: str, vector: str, when: str | None = None, k: int = 10, every: int = 100, rerank: int = 200, block: int = 4096, groups: int = 0, queries: int = 100_000, **fitting) -> DataFrame:
    """(query, neighbour, rank, similarity): for every usable vector whose key is divisible by
    `every` the k most similar other vectors of its length among all rows.

    Queries and codes meet in blocks: of codes there is one block per 250,000 rows and one for each
    core at least, unless `groups` says how many, of queries one per `queries`; each task keeps the `rerank` best per query by lookup score,
    which are then ranked exactly, ties by the smaller key. Fewer than k rows come out where a
    length has fewer vectors. Nulls, zeros and repeated rows: see unit_vectors.
    """
    units = cut_lineage(unit_vectors(df, key, vector, when))
    books = fit(units, **fitting)
    shared = units.sparkSession.sparkContext.broadcast(books)
    indexed = cut_lineage(index(units, books))
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = groups or max(cores, indexed.count() // 250_000)
    asked = units.where(F.pmod("key", F.lit(every)) == 0)
    parts = 1 + asked.count() // queries
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Every row takes its turn in a block by hash; a block is what one task sees of a group.
    listed = indexed.select("dim", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("grp"), every_part(parts).alias("qb"), F.lit(1).alias("role"), "key", F.col("codes").alias("data"), "norm")
    asking = asked.select("dim", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(parts)).cast("int").alias("qb"), "key", "unit")
    asking = asking.select("dim", every_part(groups).alias("grp"), "qb", F.lit(0).alias("role"), "key", F.col("unit").alias("data"), F.lit(0.0).cast("float").alias("norm"))
    meeting = asking.unionByName(listed).select("dim", "grp", "qb", "role", "key", "data", "norm").repartition("dim", "grp", "qb").sortWithinPartitions("dim", "grp", "qb", "role")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            dim, role = table.column("dim")[0].as_py(), table.column("role").to_numpy()
            c, cut, keys = shared.value[dim], int((role == 0).sum()), table.column("key").to_numpy()
            if cut in (0, len(role)):
                continue
            data = table.column("data").combine_chunks()
            norms = table.column("norm").to_numpy()[cut:]
            codes = np.frombuffer(b"".join(data[cut:].to_pylist()), np.uint8).reshape(-1, len(c.books))
            for start in range(0, cut, 256):
                stop = min(cut, start + 256)
                q = _matrix(data[start:stop], dim)
                best, score_of = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
                for low in range(0, len(codes), block):
                    s = _scores(q, codes[low : low + block], norms[low : low + block], c)
                    best = np.concatenate([best, np.broadcast_to(keys[cut + low : cut + low + s.shape[1]], s.shape)], 1)
                    score_of = np.concatenate([score_of, s], 1)
                    if score_of.shape[1] > rerank:
                        at = np.argpartition(-score_of, rerank - 1, axis=1)[:, :rerank]
                        best, score_of = np.take_along_axis(best, at, 1), np.take_along_axis(score_of, at, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[start:stop], best.shape[1])), pa.array(best.ravel()), pa.array(score_of.ravel())], ["q", "m", "s"])

    from pyspark.sql import Window as W

    near = meeting.mapInArrow(score, "q long, m long, s float").where("q <> m")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "m"))).where(F.col("n") <= rerank)
    both = near.select("q", "m").join(units.select(F.col("key").alias("q"), F.col("unit").alias("uq")), "q").join(units.select(F.col("key").alias("m"), F.col("unit").alias("um")), "m")
    ranked = both.select("q", "m", "uq", "um").mapInArrow(_exact, "a long, b long, similarity double")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("query"), F.col("b").alias("neighbour"), "rank", "similarity")
