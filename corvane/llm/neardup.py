"""Near-duplicate records by weighted MinHash signatures (problem 6).

Every element of a multiset owns a Poisson process per weight level; levels are doubling strips
[0,1), [1,2), [2,4), ... of the discretised weight, and a point of a strip counts only if it lies
below the element's weight. A point carries a slot; a slot's signature is the earliest point that
falls into it. Two multisets agree in a slot with the probability of their weighted Jaccard
similarity. Points are drawn lazily and only while they can still improve a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
_alnum: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _is_word() -> np.ndarray:
    global _alnum
    if _alnum is None:
        _alnum = np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            if chr(c).isalnum():
                _alnum[c] = True
        _alnum[ord("_")] = True
    return _alnum


def _powers(n: int, cache: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    have = cache.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            cache["p"] = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, BASE, U64)]))
            inverse = pow(int(BASE), -1, 1 << 64)
            cache["i"] = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(inverse), U64)]))
    return cache["p"][:n], cache["i"][:n]


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, count) of all distinct runs of `width` words, sorted by document and
    element. Elements are 64-bit hashes; words are runs of letters, digits and underscores of the
    lower-cased text."""
    none = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_word()[chars]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < width:
        return none
    with np.errstate(over="ignore"):
        powers, inverse = _powers(len(chars))
        prefix = np.concatenate([[U64(0)], np.cumsum((chars.astype(U64) + U64(1)) * powers)])
        words = mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64))
        bounds = np.cumsum([len(t) + 1 for t in lowered])
        doc = np.searchsorted(bounds, starts, side="right")
        n = len(words) - width + 1
        value = np.zeros(n, U64)
        for k in range(width):
            value = mix(value * U64(31) + words[k : n + k])
    whole = doc[:n] == doc[width - 1 :]
    if not whole.any():
        return none
    doc, value = doc[:n][whole], value[whole]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
    return doc[first].astype(np.int64), value[first], np.diff(np.concatenate([first, [len(doc)]]))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """The (n_docs, slots) signatures of weighted sets; documents without elements keep all ones."""
    best = np.full(n_docs * slots, np.inf)
    owner = np.full(n_docs * slots, np.iinfo(np.uint64).max, U64)
    top = int(weight.max()) if len(weight) else 0
    strip, low = 0, 0
    while low < top:
        high = max(1, low * 2)
        live = np.flatnonzero(weight > low)
        d, w = doc[live], weight[live]
        seed = mix(element[live] ^ mix(np.full(len(live), strip + 1, U64)))
        time, turn = np.zeros(len(live)), 0
        while len(d):
            turn += 1
            r = mix(seed + U64(turn * int(BASE) % (1 << 64)))
            time = time - np.log(((r >> U64(11)).astype(float) + 1) / (1 << 53)) / (high - low)
            r2 = mix(r ^ U64(0xA5A5A5A5A5A5A5A5))
            slot = (r2 % U64(slots)).astype(np.int64)
            level = low + (high - low) * ((r2 >> U64(32)).astype(float) / (1 << 32))
            at = d * slots + slot
            counts = level < w
            np.minimum.at(best, at[counts], time[counts])
            won = counts & (best[at] == time)
            owner[at[won]] = r[won]
            worst = best.reshape(n_docs, slots).max(axis=1)
            stay = time < worst[d]
            d, w, seed, time = d[stay], w[stay], seed[stay], time[stay]
        low, strip = high, strip + 1
    return owner.reshape(n_docs, slots)


def _slices(whole: pa.RecordBatch, rows: int = 1024, characters: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch that are worked on at once, with their texts; a longer text is a part of its own."""
    texts = whole.column(1).to_pylist()
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and (k - start == rows or size + len(text) > characters):
            yield whole.slice(start, k - start), texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts:
        yield whole.slice(start), texts[start:]


def near_duplicates(
    df: DataFrame, key: str, text: str, when: str | None = None, width: int = 5, threshold: float = 0.8, least: int = 1, weighted: bool = True, bands: int = 36, rows: int = 4, block: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the membership of equal ones.

    Returns (links, members). links has (a, b, similarity) for representatives a < b of different
    element multisets whose (weighted) Jaccard similarity is at least the threshold; members has
    (key, rep) for every record with at least `least` distinct elements, where rep is the smallest
    key with the same elements. So a group of copies costs one representative, however large it is.

    weighted=False compares sets, True multisets. Keys that come several times count once (their
    contents are taken to be equal; with `when`, the latest delivery holds). Null keys and texts
    are left out, texts with fewer elements too; a null time counts as the earliest; extra columns
    are ignored. Signatures find the candidates, each candidate is verified on its whole multiset of
    64-bit elements: a pair at exactly 0.7 is missed with a probability of 5e-5 at 36 bands of 4 rows,
    at 0.8 of 1e-8. Records count as equal by 128 bits over all elements. A band that more than `block`
    representatives share is joined in blocks, so that no task holds all of them. All tables that grow
    with the input are joined by merging: what Spark takes for their size doesn't count the rows that
    bands and elements unfold to, so that it would send them to every node through the driver.
    """
    if bands > 256:
        raise ValueError("at most 256 bands")
    slots = bands * rows
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), (F.coalesce(F.col(when), F.lit("1900-01-01").cast("timestamp")) if when else F.lit(0)).alias("at"))
    source = spread(source.where(F.col("key").isNotNull() & F.col("text").isNotNull()))

    def sign(batches: Iterator[pa.RecordBatch], sets: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _slices(whole):
                doc, element, count = shingles(texts, width)
                if not weighted:
                    count = np.ones_like(count)
                sizes = np.bincount(doc, minlength=len(texts))
                keep = np.flatnonzero(sizes >= max(1, least))
                if not len(keep):
                    continue
                ends = np.cumsum(sizes)
                with np.errstate(over="ignore"):
                    one = mix(element ^ mix(count.astype(U64)))
                    sums = [np.concatenate([[U64(0)], np.cumsum(x)]) for x in (one, mix(one ^ BASE))]
                    same = np.stack([mix(t[ends] - t[ends - sizes])[keep] for t in sums], axis=1)
                    columns = [batch.column(0).take(pa.array(keep)), batch.column(2).take(pa.array(keep)), pa.array([x.tobytes() for x in same], pa.binary())]
                    if sets:
                        packed = []
                        for i in keep:
                            part = slice(ends[i] - sizes[i], ends[i])
                            packed.append(element[part].tobytes() + (count[part].astype(np.uint64).tobytes() if weighted else b""))
                        columns.append(pa.array(packed, pa.binary()))
                    else:
                        value = np.zeros((len(keep), bands), U64)
                        grouped = signatures(doc, element, count, len(texts), slots)[keep].reshape(len(keep), bands, rows)
                        for r in range(rows):
                            value = mix(value * U64(31) + grouped[:, :, r])
                        short = (value >> U64(32)).astype(np.uint32).view(np.int32).ravel()
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, value.size + 1, bands, dtype=np.int32)), pa.array(short)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "at", "same", "elements" if sets else "bands"])

    # Texts are read twice, once for signatures and once for the sets of candidates: that costs
    # less than to keep all sets in between.
    at_type = source.schema["at"].dataType.simpleString()
    signed = source.mapInArrow(lambda b: sign(b, False), f"key long, at {at_type}, same binary, bands array<int>")
    signed = cut_lineage(signed.groupBy("key").agg(F.max_by(F.struct("same", "bands"), "at").alias("x")).select("key", "x.*"))
    # The copy with the smallest key stands for its group; only representatives are banded.
    reps = cut_lineage(signed.groupBy("same").agg(F.min(F.struct("key", "bands")).alias("x")).select("same", "x.*"))
    members = signed.select("key", "same").join(reps.select(F.col("key").alias("rep"), "same").hint("merge"), "same").select("key", "rep")
    banded = reps.select("key", F.posexplode("bands")).select("key", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col")).alias("band"))
    pairs = cut_lineage(_sharing(banded, block))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(reps.select("key", "same").hint("merge"), "key")
    # Only the texts of candidates are read for their elements.
    told = source.join(asked.select("key").hint("merge"), "key", "left_semi").select("key", "text", "at")
    sets = told.mapInArrow(lambda b: sign(b, True), f"key long, at {at_type}, same binary, elements binary")
    sets = sets.select("key", "same", "elements").join(asked.hint("merge"), ["key", "same"], "left_semi").dropDuplicates(["key"]).select("key", "elements")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")).hint("merge"), "a").join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")).hint("merge"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            score = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(left.to_pylist(), right.to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if weighted:
                    p, q = len(x) // 2, len(y) // 2
                    _, i1, i2 = np.intersect1d(x[:p], y[:q], assume_unique=True, return_indices=True)
                    common = int(np.minimum(x[p:][i1], y[q:][i2]).sum())
                    union = int(x[p:].sum()) + int(y[q:].sum()) - common
                else:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - common
                score[i] = common / union
            kept = pa.array(np.flatnonzero(score >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([a.take(kept), b.take(kept), pa.array(score).take(kept)], ["a", "b", "similarity"])

    links = both.select("a", "b", "ea", "eb").mapInArrow(verify, "a long, b long, similarity double")
    return links, members


def _sharing(banded: DataFrame, block: int, every: int = 64) -> DataFrame:
    """Distinct pairs (a < b) of keys that share a band. Bands of more than about `block` keys are
    recognised on every 64th key; these are cut into blocks by hash, and each pair of blocks meets on
    its own. The sample only decides how a band is cut, so that no pair depends on it."""
    probe = banded.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).groupBy("band").agg(F.ceil(F.count("*") * every / block).cast("int").alias("m"))
    hot = cut_lineage(probe.where("m > 1"))
    n = hot.count()
    if n:
        # Broadcast up to a stated size, else joined by its key.
        cut = banded.join(F.broadcast(hot) if n <= 50_000 else hot.hint("merge"), "band", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("key", F.lit(5)), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        banded = cut.select("key", "band", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        on = (F.col("x.band") == F.col("y.band")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.lo") == F.col("x.hi")))
    else:
        on = F.col("x.band") == F.col("y.band")
    pairs = banded.alias("x").join(banded.alias("y").hint("merge"), on & (F.col("x.key") < F.col("y.key")))
    return pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a < b) of all records, copies expanded; for results that are defined on pairs."""
    m = members.select(F.col("key").alias("k1"), F.col("rep").alias("a"))
    n = members.select(F.col("key").alias("k2"), F.col("rep").alias("b"))
    linked = links.select("a", "b").join(m.hint("merge"), "a").join(n.hint("merge"), "b").select("k1", "k2")
    equal = m.join(n.withColumnRenamed("b", "a").hint("merge"), "a").where(F.col("k1") < F.col("k2")).select("k1", "k2")
    return linked.unionByName(equal).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(key, group_id): connected records, named by their smallest key. Labels spread by joins over
    the links of representatives, each round halves long paths by also jumping to the label's label, until nothing changes."""
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g")))
    while True:
        near = edges.join(label.select(F.col("a").alias("b"), "g").hint("merge"), "b").groupBy("a").agg(F.min("g").alias("h"))
        stepped = label.join(near.hint("merge"), "a").select("a", F.least("g", "h").alias("g"))
        jumped = stepped.join(label.select(F.col("a").alias("g"), F.col("g").alias("j")).hint("merge"), "g", "left").select("a", F.least("g", F.coalesce("j", "g")).alias("g"))
        new = cut_lineage(jumped)
        changed = new.join(label.withColumnRenamed("g", "old").hint("merge"), "a").where("g <> old").limit(1).count()
        label = new
        if not changed:
            break
    return members.join(label.select(F.col("a").alias("rep"), "g").hint("merge"), "rep", "left").select("key", F.coalesce("g", "rep").alias("group_id"))
