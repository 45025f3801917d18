"""Import graphs: building, degrees, ranks, roles, subgraphs, cycles and paths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ALONE, BUSINESS, CORE, ENTRY, ROLE_WEIGHT, SUPPORT, UTILITY, top_directory
from ..session import cut_lineage, global_rank, value_at


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): imports (src, module, is_relative) linked to scanned modules (name).

    A relative import climbs a folder for every leading dot but the first. A dotted name is a path.
    An import that names no module is matched by its longest path suffix that ends a module's folder
    or name, the smallest module name first; then inside of the importer's own folder. The suffixes
    of a name are rows, so that no pair of names is compared.
    """
    folder = F.when(F.col("src").contains("/"), F.regexp_replace("src", "/[^/]*$", "")).otherwise(F.lit(""))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.regexp_replace("module", r"^\.+/?", "")
    climbed = F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(folder, "/")) - F.greatest(F.lit(0), dots - 1)))
    tail = F.when(rest.contains("/"), F.regexp_replace(rest, r"\.[^./]*$", "")).otherwise(F.replace(rest, F.lit("."), F.lit("/")))
    relative = F.array_join(F.filter(F.concat(climbed, F.array(tail)), lambda x: x != ""), "/")
    target = F.when(F.col("is_relative") | F.col("module").startswith("."), relative).when(F.col("module").contains("/"), F.col("module")).otherwise(F.replace("module", F.lit("."), F.lit("/")))
    wanted = imports.where("module is not null and module <> ''").select("src", "module", target.alias("target"), folder.alias("folder"), F.coalesce("is_relative", F.lit(False)).alias("is_relative")).distinct()
    names = modules.select("name").distinct()
    direct = wanted.join(names.withColumnRenamed("name", "target"), "target", "left_semi").select("src", "module", F.col("target").alias("dst"))
    open_ones = wanted.join(direct.select("src", "module"), ["src", "module"], "left_anti").where("not is_relative")
    # Keys by which a module can be the end of a longer import: its name and its folder.
    keys = names.select("name", F.explode(F.array_distinct(F.array(F.col("name"), F.when(F.col("name").contains("/"), F.regexp_replace("name", "/[^/]*$", "")).otherwise(F.col("name"))))).alias("key"))
    keys = keys.groupBy("key").agg(F.min("name").alias("dst"))
    parts = F.split("target", "/")
    suffixes = open_ones.select("src", "module", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("cut", "key"))
    by_suffix = suffixes.join(keys, "key").groupBy("src", "module").agg(F.min_by("dst", "cut").alias("dst"))
    left = open_ones.join(by_suffix.select("src", "module"), ["src", "module"], "left_anti")
    sibling = F.when(F.col("folder") == "", F.col("target")).otherwise(F.concat_ws("/", "folder", "target"))
    nearby = left.select("src", "module", sibling.alias("name")).join(names, "name", "left_semi").select("src", "module", F.col("name").alias("dst"))
    return direct.unionByName(by_suffix).unionByName(nearby).where("src <> dst").select("src", "dst").distinct()


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between known nodes, without loops."""
    names = nodes.select("name")
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    return pairs.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n_in, n_out) of every node. Counted before joining, so that a hub is one row."""
    n_in = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n_in"))
    n_out = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n_out"))
    return nodes.select("name").join(n_in, "name", "left").join(n_out, "name", "left").fillna(0, ["n_in", "n_out"])


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).where("n_in = 0 and n_out > 0").select("name")


def coarsened(edges: DataFrame) -> DataFrame:
    """Distinct edges between different top folders."""
    return edges.select(top_directory(F.col("src")).alias("src"), top_directory(F.col("dst")).alias("dst")).where("src <> dst").distinct()


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges with both ends among the names."""
    return edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """The edges among a node and its neighbours of either direction."""
    near = edges.where(F.col("src") == node).select(F.col("dst").alias("name")).union(edges.where(F.col("dst") == node).select("src")).union(edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.lit(node)))
    return induced(edges, near.distinct())


#: Up to so many nodes and edges in all a graph is worked on by one task; beyond it by joins.
ONE_TASK = 2_000_000


def _whole(nodes: DataFrame, edges: DataFrame, schema: str, work) -> DataFrame:
    """Runs work(names, src, dst) -> columns on a small graph in one task; src and dst are numbers of
    names, which are sorted."""
    rows = nodes.select(F.col("name").alias("a"), F.lit(None).cast("string").alias("b")).distinct().unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).to_pandas()
        is_node = table["b"].isna().to_numpy()
        names = np.sort(table["a"].to_numpy()[is_node].astype(object))
        pairs = table[~is_node]
        yield pa.RecordBatch.from_arrays(*work(names, np.searchsorted(names, pairs["a"].to_numpy().astype(object)), np.searchsorted(names, pairs["b"].to_numpy().astype(object))))

    return cut_lineage(rows.repartition(1).mapInArrow(run, schema))


def is_small(nodes: DataFrame, edges: DataFrame) -> bool:
    return nodes.count() + edges.count() <= ONE_TASK


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(name, score). Starts even; what nodes without outgoing edges hold is not handed out; stops
    when the scores change by less than the tolerance in sum. Edges are between nodes."""
    n = nodes.select("name").distinct().count()
    if n == 0:
        return nodes.select("name", F.lit(0.0).alias("score"))
    if n + edges.count() <= ONE_TASK:

        def work(names: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[list, list[str]]:
            share = damping / np.maximum(1, np.bincount(src, minlength=len(names)))
            score = np.full(len(names), 1.0 / len(names))
            for _ in range(rounds):
                new = (1 - damping) / len(names) + np.bincount(dst, (score * share)[src], minlength=len(names))
                change, score = np.abs(new - score).sum(), new
                if tolerance and change < tolerance:
                    break
            return [pa.array(names, pa.string()), pa.array(score)], ["name", "score"]

        return _whole(nodes, edges, "name string, score double", work)
    return _pagerank_joined(nodes, edges, n, damping, rounds, tolerance)


def _pagerank_joined(nodes: DataFrame, edges: DataFrame, n: int, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """The same by joins; scores are written every fourth round, and only then compared."""
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    weighted = cut_lineage(edges.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("k")).alias("w")).repartition("src"))
    scores = cut_lineage(nodes.select("name").distinct().select("name", F.lit(1.0 / n).alias("score")))
    for k in range(1, rounds + 1):
        given = weighted.join(scores.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("w") * F.col("score")).alias("given"))
        new = scores.withColumnRenamed("score", "old").join(given, "name", "left").select("name", "old", (F.lit((1 - damping) / n) + F.coalesce("given", F.lit(0.0))).alias("score"))
        if k % 4 == 0 or k == rounds:
            new = cut_lineage(new)
            if tolerance and (new.agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("d")).collect()[0]["d"] or 0) < tolerance:
                return new.select("name", "score")
        scores = new.select("name", "score")
    return scores


def roles(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(name, score, n_in, n_out, role) by entry, rank percentile and degree."""
    all_ = cut_lineage(scores.join(degrees(nodes, edges), "name"))
    n = all_.count()
    high, low = value_at(all_, "score", int(n * 0.8)), value_at(all_, "score", int(n * 0.3))
    role = (
        F.when((F.col("n_in") == 0) & (F.col("n_out") > 0), ENTRY)
        .when((F.col("score") >= high) & (F.col("n_in") >= 2), CORE)
        .when((F.col("n_out") >= 2) & (F.col("n_in") == 0) & (F.col("score") <= low), UTILITY)
        .when((F.col("n_in") == 0) & (F.col("n_out") == 0), ALONE)
        .when((F.col("n_in") >= 1) & (F.col("n_out") >= 1), BUSINESS)
        .otherwise(SUPPORT)
    )
    return all_.withColumn("role", role)


def role_weight(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_WEIGHT.items() for x in kv]), role), F.lit(0.1))


def top_modules(ranked: DataFrame, most: int = 0) -> DataFrame:
    """(name, role, value, place): entries and core first, then by half rank, three tenths of the
    dependents and a fifth of the role's weight; all up to 30 modules, 70 % up to 80, else 50 %."""
    bounds = ranked.agg(*[f(c).alias(f"{a}_{c}") for c in ("score", "n_in") for a, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))
    norm = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    value = F.round(0.5 * norm("score") + 0.3 * norm("n_in") + 0.2 * role_weight(F.col("role")), 9)
    valued = ranked.join(F.broadcast(bounds)).select("name", "role", value.alias("value"), "n", F.col("role").isin(ENTRY, CORE).alias("must"))
    placed = global_rank(valued, F.desc("must"), F.desc("value"), F.asc("name"), name="place")
    kept = F.when(F.col("n") <= 30, F.col("n")).when(F.col("n") <= 80, F.floor(F.col("n") * 0.7)).otherwise(F.floor(F.col("n") * 0.5))
    if most:
        kept = F.least(kept, F.lit(most))
    return placed.where(F.col("place") <= kept).select("name", "role", "value", "place")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(name, community): nodes take their neighbours' most frequent label, the smallest of equally
    frequent ones, one after the other in the order of their names, until nothing changes or for
    `rounds` rounds; nodes without neighbours keep their own. That order is one task's, so that a
    larger graph is refused: see communities_at_once."""
    if not is_small(nodes, edges):
        raise ValueError(f"more than {ONE_TASK} nodes and edges; use communities_at_once")

    def work(names: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[list, list[str]]:
        near: list[list[int]] = [[] for _ in names]
        for a, b in zip(src.tolist(), dst.tolist()):
            near[a].append(b)
            near[b].append(a)
        label = list(range(len(names)))
        for _ in range(rounds):
            moved = False
            for k, others in enumerate(near):
                if others:
                    votes = Counter([label[o] for o in others])
                    best = min(votes, key=lambda x: (-votes[x], x))
                    moved |= best != label[k]
                    label[k] = best
            if not moved:
                break
        return [pa.array(names, pa.string()), pa.array([names[x] for x in label], pa.string())], ["name", "community"]

    return _whole(nodes, edges, "name string, community string", work)


def communities_at_once(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(name, community): as communities, but all nodes take their new labels at the same time."""
    near = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("name", "near"))
    labels = cut_lineage(nodes.select("name", F.col("name").alias("label")))
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("name").alias("near"), "label"), "near").groupBy("name", "label").agg(F.count("*").alias("k"))
        best = votes.groupBy("name").agg(F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("x")).select("name", F.col("x.label").alias("new"))
        step = cut_lineage(labels.join(best, "name", "left").select("name", "label", F.coalesce("new", "label").alias("new")))
        moved = step.where("label <> new").limit(1).count()
        labels = step.select("name", F.col("new").alias("label"))
        if not moved:
            break
    return labels.withColumnRenamed("label", "community")


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(nodes, size): simple cycles of up to `longest` nodes, each once, beginning with its smallest
    node. A path only goes on to nodes larger than its first, so that no rotation comes twice."""
    pairs = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    path = pairs.where("dst > src").select(F.array("src", "dst").alias("nodes"))
    found = []
    for size in range(2, longest + 1):
        stepped = path.join(pairs, F.element_at("nodes", -1) == F.col("src"))
        found.append(stepped.where(F.col("dst") == F.col("nodes")[0]).select("nodes", F.lit(size).alias("size")))
        path = cut_lineage(stepped.where((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cycle_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): the edges that lie on a cycle, of any length.

    First nodes without edges in or out are peeled off, round by round, until none is left; an acyclic
    graph ends here. What remains is split into strongly connected parts: every node takes the smallest
    label that reaches it forwards, and the nodes from which its label's own node can be reached keep
    it; those parts are taken out and the rest goes on."""
    rest = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    out = rest.limit(0)
    while True:
        rest = _peeled(rest)
        if rest.isEmpty():
            return out
        label = _spread(rest, "src", "dst", rest.select(F.col("src").alias("name")).distinct().withColumn("label", F.col("name")))
        # Backwards from a label's own node, along edges within the label.
        inner = cut_lineage(rest.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("label")))
        parts = label.where("name = label").select("name", "label")
        while True:
            more = inner.join(parts.select(F.col("name").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("name"), "label")
            grown = cut_lineage(parts.union(more).distinct())
            same = grown.count() == parts.count()
            parts = grown
            if same:
                break
        part = lambda end: parts.select(F.col("name").alias(end), F.col("label").alias(f"l_{end}"))
        out = cut_lineage(out.union(inner.join(part("src"), "src").join(part("dst"), "dst").where("l_src = l_dst").select("src", "dst")))
        names = parts.select("name")
        rest = cut_lineage(rest.join(names.toDF("src"), "src", "left_anti").join(names.toDF("dst"), "dst", "left_anti"))


def _peeled(edges: DataFrame) -> DataFrame:
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = cut_lineage(kept.select("src", "dst"))
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def _spread(edges: DataFrame, along: str, to: str, labels: DataFrame) -> DataFrame:
    """(name, label): the smallest label that reaches each node along the edges."""
    labels = cut_lineage(labels)
    while True:
        sent = edges.join(labels.select(F.col("name").alias(along), "label"), along).groupBy(F.col(to).alias("name")).agg(F.min("label").alias("sent"))
        step = cut_lineage(labels.join(sent, "name", "left").select("name", "label", F.least("label", F.coalesce("sent", "label")).alias("new")))
        moved = not step.where("new <> label").isEmpty()
        labels = step.select("name", F.col("new").alias("label"))
        if not moved:
            return labels


def call_paths(calls: DataFrame, longest: int = 4, least: int = 2) -> DataFrame:
    """(start, path, n_edges): chains of calls from functions that nobody calls, of at least `least`
    edges and two modules; no function is reached twice on a chain. Where every function is called,
    chains begin at the smallest one."""
    key = lambda m, f: F.concat_ws("#", m, f)
    edges = calls.select(key("from_module", "from_name").alias("a"), key("to_module", "to_name").alias("b"), F.col("from_module").alias("ma"), F.col("to_module").alias("mb")).distinct()
    edges = cut_lineage(edges)
    sources = edges.join(edges.where("a <> b").select(F.col("b").alias("a")), "a", "left_anti")
    if sources.isEmpty():
        sources = edges.join(edges.agg(F.min("a").alias("a")), "a", "left_semi")
    heads = sources.where("a <> b")
    path = heads.select(F.array("a", "b").alias("path"), F.array("ma", "mb").alias("mods"))
    found = None
    for n in range(1, longest + 1):
        if n >= least:
            now = path.where(F.size(F.array_distinct("mods")) >= 2).select(F.col("path")[0].alias("start"), F.array_join("path", " -> ").alias("path"), F.lit(n).alias("n_edges"))
            found = now if found is None else found.unionByName(now)
        if n < longest:
            reached = F.slice("path", 2, 1000)
            path = cut_lineage(path.join(edges, F.element_at("path", -1) == F.col("a")).where(~F.array_contains(reached, F.col("b"))).select(F.concat("path", F.array("b")).alias("path"), F.concat("mods", F.array("mb")).alias("mods")))
            if n >= least and path.isEmpty():
                break
    return found


def shares_of_rank(df: DataFrame, order: Column, tie: str) -> DataFrame:
    """Adds rank / n with ranks from 0, for cuts at fixed shares."""
    n = df.count()
    return global_rank(df, order, F.asc(tie)).withColumn("share", (F.col("rank") - 1) / F.lit(max(1, n)))


def window_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in an order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
