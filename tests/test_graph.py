"""Small graphs with results worked out by hand."""

import itertools
import random

from corvane.operators import graph as G
from corvane.session import global_rank, value_at


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ranks(spark, names, pairs, **kw):
    return {r["name"]: r["score"] for r in G.pagerank(nodes_of(spark, names), edges_of(spark, pairs), **kw).collect()}


def test_pagerank_of_five_modules(spark):
    names = ["main", "a/service", "b/service", "models/user", "utils/logger"]
    pairs = [("main", "a/service"), ("main", "b/service"), ("a/service", "models/user"), ("b/service", "models/user"), ("a/service", "utils/logger"), ("b/service", "utils/logger")]
    got = ranks(spark, names, pairs)
    assert abs(got["main"] - 0.03) < 1e-9 and abs(got["a/service"] - 0.04275) < 1e-9
    assert abs(got["models/user"] - 0.0663375) < 1e-9 and abs(got["models/user"] - got["utils/logger"]) < 1e-12


def test_pagerank_of_an_empty_graph(spark):
    assert G.pagerank(nodes_of(spark, []), edges_of(spark, [])).count() == 0


def test_roles(spark):
    names = ["services/api", "models/user", "utils/logger", "main"]
    pairs = [("main", "services/api"), ("services/api", "models/user"), ("services/api", "utils/logger")]
    n, e = nodes_of(spark, names), edges_of(spark, pairs)
    got = {r["name"]: r["role"] for r in G.roles(n, e, G.pagerank(n, e)).collect()}
    assert got == {"main": "入口层", "services/api": "业务模块", "models/user": "支撑模块", "utils/logger": "支撑模块"}


def test_imports_by_suffix_and_folder(spark):
    modules = nodes_of(spark, ["cmd/main", "internal/store/store", "internal/cache/cache", "pkg/a", "pkg/b"])
    imports = spark.createDataFrame(
        [("cmd/main", "example.org/app/internal/store", False), ("cmd/main", "fmt", False), ("internal/store/store", "example.org/app/internal/cache", False), ("pkg/a", ".b", True), ("pkg/a", "pkg.b", False), ("pkg/b", "b", False)],
        "src string, module string, is_relative boolean",
    )
    got = {(r["src"], r["dst"]) for r in G.resolve_imports(imports, modules).collect()}
    assert got == {("cmd/main", "internal/store/store"), ("internal/store/store", "internal/cache/cache"), ("pkg/a", "pkg/b")}


def test_cycles_against_brute_force(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(7)]
    pairs = {(a, b) for a in names for b in names if a != b and rng.random() < 0.3}
    expected = set()
    for size in (2, 3, 4):
        for c in itertools.permutations(names, size):
            if c[0] == min(c) and all((c[i], c[(i + 1) % size]) in pairs for i in range(size)):
                expected.add(c)
    got = {tuple(r["nodes"]) for r in G.cycles(edges_of(spark, sorted(pairs)), 4).collect()}
    assert got == expected


def test_cycle_edges_against_brute_force(spark):
    rng = random.Random(11)
    for _ in range(3):
        names = [f"n{i:02}" for i in range(12)]
        pairs = {(a, b) for a in names for b in names if a != b and rng.random() < 0.12}
        reach = set(pairs)
        while True:
            more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
            if not more:
                break
            reach |= more
        assert {tuple(r) for r in G.cycle_edges(edges_of(spark, sorted(pairs))).collect()} == {(a, b) for a, b in pairs if (b, a) in reach}
    assert G.cycle_edges(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "a")])).count() == 0


def test_joined_ranks_equal_those_of_one_task(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    pairs = sorted({(rng.choice(names), rng.choice(names[:20])) for _ in range(150)} - {(n, n) for n in names})
    n, e = nodes_of(spark, names), edges_of(spark, pairs)
    one = {r["name"]: r["score"] for r in G.pagerank(n, e, tolerance=0, rounds=9).collect()}
    joined = {r["name"]: r["score"] for r in G._pagerank_joined(n, e, 60, 0.85, 9, 0).collect()}
    assert set(one) == set(joined) and all(abs(one[k] - joined[k]) < 1e-12 for k in one)


def test_communities_in_order_of_names(spark):
    names = ["a", "b", "c", "d", "e"]
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    label = {n: n for n in names}
    near = {n: [x for p in pairs for x in p if n in p and x != n] for n in names}
    for _ in range(100):
        old = dict(label)
        for n in names:
            votes = [label[x] for x in near[n]]
            label[n] = min(set(votes), key=lambda v: (-votes.count(v), v))
        if old == label:
            break
    assert {r["name"]: r["community"] for r in G.communities(nodes_of(spark, names), edges_of(spark, pairs)).collect()} == label


def test_places_within_groups(spark):
    from corvane.operators.selection import ranked_within

    df = spark.range(200).selectExpr("id", "id % 3 AS g", "(id * 7) % 50 AS v")
    got = {(r["g"], r["id"]): r["place"] for r in ranked_within(df, ["g"], df["v"].desc(), df["id"].asc()).collect()}
    rows = [(r["g"], -r["v"], r["id"]) for r in df.collect()]
    expected = {}
    for g in range(3):
        for k, (_, _, i) in enumerate(sorted(r for r in rows if r[0] == g)):
            expected[(g, i)] = k + 1
    assert got == expected


def test_communities(spark):
    n = nodes_of(spark, ["a", "b", "c", "x", "y", "lonely"])
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")])
    got = {r["name"]: r["community"] for r in G.communities(n, e).collect()}
    assert got["lonely"] == "lonely" and len({got[k] for k in "abc"}) == 1 and got["a"] != got["x"]


def test_call_paths(spark):
    def run(calls):
        return G.call_paths(spark.createDataFrame(calls, "from_module string, from_name string, to_module string, to_name string"), 4).collect()

    assert run([("a", "f1", "b", "f2")]) == []
    two = run([("a", "f1", "b", "f2"), ("b", "f2", "c", "f3")])
    assert [(r["path"], r["n_edges"]) for r in two] == [("a#f1 -> b#f2 -> c#f3", 2)]
    assert run([("a", "f1", "a", "f2"), ("a", "f2", "a", "f3")]) == []


CALL = "from_module string, from_name string, to_module string, to_name string"


def chains(calls, longest):
    """All chains by depth-first search."""
    edges = {(f"{a}#{f}", f"{b}#{g}", a, b) for a, f, b, g in calls}
    called = {b for a, b, _, _ in edges if a != b}
    sources = [e for e in edges if e[0] not in called] or [e for e in edges if e[0] == min(x[0] for x in edges)]
    found = set()

    def walk(path, mods):
        if len(path) > 2 and len(mods) > 1:
            found.add((path[0], " -> ".join(path), len(path) - 1))
        if len(path) <= longest:
            for a, b, m, k in edges:
                if a == path[-1] and b not in path[1:]:
                    walk([*path, b], mods | {m, k})

    for a, b, m, k in sources:
        if a != b:
            walk([a, b], {m, k})
    return found


def test_call_path_queries_against_brute_force(spark, tmp_path):
    from corvane.queries import documents, graphs

    rng = random.Random(7)
    calls = [(f"m{i % 3}", f"f{i}", f"m{(i + 1) % 3}", f"f{i + 1}") for i in range(12)] + [("m0", "f0", "m0", "f0")]
    calls += [(f"m{a % 3}", f"f{a}", f"m{b % 3}", f"f{b}") for a, b in ((rng.randrange(1, 13), rng.randrange(1, 13)) for _ in range(8))]
    ring = [(f"m{i}", "g", f"m{(i + 1) % 4}", "g") for i in range(4)]
    for name, table in (("tree", calls), ("ring", ring)):
        spark.createDataFrame(table, CALL).write.parquet(str(tmp_path / name / "call_edge.parquet"))
        got = [tuple(r) for r in graphs.call_paths(spark, str(tmp_path / name)).collect()]
        assert len(got) == len(set(got)) and set(got) == chains(table, 10)
        assert {r["path"] for r in documents.sequence_diagrams(spark, str(tmp_path / name)).select("path").collect()} == {p for _, p, _ in got}
    assert max(n for _, _, n in chains(calls, 10)) == 10 and max(n for _, _, n in chains(ring, 10)) == 4


def test_global_rank_and_value_at(spark):
    df = spark.range(1000).selectExpr("id", "(id * 37) % 101 AS v")
    got = [(r["rank"], r["v"], r["id"]) for r in global_rank(df, df["v"].desc(), df["id"].asc()).orderBy("rank").collect()]
    rows = sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert got == [(k + 1, v, i) for k, (v, i) in enumerate(rows)]
    values = sorted(v for v, _ in rows)
    for index in (0, 1, 299, 300, 800, 999):
        assert value_at(df, "v", index) == values[index]


def test_neighbourhood_and_induced(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert {tuple(r) for r in G.neighbourhood(e, "b").collect()} == {("a", "b"), ("b", "c")}
    assert {tuple(r) for r in G.induced(e, nodes_of(spark, ["c", "d"])).collect()} == {("c", "d")}
