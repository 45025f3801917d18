"""Queries over the module and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ALONE, BUSINESS, CORE, ENTRY, SUPPORT, UTILITY, directory, module_name
from ..operators import graph as G
from ..session import cut_lineage, global_rank, load, once

NODES_SQL = "nodes AS (SELECT DISTINCT regexp_replace(filename, '\\.[^./]*$', '') AS name FROM file_result WHERE filename IS NOT NULL)"
EDGES_SQL = NODES_SQL + ", g AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst AND src IN (SELECT name FROM nodes) AND dst IN (SELECT name FROM nodes))"
DEGREE_SQL = EDGES_SQL + ", deg AS (SELECT name, coalesce(i.k, 0) AS n_in, coalesce(o.k, 0) AS n_out FROM nodes LEFT JOIN (SELECT dst, count(*) AS k FROM g GROUP BY 1) i ON i.dst = name LEFT JOIN (SELECT src, count(*) AS k FROM g GROUP BY 1) o ON o.src = name)"
ROUNDS = 12
RANK_SQL = "WITH RECURSIVE " + DEGREE_SQL + f""", sz AS (SELECT count(*) AS n FROM nodes),
 pr(i, name, score) AS (SELECT 0, name, 1.0::DOUBLE / n FROM nodes, sz UNION ALL
  SELECT p.i + 1, p.name, 0.15::DOUBLE / any_value(sz.n) + 0.85 * coalesce(sum(q.score / deg.n_out), 0)
  FROM pr p CROSS JOIN sz LEFT JOIN g ON g.dst = p.name LEFT JOIN pr q ON q.name = g.src LEFT JOIN deg ON deg.name = g.src WHERE p.i < {ROUNDS} GROUP BY p.i, p.name),
 rank AS (SELECT name, score, n_in, n_out FROM pr JOIN deg USING (name) WHERE i = {ROUNDS})"""
ROLE_SQL = RANK_SQL + f""", cut AS (SELECT list_sort(list(score))[floor(count(*) * 0.8)::INT + 1] AS hi, list_sort(list(score))[floor(count(*) * 0.3)::INT + 1] AS lo FROM rank),
 role AS (SELECT name, score, n_in, n_out, CASE WHEN n_in = 0 AND n_out > 0 THEN '{ENTRY}' WHEN score >= hi - 1e-15 AND n_in >= 2 THEN '{CORE}' WHEN n_out >= 2 AND n_in = 0 AND score <= lo THEN '{UTILITY}'
  WHEN n_in = 0 AND n_out = 0 THEN '{ALONE}' WHEN n_in >= 1 AND n_out >= 1 THEN '{BUSINESS}' ELSE '{SUPPORT}' END AS role FROM rank, cut)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "file_result").where("filename is not null").select(module_name(F.col("filename")).alias("name")).distinct()


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = cut_lineage(nodes(spark, d))
    return n, cut_lineage(G.clean_edges(load(spark, d, "edge"), n))


def graph_edges(spark, d):
    return _graph(spark, d)[1]


def import_links(spark, d):
    """Edges from the symbol tables themselves, resolved by name, suffix and folder."""
    files = once(load(spark, d, "file_result").where("file_id is not null and filename is not null"), "file_id", "scanned_at")
    imports = files.select(module_name(F.col("filename")).alias("src"), F.inline("imports")).select("src", "module", "is_relative")
    return G.resolve_imports(imports, files.select(module_name(F.col("filename")).alias("name")))


def degrees(spark, d):
    return G.degrees(*_graph(spark, d))


def entry_points(spark, d):
    return G.entry_points(*_graph(spark, d))


def dependencies(spark, d):
    _, e = _graph(spark, d)
    out = e.groupBy(F.col("src").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("depends_on"))
    return out


def coarsen(spark, d):
    return G.coarsened(_graph(spark, d)[1])


def subgraph_dir(spark, d):
    n, e = _graph(spark, d)
    return G.induced(e, n.where(F.col("name").startswith("meridian-monolith/")))


def neighbor_subgraph(spark, d):
    n, e = _graph(spark, d)
    hub = e.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).collect()
    return G.neighbourhood(e, hub[0]["dst"] if hub else "")


def dir_groups(spark, d):
    return nodes(spark, d).groupBy(directory(F.col("name")).alias("dir")).agg(F.count("*").alias("modules"), F.min("name").alias("first_module"))


def _ranked(spark, d):
    n, e = _graph(spark, d)
    return n, e, G.pagerank(n, e, rounds=ROUNDS, tolerance=0)


def pagerank_fixed(spark, d):
    return _ranked(spark, d)[2].select("name", F.round("score", 10).alias("score"))


def pagerank_converged(spark, d):
    return G.pagerank(*_graph(spark, d), tolerance=1e-9).select("name", F.round("score", 5).alias("score"))


def _roles(spark, d):
    return cut_lineage(G.roles(*_ranked(spark, d)))


def module_roles(spark, d):
    return _roles(spark, d).select("name", "role", F.round("score", 10).alias("score"))


def role_edges(spark, d):
    r = _roles(spark, d).select("name", "role")
    e = _graph(spark, d)[1]
    e = e.join(r.toDF("src", "from_role"), "src").join(r.toDF("dst", "to_role"), "dst")
    return e.groupBy("from_role", "to_role").agg(F.count("*").alias("edges"))


def module_importance(spark, d):
    """Dependents, entry points and symbols, added up; ranked over all modules."""
    symbols = load(spark, d, "file_result").where("filename is not null").groupBy(module_name(F.col("filename")).alias("name")).agg(F.max(F.coalesce(F.size("classes"), F.lit(0)) + F.coalesce(F.size("functions"), F.lit(0))).alias("k"))
    scored = degrees(spark, d).join(symbols, "name").select("name", (F.col("n_in") * 10 + F.when((F.col("n_in") == 0) & (F.col("n_out") > 0), 50).otherwise(0) + F.when(F.col("k") > 0, 5).otherwise(0)).alias("importance"))
    return global_rank(scored, F.desc("importance"), F.asc("name"))


def top_modules(spark, d):
    return G.top_modules(_roles(spark, d)).select("name", "role", "value")


def module_difficulty(spark, d):
    """Score from rank, dependents, code size and dependencies; the last quarter is easy, the first hard."""
    size = load(spark, d, "file_result").where("filename is not null").groupBy(module_name(F.col("filename")).alias("name")).agg(F.max(F.coalesce(F.size("classes"), F.lit(0)) + F.coalesce(F.size("functions"), F.lit(0))).alias("k"))
    scored = _roles(spark, d).join(size, "name").select("name", F.round(50 * F.round("score", 8) + 8 * F.col("n_in") + 2 * F.col("k") + F.col("n_out"), 7).alias("difficulty"))
    placed = G.shares_of_rank(scored, F.desc("difficulty"), "name")
    return placed.select("name", "difficulty", F.when(F.col("share") < 0.25, "hard").when(F.col("share") < 0.75, "medium").otherwise("easy").alias("level"))


def architecture_pattern(spark, d):
    n, e, s = _ranked(spark, d)
    r = G.roles(n, e, s)
    # Exact for cycles of any length: what is left after peeling off nodes without edges in or out.
    looped = G.cycle_edges(e).limit(1).agg(F.count("*").alias("cyclic"))
    facts = r.agg(F.countDistinct("role").alias("roles"), F.max("score").alias("top"), F.count("*").alias("modules")).crossJoin(looped)
    pattern = F.when((F.col("roles") > 1) & (F.col("cyclic") == 0), "layered").when((F.col("top") > 0.4) & (F.col("modules") > 2), "hub").when((F.col("cyclic") == 0) & (F.col("modules") > 2), "pipeline").when(F.col("cyclic") > 0, "coupled").otherwise("simple")
    return facts.select(pattern.alias("pattern"), F.col("roles").cast("long").alias("roles"), "modules")


def communities(spark, d):
    return G.communities(*_graph(spark, d))


def communities_sync(spark, d):
    return G.communities_at_once(*_graph(spark, d), rounds=3)


def cycles(spark, d):
    """Cycles of up to three top folders in their calls."""
    e = G.coarsened(load(spark, d, "call_edge").select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")))
    return G.cycles(e, 3).select(F.array_join("nodes", ">").alias("cycle"), F.col("size").cast("long").alias("size"))


def call_paths(spark, d):
    return G.call_paths(load(spark, d, "call_edge"), 10).withColumn("n_edges", F.col("n_edges").cast("long"))


def call_targets(spark, d):
    """The definition that each called name means: in the same module, else the first by file and line."""
    files = once(load(spark, d, "file_result").where("file_id is not null and filename is not null"), "file_id", "scanned_at")
    named = files.select(module_name(F.col("filename")).alias("module"), F.inline("functions")).select("module", F.col("name").alias("to_name"), "start_line")
    calls = load(spark, d, "call_edge").select("from_module", "from_name", "to_module", "to_name").distinct()
    both = calls.join(named, "to_name").withColumn("near", F.when(F.col("module") == F.col("to_module"), 0).when(F.col("module") == F.col("from_module"), 1).otherwise(2))
    best = G.window_first(both, ["from_module", "from_name", "to_module", "to_name"], F.asc("near"), F.asc("module"), F.asc("start_line"))
    return best.select("from_module", "from_name", "to_name", F.col("module").alias("target_module"), F.col("start_line").cast("long").alias("target_line"))


def mermaid_dependency(spark, d):
    """One line of diagram text per folder, node and edge, with its place."""
    from ..operators.render import dependency_lines

    return dependency_lines(*_graph(spark, d))


QUERIES = {f.__name__: f for f in (graph_edges, import_links, degrees, entry_points, dependencies, coarsen, subgraph_dir, neighbor_subgraph, dir_groups, pagerank_fixed, pagerank_converged, module_roles, role_edges, module_importance, top_modules, module_difficulty, architecture_pattern, communities, communities_sync, cycles, call_paths, call_targets, mermaid_dependency)}

LATEST = "fr AS (SELECT * FROM file_result WHERE file_id IS NOT NULL AND filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) = 1)"
SIZE_SQL = "size AS (SELECT regexp_replace(filename, '\\.[^./]*$', '') AS name, max(coalesce(len(classes), 0) + coalesce(len(functions), 0)) AS k FROM file_result WHERE filename IS NOT NULL GROUP BY 1)"
CYCLE_SQL = """, walk(p, last) AS (SELECT [src, dst], dst FROM g WHERE dst > src UNION ALL SELECT list_append(p, dst), dst FROM walk JOIN g ON g.src = last WHERE len(p) < 4 AND dst > p[1] AND NOT list_contains(p, dst)),
 cyc AS (SELECT p FROM walk JOIN g ON g.src = last AND g.dst = p[1])"""
SQL = {
    "import_links": f"""WITH {LATEST}, names AS (SELECT DISTINCT regexp_replace(filename, '\\.[^./]*$', '') AS name FROM fr),
      i AS (SELECT regexp_replace(filename, '\\.[^./]*$', '') AS src, unnest(imports) AS i FROM fr),
      j AS (SELECT DISTINCT src, i.module AS module, coalesce(i.is_relative, FALSE) AS rel, CASE WHEN contains(src, '/') THEN regexp_replace(src, '/[^/]*$', '') ELSE '' END AS folder FROM i WHERE coalesce(i.module, '') <> ''),
      k AS (SELECT *, length(regexp_extract(module, '^(\\.*)', 1)) AS dots, regexp_replace(module, '^\\.+/?', '') AS rest, string_split(folder, '/') AS up FROM j),
      l AS (SELECT src, module, rel, folder, CASE WHEN rel OR starts_with(module, '.') THEN array_to_string(list_filter(list_append(up[1:greatest(0, len(up) - greatest(0, dots - 1))], CASE WHEN contains(rest, '/') THEN regexp_replace(rest, '\\.[^./]*$', '') ELSE replace(rest, '.', '/') END), lambda x: x <> ''), '/')
        WHEN contains(module, '/') THEN module ELSE replace(module, '.', '/') END AS target FROM k),
      direct AS (SELECT src, module, target AS dst FROM l WHERE target IN (SELECT name FROM names)),
      open_ones AS (SELECT * FROM l WHERE NOT rel AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.src = l.src AND d.module = l.module)),
      keys AS (SELECT key, min(name) AS dst FROM (SELECT name, name AS key FROM names UNION ALL SELECT name, regexp_replace(name, '/[^/]*$', '') FROM names WHERE contains(name, '/')) GROUP BY 1),
      parts AS (SELECT src, module, string_split(target, '/') AS p FROM open_ones), ends AS (SELECT src, module, unnest(range(1, len(p) + 1)) AS n, p FROM parts),
      suffix AS (SELECT src, module, arg_min(dst, n) AS dst FROM ends JOIN keys ON key = array_to_string(p[n:], '/') GROUP BY 1, 2),
      near AS (SELECT o.src, o.module, CASE WHEN folder = '' THEN target ELSE folder || '/' || target END AS dst FROM open_ones o WHERE NOT EXISTS (SELECT 1 FROM suffix s WHERE s.src = o.src AND s.module = o.module)),
      every AS (SELECT src, dst FROM direct UNION ALL SELECT src, dst FROM suffix UNION ALL SELECT src, dst FROM near WHERE dst IN (SELECT name FROM names))
      SELECT DISTINCT src, dst FROM every WHERE src <> dst""",
    "graph_edges": f"WITH {EDGES_SQL} SELECT src, dst FROM g",
    "degrees": f"WITH {DEGREE_SQL} SELECT * FROM deg",
    "entry_points": f"WITH {DEGREE_SQL} SELECT name FROM deg WHERE n_in = 0 AND n_out > 0",
    "dependencies": f"WITH {EDGES_SQL} SELECT src AS name, string_agg(dst, ',' ORDER BY dst) AS depends_on FROM g GROUP BY 1",
    "coarsen": f"WITH {EDGES_SQL} SELECT DISTINCT split_part(src, '/', 1) AS src, split_part(dst, '/', 1) AS dst FROM g WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)",
    "subgraph_dir": f"WITH {EDGES_SQL} SELECT src, dst FROM g WHERE starts_with(src, 'meridian-monolith/') AND starts_with(dst, 'meridian-monolith/')",
    "neighbor_subgraph": f"WITH {EDGES_SQL}, hub AS (SELECT dst AS h FROM g GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), near AS (SELECT h FROM hub UNION SELECT src FROM g, hub WHERE dst = h UNION SELECT dst FROM g, hub WHERE src = h) SELECT src, dst FROM g WHERE src IN (SELECT h FROM near) AND dst IN (SELECT h FROM near)",
    "dir_groups": f"WITH {NODES_SQL} SELECT CASE WHEN contains(name, '/') THEN regexp_replace(name, '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS modules, min(name) AS first_module FROM nodes GROUP BY 1",
    "pagerank_fixed": RANK_SQL + " SELECT name, round(score, 10) AS score FROM rank",
    "module_roles": ROLE_SQL + " SELECT name, role, round(score, 10) AS score FROM role",
    "role_edges": ROLE_SQL + " SELECT a.role AS from_role, b.role AS to_role, count(*) AS edges FROM g JOIN role a ON a.name = src JOIN role b ON b.name = dst GROUP BY 1, 2",
    "module_importance": f"WITH {DEGREE_SQL}, {SIZE_SQL}, s AS (SELECT name, n_in * 10 + CASE WHEN n_in = 0 AND n_out > 0 THEN 50 ELSE 0 END + CASE WHEN k > 0 THEN 5 ELSE 0 END AS importance FROM deg JOIN size USING (name)) SELECT name, importance, row_number() OVER (ORDER BY importance DESC, name) AS rank FROM s",
    "top_modules": ROLE_SQL + f""", b AS (SELECT min(score) AS a, max(score) AS z, min(n_in) AS c, max(n_in) AS e, count(*) AS n FROM role),
     v AS (SELECT name, role, n, round(0.5 * CASE WHEN z > a THEN (score - a) / (z - a) ELSE 0 END + 0.3 * CASE WHEN e > c THEN (n_in - c)::DOUBLE / (e - c) ELSE 0 END + 0.2 * CASE role WHEN '{ENTRY}' THEN 1.0 WHEN '{CORE}' THEN 1.0 WHEN '{BUSINESS}' THEN 0.6 WHEN '{UTILITY}' THEN 0.3 WHEN '{SUPPORT}' THEN 0.3 ELSE 0.1 END, 9) AS value FROM role, b)
     SELECT name, role, value FROM v QUALIFY row_number() OVER (ORDER BY role IN ('{ENTRY}', '{CORE}') DESC, value DESC, name) <= CASE WHEN n <= 30 THEN n WHEN n <= 80 THEN floor(n * 0.7) ELSE floor(n * 0.5) END""",
    "module_difficulty": ROLE_SQL + f", {SIZE_SQL}, s AS (SELECT name, round(50 * round(score, 8) + 8 * n_in + 2 * k + n_out, 7) AS difficulty FROM role JOIN size USING (name)), p AS (SELECT *, (row_number() OVER (ORDER BY difficulty DESC, name) - 1) / (SELECT count(*) FROM s) AS share FROM s) SELECT name, difficulty, CASE WHEN share < 0.25 THEN 'hard' WHEN share < 0.75 THEN 'medium' ELSE 'easy' END AS level FROM p",
    "architecture_pattern": ROLE_SQL + CYCLE_SQL + ", f AS (SELECT count(DISTINCT role) AS roles, max(score) AS top, count(*) AS modules, (SELECT count(*) FROM (SELECT 1 FROM cyc LIMIT 1)) AS cyclic FROM role) SELECT CASE WHEN roles > 1 AND cyclic = 0 THEN 'layered' WHEN top > 0.4 AND modules > 2 THEN 'hub' WHEN cyclic = 0 AND modules > 2 THEN 'pipeline' WHEN cyclic > 0 THEN 'coupled' ELSE 'simple' END AS pattern, roles, modules FROM f",
    "cycles": """WITH RECURSIVE g AS (SELECT DISTINCT split_part(from_module, '/', 1) AS src, split_part(to_module, '/', 1) AS dst FROM call_edge WHERE split_part(from_module, '/', 1) <> split_part(to_module, '/', 1)),
      walk(p, last) AS (SELECT [src, dst], dst FROM g WHERE dst > src UNION ALL SELECT list_append(p, dst), dst FROM walk JOIN g ON g.src = last WHERE len(p) < 3 AND dst > p[1] AND NOT list_contains(p, dst))
      SELECT list_aggregate(p, 'string_agg', '>') AS cycle, len(p) AS size FROM walk JOIN g ON g.src = last AND g.dst = p[1]""",
    "communities_sync": f"""WITH RECURSIVE {EDGES_SQL}, near AS (SELECT src AS name, dst AS near FROM g UNION ALL SELECT dst, src FROM g),
      l(i, name, label) AS (SELECT 0, name, name FROM nodes UNION ALL SELECT l.i + 1, l.name, coalesce(b.label, l.label) FROM l LEFT JOIN (
        SELECT i, name, label FROM (SELECT o.i AS i, near.name AS name, o.label AS label, count(*) AS k FROM near JOIN l o ON o.name = near.near GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY i, name ORDER BY k DESC, label) = 1) b ON b.name = l.name AND b.i = l.i WHERE l.i < 3)
      SELECT name, label AS community FROM l WHERE i = 3""",
    "pagerank_converged": RANK_SQL.replace(f"p.i < {ROUNDS}", "p.i < 60").replace(f"i = {ROUNDS}", "i = 60") + " SELECT name, round(score, 5) AS score FROM rank",
    "call_paths": """WITH RECURSIVE e AS (SELECT DISTINCT from_module || '#' || from_name AS a, to_module || '#' || to_name AS b, from_module AS ma, to_module AS mb FROM call_edge),
      heads AS (SELECT * FROM e WHERE a <> b AND a NOT IN (SELECT b FROM e WHERE a <> b)),
      walk(p, m, n) AS (SELECT [a, b], [ma, mb], 1 FROM heads UNION ALL SELECT list_append(p, b), list_append(m, mb), n + 1 FROM walk JOIN e ON e.a = p[-1] WHERE n < 10 AND NOT list_contains(p[2:], b))
      SELECT p[1] AS start, list_aggregate(p, 'string_agg', ' -> ') AS path, n::BIGINT AS n_edges FROM walk WHERE n >= 2 AND len(list_distinct(m)) >= 2""",
    "call_targets": f"""WITH {LATEST}, fn AS (SELECT regexp_replace(filename, '\\.[^./]*$', '') AS module, unnest(functions) AS f FROM fr),
      c AS (SELECT DISTINCT from_module, from_name, to_module, to_name FROM call_edge)
      SELECT from_module, from_name, to_name, module AS target_module, f.start_line::BIGINT AS target_line FROM c JOIN fn ON f.name = to_name
      QUALIFY row_number() OVER (PARTITION BY from_module, from_name, to_module, to_name ORDER BY CASE WHEN module = to_module THEN 0 WHEN module = from_module THEN 1 ELSE 2 END, module, f.start_line) = 1""",
    "mermaid_dependency": f"""WITH {EDGES_SQL}, l AS (SELECT 0 AS part, '' AS k, 'graph LR' AS line UNION ALL SELECT 1, name, '    ' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') || '["' || name || '"]' FROM nodes
      UNION ALL SELECT 2, src || ' ' || dst, '    ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') FROM g) SELECT row_number() OVER (ORDER BY part, k) AS line_no, line FROM l""",
}
