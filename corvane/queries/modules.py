"""Queries that choose and draw modules, classes and functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import is_noise, module_name, top_directory
from ..operators import diagrams as D
from ..operators import graph as G
from ..operators import selection as S
from ..operators.symbols import definitions, latest_files
from ..session import cut_lineage, load
from .graphs import DEGREE_SQL, EDGES_SQL, LATEST, RANK_SQL, ROLE_SQL, _graph, _ranked, _roles, degrees, nodes

REPO = "meridian-monolith"


def _files(spark, d):
    return latest_files(load(spark, d, "file_result")).withColumn("module", module_name(F.col("filename")))


def dependents(spark, d):
    """Who imports a module, one row for each of them with its place."""
    return S.ranked_within(_graph(spark, d)[1].select(F.col("dst").alias("name"), "src"), ["name"], F.asc("src")).select("name", "src", "place")


def node_lookup(spark, d):
    """Modules named in documents between backquotes, and whether there is such a node."""
    quoted = load(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`([^`\n]+)`"), 1))).alias("name")).groupBy("name").agg(F.count("*").alias("uses"))
    return quoted.join(nodes(spark, d).withColumn("found", F.lit(True)), "name", "left").select("name", "uses", F.coalesce("found", F.lit(False)).alias("found"))


def edge_exists(spark, d):
    """Which call relations between modules are imports too."""
    pairs = load(spark, d, "call_edge").select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")).where("src <> dst").distinct()
    return pairs.join(_graph(spark, d)[1].withColumn("imported", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("imported", F.lit(False)).alias("imported"))


def role_members(spark, d):
    """The modules of every role, in order."""
    return S.ranked_within(_roles(spark, d).select("role", "name"), ["role"], F.asc("name")).select("role", "place", "name")


def role_leaders(spark, d):
    """The three most dependent-on modules of every role."""
    return S.ranked_within(_roles(spark, d).select("role", "name", "n_in"), ["role"], F.desc("n_in"), F.asc("name")).where("place <= 3").select("role", "name", "place")


def module_themes(spark, d):
    n = nodes(spark, d).where(~is_noise(F.col("name")))
    return n.select("name", L.theme(F.col("name")).alias("theme"))


def action_labels(spark, d):
    names = definitions(_files(spark, d)).where("kind <> 'class'").select("name").distinct()
    return names.select("name", L.action(F.col("name")).alias("action"))


def parameter_lists(spark, d):
    """Signatures without the receiver."""
    f = definitions(_files(spark, d)).where("kind <> 'class'")
    return f.select("file_id", "name", "start_line", F.array_join(L.without_self(F.col("params")), ", ").alias("params"))


def path_labels(spark, d):
    """Of every file: media type, highlighting name, main extension of its language, safe name."""
    f = _files(spark, d).select("filename", F.lower(F.regexp_extract("filename", r"\.([^./]*)$", 1)).alias("ext"))
    tag = L.looked_up(L.HIGHLIGHT, F.col("ext"))
    return f.select("filename", L.looked_up(L.MEDIA, F.col("ext"), "application/octet-stream").alias("media"), tag.alias("highlight"), L.looked_up(L.MAIN_EXTENSION, tag).alias("main_extension"), F.translate("filename", "/\\ :", "____").alias("safe_name"))


def folder_clusters(spark, d):
    f = _files(spark, d).where(~is_noise(F.col("module")))
    return S.folder_clusters(f.select("filename"))


def cluster_samples(spark, d):
    """Five modules and three extensions of each top folder."""
    f = _files(spark, d).select(top_directory(F.col("filename")).alias("dir"), "module", F.regexp_extract("filename", r"\.([^./]*)$", 1).alias("ext"))
    e = f.groupBy("dir", "ext").agg(F.count("*").alias("k")).withColumn("n", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("k"), "ext"))).where("n <= 3")
    e = e.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ext", "k"))), lambda x: F.concat(x["ext"], F.lit("("), x["k"].cast("string"), F.lit(")"))), ",").alias("extensions"))
    s = S.ranked_within(f.select("dir", "module").distinct(), ["dir"], F.asc("module")).where("place <= 5")
    s = s.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "module"))), lambda x: x["module"]), ",").alias("samples"))
    return e.join(s, "dir")


def nearest_folder(spark, d):
    """For every small top folder of modules the large one whose name shares most parts with it."""
    pairs = _graph(spark, d)[1].select(top_directory(F.col("src")).alias("source"), top_directory(F.col("dst")).alias("target")).where("source <> target").distinct()
    return pairs.select("source", "target", S.keyword_overlap(F.col("source"), F.col("target")).cast("long").alias("overlap"))


def core_modules(spark, d):
    k = _files(spark, d).groupBy(F.col("module").alias("name")).agg(F.max(F.coalesce(F.size("classes"), F.lit(0))).cast("long").alias("classes"))
    return S.core_modules(degrees(spark, d).join(k, "name"))


def core_classes(spark, d):
    c = _files(spark, d).select("module", F.explode("classes").alias("c")).select("module", F.col("c.name").alias("name"))
    return S.core_classes(c, _ranked(spark, d)[2].select(F.col("name").alias("module"), "score"), 20)


def _snippets(spark, d):
    f = _files(spark, d)
    return S.snippet_span(definitions(f)).where("kind <> 'method'").join(f.select("file_id", "filename", "module"), "file_id")


def key_snippets(spark, d):
    """The fifty definitions of the highest ranked modules, classes before functions."""
    facts = _roles(spark, d).select(F.col("name").alias("module"), (F.round("score", 10) * 10 + F.col("n_in")).alias("base"))
    scored = _snippets(spark, d).join(facts, "module").withColumn("score", F.round(F.col("base") + F.when(F.col("kind") == "class", 5).otherwise(0), 8))
    return scored.orderBy(F.desc("score"), "filename", "start_line", "name").limit(50).select("filename", "name", "start_line", "end_line", "score")


def module_snippets(spark, d):
    """Up to three snippets of each file: functions before classes, in order of their lines."""
    s = _snippets(spark, d).select("filename", "kind", "name", "start_line", "end_line").withColumn("second", (F.col("kind") == "class").cast("int"))
    return S.ranked_within(s, ["filename"], F.asc("second"), F.asc("start_line"), F.asc("name")).where("place <= 3").select("filename", "name", "start_line", "end_line", "place")


def top_functions(spark, d):
    f = _files(spark, d)
    functions = f.select("module", F.explode("functions").alias("f")).select("module", F.col("f.name").alias("name"))
    methods = f.select("module", F.explode("classes").alias("c")).select("module", F.col("c.name").alias("owner"), F.explode("c.methods").alias("m")).select("module", F.concat_ws(".", "owner", "m.name").alias("name"))
    return S.top_functions(functions.unionByName(methods), load(spark, d, "call_edge")).select("module", "name", F.col("layer").cast("long").alias("layer"), "place")


def source_footer(spark, d):
    """The ten highest ranked modules with the line of their first definition."""
    f = _files(spark, d).select(F.col("module").alias("name"), "filename", F.coalesce(F.get("functions", F.lit(0))["start_line"], F.get("classes", F.lit(0))["start_line"]).cast("string").alias("line"))
    top = f.join(_ranked(spark, d)[2].select("name", F.round("score", 10).alias("score")), "name").orderBy(F.desc("score"), "name", "filename").limit(10)
    return top.select("name", F.concat(F.lit("`"), "filename", F.coalesce(F.concat(F.lit(":"), "line"), F.lit("")), F.lit("`（"), "name", F.lit("）")).alias("reference"))


def architecture_diagram(spark, d):
    e = _graph(spark, d)[1]
    return D.architecture(_roles(spark, d).select("name", "role"), e, G.cycle_edges(e))


def top_level_diagram(spark, d):
    n, e = _graph(spark, d)
    tops = n.groupBy(top_directory(F.col("name")).alias("name")).agg(F.sum(F.col("name").contains("/").cast("long")).alias("modules"))
    return D.top_level(tops, G.coarsened(e))


def layered_diagram(spark, d):
    return D.layered(_roles(spark, d).select("name", "role"), _graph(spark, d)[1])


def _classes(spark, d, files):
    c = files.select("module", F.explode("classes").alias("c")).select("module", F.col("c.name").alias("name"), F.col("c.methods").alias("methods"), F.col("c.bases").alias("bases"), F.coalesce(F.size("c.methods"), F.lit(0)).alias("k"))
    found = c.groupBy("name").agg(F.min_by(F.struct("module", "methods"), F.struct(-F.col("k"), "module")).alias("x")).select("name", "x.module", "x.methods")
    bases = c.where("size(bases) > 0").groupBy("name").agg(F.max_by("bases", F.struct("module", "bases")).alias("bases")).select("name", F.explode("bases").alias("base")).distinct()
    return D.classes(found, bases)


def class_diagram(spark, d):
    return _classes(spark, d, _files(spark, d))


def sub_diagram(spark, d):
    """The modules below one folder and the edges among them."""
    n, e = _graph(spark, d)
    inside = F.col("name").startswith(REPO + "/") | (F.col("name") == REPO)
    names = cut_lineage(n.where(inside))
    roles = _roles(spark, d).select("name", "role").join(names, "name", "left_semi")
    sub = cut_lineage(G.induced(e, names))
    return D.architecture(roles, sub, G.cycle_edges(sub))


def sub_class_diagram(spark, d):
    return _classes(spark, d, _files(spark, d).where(F.col("module").startswith(REPO + "/")))


def directory_classes(spark, d):
    """Classes below a folder."""
    return _files(spark, d).where(F.col("module").startswith(REPO + "/")).select("module", F.explode("classes").alias("c")).select("module", F.col("c.name").alias("name"))


def cyclic_edges(spark, d):
    """Calls between top folders that lie on a cycle, whatever its length."""
    e = G.coarsened(load(spark, d, "call_edge").select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")))
    return G.cycle_edges(e)


def sequence_messages(spark, d):
    """Messages of the call chains: a return is marked, a repetition of the one before left out."""
    from ..operators.render import messages

    return messages(G.call_paths(load(spark, d, "call_edge"), 3))


def sequence_summaries(spark, d):
    """Title and description of the call chains."""
    from ..operators.render import summaries

    return summaries(G.call_paths(load(spark, d, "call_edge"), 3))


QUERIES = {f.__name__: f for f in (dependents, node_lookup, edge_exists, role_members, role_leaders, module_themes, action_labels, parameter_lists, path_labels, folder_clusters, cluster_samples, nearest_folder, core_modules, core_classes, key_snippets, module_snippets, top_functions, source_footer, architecture_diagram, top_level_diagram, layered_diagram, class_diagram, sub_diagram, sub_class_diagram, directory_classes, cyclic_edges, sequence_messages, sequence_summaries)}

NOISE = "(ends_with({n}, '_test') OR (contains({n}, 'testdata') AND NOT contains({n}, 'testdata/repos/')) OR contains({n}, 'scripts/debug'))"
FILES = LATEST + ", f AS (SELECT *, regexp_replace(filename, '\\.[^./]*$', '') AS module FROM fr)"
CL = FILES + ", cl AS (SELECT file_id, filename, module, unnest(classes) AS c FROM f), fn AS (SELECT file_id, filename, module, unnest(functions) AS f FROM f)"
DEF2 = CL + ", me AS (SELECT file_id, filename, module, c.name AS owner, unnest(c.methods) AS f FROM cl), named AS (SELECT file_id, f.name AS name, f.params AS params, f.start_line AS start_line FROM fn UNION ALL SELECT file_id, f.name, f.params, f.start_line FROM me)"
LOOK = lambda table, key, other: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"
WORDS = "list_filter(regexp_split_to_array({c}, '[/\\\\_\\- ]+'), lambda p: strlen(p) >= 2)"
ESC = "translate({n}, ' -:/<>,.', '________')"
SHORT = "regexp_extract({n}, '([^/]*)$', 1)"
SNIP = CL + ", sn AS (SELECT filename, module, 'class' AS kind, c.name AS name, c.start_line::BIGINT AS b, c.end_line::BIGINT AS e FROM cl UNION ALL SELECT filename, module, 'function', f.name, f.start_line, f.end_line FROM fn), snip AS (SELECT filename, module, kind, name, b AS start_line, CASE WHEN coalesce(e, 0) > b THEN e ELSE b + CASE kind WHEN 'class' THEN 30 ELSE 20 END END AS end_line FROM sn WHERE b > 0)"
STYLE_ROWS = ", ".join(f"('{r}', '{i}', '{c}', '{s}', '{t}')" for i, (r, c, s, t) in enumerate(D.STYLES))
FIXED = lambda part, *texts: " UNION ALL ".join(f"SELECT {part} AS part, '{i:03}' AS a, '' AS b, '' AS c, '{t}' AS line" for i, t in enumerate(texts))
ARCH = """, st(role, i, style, css, text) AS (VALUES """ + STYLE_ROWS + f"""), used AS (SELECT * FROM st WHERE role IN (SELECT role FROM r)),
 p AS (SELECT name, role, CASE WHEN contains(name, '/') THEN regexp_replace(name, '/[^/]*$', '') ELSE '.' END AS dir, {ESC.format(n='name')} || '[' || {SHORT.format(n='name')} || '<br/>' || role || ']' AS node FROM r),
 l AS ({FIXED(0, '%% 架构图：展示项目模块间的依赖关系与层级结构', 'graph TD')}
  UNION ALL SELECT 1, dir, '0', '', '    subgraph ' || {ESC.format(n='dir')} FROM (SELECT DISTINCT dir FROM p WHERE dir <> '.') UNION ALL SELECT 1, dir, '1', name, '        ' || node FROM p WHERE dir <> '.' UNION ALL SELECT 1, dir, '2', '', '    end' FROM (SELECT DISTINCT dir FROM p WHERE dir <> '.')
  UNION ALL SELECT 2, name, '', '', '    ' || node FROM p WHERE dir = '.' UNION ALL SELECT 3, name, '', '', '    click ' || {ESC.format(n='name')} || ' "javascript:navigateToModule(''' || name || ''')"' FROM p
  UNION ALL {FIXED(4, '    %% 节点角色标注：按模块职责着色')} UNION ALL SELECT 5, i, '', '', '    classDef ' || style || ' ' || css FROM used
  UNION ALL SELECT 6, {ESC.format(n='name')}, '', '', '    class ' || {ESC.format(n='name')} || ' ' || style FROM p JOIN st USING (role) UNION ALL {FIXED(7, '    subgraph 图例')}
  UNION ALL SELECT 8, i, '0', '', '        legend_' || style || '[' || text || ']:::legend' FROM used UNION ALL SELECT 8, i, '1', '', '        class legend_' || style || ' ' || style FROM used UNION ALL {FIXED(9, '    end')}
  UNION ALL SELECT 10, src, dst, '', '    ' || {ESC.format(n='src')} || ' --> ' || {ESC.format(n='dst')} FROM ge)
 SELECT row_number() OVER (ORDER BY part, a, b, c) AS line_no, line FROM l"""
CLASS = """, c1 AS (SELECT module, c.name AS name, c.methods AS methods, c.bases AS bases, coalesce(len(c.methods), 0) AS k FROM cl {where}), c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC, module) = 1),
 c3 AS (SELECT name, arg_max(bases, (module, bases)) AS bases FROM c1 WHERE len(bases) > 0 GROUP BY 1), c4 AS (SELECT DISTINCT name, unnest(bases) AS base FROM c3), m AS (SELECT name, unnest(range(1, len(methods) + 1)) AS i, methods FROM c2),
 l AS (""" + FIXED(0, "%% 类图：展示项目中类的定义、属性及继承/实现关系", "classDiagram") + """ UNION ALL SELECT 1, name, '0', '', '    %% ' || name || ' 来自 ' || module || ' 模块' FROM c2 UNION ALL SELECT 1, name, '1', '', '    class ' || translate(name, ' -:/<>,.', '________') || ' {{' FROM c2
  UNION ALL SELECT 1, name, '2', lpad((i - 1)::VARCHAR, 6, '0'), '        +' || methods[i].name || '(' || array_to_string(list_filter(coalesce(methods[i].params, []), lambda p: p NOT IN ('self', 'cls')), ', ') || ')' || CASE WHEN coalesce(methods[i].return_type, '') <> '' THEN ' ' || methods[i].return_type ELSE '' END FROM m
  UNION ALL SELECT 1, name, '3', '', '    }}' FROM c2 UNION ALL SELECT 2, name, base, '', '    ' || translate(name, ' -:/<>,.', '________') || ' --|> ' || translate(base, ' -:/<>,.', '________') FROM c4)
 SELECT row_number() OVER (ORDER BY part, a, b, c) AS line_no, line FROM l"""
PATHS = """WITH RECURSIVE e AS (SELECT DISTINCT from_module || '#' || from_name AS a, to_module || '#' || to_name AS b, from_module AS ma, to_module AS mb FROM call_edge),
 heads AS (SELECT * FROM e WHERE a <> b AND a NOT IN (SELECT b FROM e WHERE a <> b)),
 walk(p, m, n) AS (SELECT [a, b], [ma, mb], 1 FROM heads UNION ALL SELECT list_append(p, b), list_append(m, mb), n + 1 FROM walk JOIN e ON e.a = p[-1] WHERE n < 3 AND NOT list_contains(p[2:], b)),
 paths AS (SELECT list_aggregate(p, 'string_agg', ' -> ') AS path, p, m, n FROM walk WHERE n >= 2 AND len(list_distinct(m)) >= 2)"""
ACTION = L.rules_sql(L.ACTIONS, "starts_with({n}, '{w}')", "{n} || ' 操作'")
SQL = {
    "dependents": f"WITH {EDGES_SQL} SELECT dst AS name, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS place FROM g",
    "node_lookup": f"WITH {EDGES_SQL}, q AS (SELECT unnest(list_distinct(regexp_extract_all(text, '`([^`\\n]+)`', 1))) AS name FROM documents) SELECT name, count(*) AS uses, name IN (SELECT name FROM nodes) AS found FROM q GROUP BY 1",
    "edge_exists": f"WITH {EDGES_SQL} SELECT DISTINCT from_module AS src, to_module AS dst, (from_module, to_module) IN (SELECT (src, dst) FROM g) AS imported FROM call_edge WHERE from_module <> to_module",
    "role_members": ROLE_SQL + " SELECT role, row_number() OVER (PARTITION BY role ORDER BY name) AS place, name FROM role",
    "role_leaders": ROLE_SQL + " SELECT role, name, row_number() OVER (PARTITION BY role ORDER BY n_in DESC, name) AS place FROM role QUALIFY place <= 3",
    "module_themes": f"WITH {EDGES_SQL} SELECT name, {L.rules_sql(L.THEMES, "contains(lower(name), '{w}')", "'" + L.OTHER_THEME + "'")} AS theme FROM nodes WHERE NOT {NOISE.format(n='name')}",
    "action_labels": f"WITH {DEF2} SELECT DISTINCT name, {L.rules_sql(L.ACTIONS, "starts_with(name, '{w}')", "name || ' 操作'")} AS action FROM named",
    "parameter_lists": f"WITH {DEF2} SELECT file_id, name, start_line::BIGINT AS start_line, array_to_string(list_filter(coalesce(params, []), lambda p: p NOT IN ('self', 'cls')), ', ') AS params FROM named",
    "path_labels": f"WITH {FILES}, e AS (SELECT filename, lower(regexp_extract(filename, '\\.([^./]*)$', 1)) AS ext FROM f), t AS (SELECT *, {LOOK(L.HIGHLIGHT, 'ext', '')} AS highlight FROM e) SELECT filename, {LOOK(L.MEDIA, 'ext', 'application/octet-stream')} AS media, highlight, {LOOK(L.MAIN_EXTENSION, 'highlight', '')} AS main_extension, translate(filename, '/\\ :', '____') AS safe_name FROM t",
    "folder_clusters": f"""WITH {FILES}, t AS (SELECT split_part(filename, '/', 1) AS top, CASE WHEN contains(filename, '/') THEN split_part(filename, '/', 1) || '/' || split_part(filename, '/', 2) ELSE filename END AS second FROM f WHERE NOT {NOISE.format(n='module')}),
      r AS (SELECT CASE WHEN count(*) OVER (PARTITION BY top) > 100 THEN second ELSE top END AS dir FROM t), k AS (SELECT dir, count(*) AS modules FROM r GROUP BY 1),
      o AS (SELECT s.dir AS dir, b.dir AS dst, len(list_intersect({WORDS.format(c='s.dir')}, {WORDS.format(c='b.dir')})) AS n FROM k s JOIN k b ON s.modules < 3 AND b.modules >= 3), q AS (SELECT dir, dst FROM o WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, dst) = 1)
      SELECT coalesce(dst, k.dir) AS dir, sum(modules)::BIGINT AS modules FROM k LEFT JOIN q ON q.dir = k.dir GROUP BY 1 ORDER BY modules DESC, dir LIMIT 20""",
    "cluster_samples": f"""WITH {FILES}, x AS (SELECT split_part(filename, '/', 1) AS dir, module, regexp_extract(filename, '\\.([^./]*)$', 1) AS ext FROM f), e AS (SELECT dir, ext, count(*) AS k FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, ext) <= 3),
      s AS (SELECT dir, module FROM (SELECT DISTINCT dir, module FROM x) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY module) <= 5)
      SELECT dir, (SELECT string_agg(ext || '(' || k || ')', ',' ORDER BY k DESC, ext) FROM e WHERE e.dir = s.dir) AS extensions, string_agg(module, ',' ORDER BY module) AS samples FROM s GROUP BY dir""",
    "nearest_folder": f"WITH {EDGES_SQL}, p AS (SELECT DISTINCT split_part(src, '/', 1) AS source, split_part(dst, '/', 1) AS target FROM g WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)) SELECT source, target, len(list_filter({WORDS.format(c='target')}, lambda w: contains(source, w))) AS overlap FROM p",
    "core_modules": f"""WITH {DEGREE_SQL}, {FILES}, k AS (SELECT module AS name, max(coalesce(len(classes), 0)) AS classes FROM f GROUP BY 1), x AS (SELECT * FROM deg JOIN k USING (name) WHERE NOT {NOISE.format(n='name')}),
      a AS (SELECT name, 'entry' AS reason, 0::BIGINT AS amount FROM x WHERE n_in = 0 AND n_out > 0 ORDER BY name LIMIT 1), b AS (SELECT name, 'hub', n_in FROM x WHERE n_in > 0 AND name NOT IN (SELECT name FROM a) ORDER BY n_in DESC, name LIMIT 1),
      c AS (SELECT name, 'classes', classes FROM x WHERE classes > 0 AND name NOT IN (SELECT name FROM a) AND name NOT IN (SELECT name FROM b) ORDER BY classes DESC, name LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
    "core_classes": RANK_SQL + f", {CL}, x AS (SELECT c.name AS name, module, round(score, 10) AS score FROM cl JOIN rank ON rank.name = module), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, module) = 1) SELECT name, module, score FROM y ORDER BY score DESC, name LIMIT 20",
    "key_snippets": ROLE_SQL + f", {SNIP}, s AS (SELECT filename, snip.name AS name, start_line, end_line, round(round(score, 10) * 10 + n_in + CASE kind WHEN 'class' THEN 5 ELSE 0 END, 8) AS score FROM snip JOIN role ON role.name = module) SELECT * FROM s ORDER BY score DESC, filename, start_line, name LIMIT 50",
    "module_snippets": f"WITH {SNIP} SELECT filename, name, start_line, end_line, row_number() OVER (PARTITION BY filename ORDER BY kind = 'class', start_line, name) AS place FROM snip QUALIFY place <= 3",
    "top_functions": f"""WITH {CL}, me AS (SELECT module, c.name AS owner, unnest(c.methods) AS f FROM cl), x AS (SELECT DISTINCT module, f.name AS name FROM fn UNION SELECT module, owner || '.' || f.name FROM me),
      i AS (SELECT to_module AS module, to_name AS name, count(*) AS k FROM call_edge GROUP BY 1, 2), o AS (SELECT from_module AS module, from_name AS name, count(*) AS k FROM call_edge GROUP BY 1, 2),
      s AS (SELECT x.module, x.name, coalesce(i.k, 0) * 2 + coalesce(o.k, 0) AS score FROM x LEFT JOIN i ON i.module = x.module AND i.name = x.name LEFT JOIN o ON o.module = x.module AND o.name = x.name),
      t AS (SELECT count(*) AS total FROM s), u AS (SELECT total, greatest(CASE WHEN total < 300 THEN total WHEN total <= 600 THEN total // 2 ELSE floor(total * 0.4)::BIGINT END, least(10, total)) AS target FROM t),
      r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, name) AS own, row_number() OVER (ORDER BY score DESC, module, name) AS rank, count(*) OVER (PARTITION BY module) AS k FROM s),
      l AS (SELECT module, name, rank, (CASE WHEN rank <= floor(target * 0.35) THEN 1 WHEN own <= CASE WHEN k >= 50 THEN 4 WHEN k >= 20 THEN 3 ELSE 2 END THEN 2 ELSE 3 END)::BIGINT AS layer, target FROM r, u)
      SELECT module, name, layer, row_number() OVER (ORDER BY layer, rank) AS place FROM l QUALIFY place <= target""",
    "source_footer": RANK_SQL + f", {FILES} SELECT name, '`' || filename || coalesce(':' || coalesce(functions[1].start_line, classes[1].start_line), '') || '`（' || name || '）' AS reference FROM f JOIN rank ON name = module ORDER BY round(score, 10) DESC, name, filename LIMIT 10",
    "architecture_diagram": ROLE_SQL + ", r AS (SELECT name, role FROM role), ge AS (SELECT * FROM g)" + ARCH,
    "sub_diagram": ROLE_SQL + f", r AS (SELECT name, role FROM role WHERE starts_with(name, '{REPO}/') OR name = '{REPO}'), ge AS (SELECT * FROM g WHERE src IN (SELECT name FROM r) AND dst IN (SELECT name FROM r))" + ARCH,
    "top_level_diagram": f"WITH {EDGES_SQL}, t AS (SELECT split_part(name, '/', 1) AS name, sum(contains(name, '/')::BIGINT) AS k FROM nodes GROUP BY 1), ge AS (SELECT DISTINCT split_part(src, '/', 1) AS src, split_part(dst, '/', 1) AS dst FROM g WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)), l AS ({FIXED(0, '%% 顶层架构概览：展示各顶层模块包之间的依赖关系与角色分工', 'graph TD')} UNION ALL SELECT 1, name, '', '', '    ' || {ESC.format(n='name')} || '[' || name || CASE WHEN k > 0 THEN '<br/><i>' || k || ' 个子模块</i>' ELSE '' END || ']' FROM t UNION ALL SELECT 2, src, dst, '', '    ' || {ESC.format(n='src')} || ' --> ' || {ESC.format(n='dst')} FROM ge) SELECT row_number() OVER (ORDER BY part, a, b, c) AS line_no, line FROM l",
    "layered_diagram": ROLE_SQL + ", tiers(role, i, text) AS (VALUES " + ", ".join(f"('{r}', '{i}', '{dict((x[0], x[3]) for x in D.STYLES)[r]}')" for i, r in enumerate(D.TIERS)) + f"""), used AS (SELECT * FROM tiers WHERE role IN (SELECT role FROM role)), x AS (SELECT g.src, g.dst FROM g JOIN role a ON a.name = src JOIN role b ON b.name = dst WHERE a.role <> b.role QUALIFY row_number() OVER (PARTITION BY a.role, b.role ORDER BY src, dst) <= 3),
      l AS ({FIXED(0, '%% 分层架构图：按职责角色组织模块，展示系统的分层结构与跨层依赖', 'graph LR')} UNION ALL SELECT 1, i, '0', '', '    subgraph ' || {ESC.format(n='role')} || '["' || text || '"]' FROM used UNION ALL SELECT 1, i, '1', name, '        ' || {ESC.format(n='name')} || '["' || {SHORT.format(n='name')} || '"]' FROM role JOIN tiers USING (role) UNION ALL SELECT 1, i, '2', '', '    end' FROM used
      UNION ALL SELECT 2, src, dst, '', '    ' || {ESC.format(n='src')} || ' --> ' || {ESC.format(n='dst')} FROM x) SELECT row_number() OVER (ORDER BY part, a, b, c) AS line_no, line FROM l""",
    "class_diagram": f"WITH {CL}" + CLASS.format(where=""),
    "sub_class_diagram": f"WITH {CL}" + CLASS.format(where=f"WHERE starts_with(module, '{REPO}/')"),
    "directory_classes": f"WITH {CL} SELECT module, c.name AS name FROM cl WHERE starts_with(module, '{REPO}/')",
    "cyclic_edges": "WITH RECURSIVE e AS (SELECT DISTINCT split_part(from_module, '/', 1) AS src, split_part(to_module, '/', 1) AS dst FROM call_edge WHERE split_part(from_module, '/', 1) <> split_part(to_module, '/', 1)), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM e WHERE (dst, src) IN (SELECT (src, dst) FROM r)",
    "sequence_messages": PATHS + f""", s AS (SELECT path, unnest(range(1, len(p))) AS i, p, m FROM paths), t AS (SELECT path, i, m[i] AS f, m[i + 1] AS t, split_part(p[i + 1], '#', 2) AS name FROM s),
      u AS (SELECT path, i, f, t, name || '() — ' || {ACTION.format(n='name')} AS label, lag(f) OVER w AS pf, lag(t) OVER w AS pt FROM t WINDOW w AS (PARTITION BY path ORDER BY i)), v AS (SELECT *, lag(label) OVER (PARTITION BY path ORDER BY i) AS pl FROM u)
      SELECT path, i::BIGINT AS message_no, f AS from_module, t AS to_module, label, coalesce(pf = t AND pt = f, FALSE) AS is_return FROM v WHERE NOT coalesce(pf = f AND pt = t AND pl = label, FALSE)""",
    "sequence_summaries": PATHS + f""", h AS (SELECT path, m, n, split_part(p[1], '#', 2) AS first_name, split_part(p[-1], '#', 2) AS last_name, split_part(m[1], '/', 1) AS first_top, split_part(m[-1], '/', 1) AS last_top, len(list_distinct(list_transform(m, lambda x: split_part(x, '/', 1)))) AS layers FROM paths)
      SELECT path, m[1] || '.' || first_name || ' -> ' || m[-1] || '.' || last_name AS title, '触发条件：调用 ' || first_top || ' 的 ' || {ACTION.format(n='first_name')} || CASE WHEN layers > 2 THEN '；经过 ' || layers || ' 个模块协作' ELSE '' END || '；最终由 ' || last_top || ' 完成 ' || {ACTION.format(n='last_name')} AS description FROM h""",
}
