"""Queries over symbols, chunks and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import symbols as S
from ..session import cut_lineage, load, once
from ..sources.files import wanted
from .graphs import LATEST


def _files(spark, d):
    return S.latest_files(load(spark, d, "file_result"))


def definitions(spark, d):
    return S.definitions(_files(spark, d)).select("file_id", "kind", "owner", "name", "start_line", "end_line")


def signatures(spark, d):
    f = S.definitions(_files(spark, d)).where("kind <> 'class'")
    return f.select("file_id", "kind", "start_line", T.signature(F.col("name"), F.col("params"), F.col("return_type")).alias("signature"))


def end_lines(spark, d):
    lengths = once(load(spark, d, "source_file").where("file_id is not null").select("file_id", "scanned_at", (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines")), "file_id", "scanned_at").select("file_id", "lines")
    return S.estimated_ends(S.definitions(_files(spark, d)), lengths)


def containment_join(spark, d):
    """Methods, taken as plain definitions, within the spans of the classes of their file."""
    defs = S.definitions(_files(spark, d)).where("kind <> 'function'")
    return S.contained(defs.withColumn("kind", F.when(F.col("kind") == "method", "function").otherwise(F.col("kind"))))


def asof_definition(spark, d):
    """Classes as points, functions as definitions."""
    defs = cut_lineage(S.definitions(_files(spark, d)))
    points = defs.where("kind = 'method' and start_line > 0").select("file_id", F.col("start_line").alias("line")).distinct()
    return S.nearest_before(points, defs.where("kind = 'class'"))


def symbol_totals(spark, d):
    f = _files(spark, d)
    methods = F.aggregate(F.coalesce("classes", F.array()), F.lit(0), lambda a, c: a + F.coalesce(F.size(c["methods"]), F.lit(0)))
    return f.groupBy(T.top_directory(F.col("filename")).alias("repo")).agg(F.count("*").alias("modules"), F.sum(F.coalesce(F.size("classes"), F.lit(0)).cast("long")).alias("classes"), F.sum((F.coalesce(F.size("functions"), F.lit(0)) + methods).cast("long")).alias("functions"))


def richest_classes(spark, d):
    """Of classes with one name the one with most methods, the earliest file first."""
    c = _files(spark, d).select("file_id", F.explode("classes").alias("c")).select("file_id", F.col("c.name").alias("name"), F.coalesce(F.size("c.methods"), F.lit(0)).cast("long").alias("methods"))
    return c.groupBy("name").agg(F.max_by(F.struct("file_id", "methods"), F.struct(F.col("methods"), -F.col("file_id"))).alias("x")).select("name", "x.file_id", "x.methods")


def detect_language(spark, d):
    """A repository's language: the one with 85 % of its files alone, else all with 15 %, by size."""
    f = _files(spark, d).select(T.top_directory(F.col("filename")).alias("repo"), F.element_at(F.create_map(*[F.lit(x) for kv in T.LANGUAGE_OF.items() for x in kv]), T.extension(F.col("filename"))).alias("lang")).where("lang is not null")
    k = f.groupBy("repo", "lang").agg(F.count("*").alias("k"))
    per = k.groupBy("repo").agg(F.sum("k").alias("n"), F.collect_list(F.struct("k", "lang")).alias("xs"))
    label = lambda x: F.concat(x["lang"], F.lit("（"), x["k"].cast("string"), F.lit(" 个文件）"))
    # Ties in size go by name; at most as many entries as there are languages.
    ordered = per.withColumn("xs", F.array_sort("xs", lambda a, b: F.when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).when(a["lang"] < b["lang"], -1).otherwise(1)))
    many = F.array_join(F.transform(F.filter("xs", lambda x: x["k"] >= F.col("n") * 0.15), label), "、")
    return ordered.select("repo", F.when(F.col("xs")[0]["k"] >= F.col("n") * 0.85, F.col("xs")[0]["lang"]).when(many != "", many).otherwise(F.col("xs")[0]["lang"]).alias("language"))


def python_imports(spark, d):
    s = once(load(spark, d, "source_file").where("file_id is not null and filename like '%.py'").select("file_id", "content", "scanned_at"), "file_id", "scanned_at")
    lines = s.select("file_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).select("file_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")
    return S.python_imports(lines, "line").select("file_id", "line_no", "module", "name", "is_relative")


def import_chunks(spark, d):
    return C.import_chunks(_files(spark, d)).select("id", "content")


def class_chunks(spark, d):
    return C.class_chunks(_files(spark, d)).select("id", "content")


def function_chunks(spark, d):
    return C.function_chunks(_files(spark, d)).select("id", "content")


def module_chunks(spark, d):
    return C.module_chunks(_files(spark, d)).select("id", "content")


def document_sections(spark, d):
    return C.document_sections(load(spark, d, "documents"), "doc_id", "text")


def noise_filter(spark, d):
    f = _files(spark, d).select(T.module_name(F.col("filename")).alias("name"))
    return f.withColumn("noise", T.is_noise(F.col("name")))


def source_scan(spark, d):
    """Which rows a scan of the files would keep: supported extensions, no skipped folder."""
    f = load(spark, d, "source_file").where("filename is not null").select("filename").distinct()
    return f.select("filename", wanted(F.col("filename")).alias("kept"))


def file_tree(spark, d):
    """Every folder and file with its parent."""
    f = _files(spark, d).select("filename")
    parts = F.split("filename", "/")
    rows = f.select(F.size(parts).alias("n"), parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    path = lambda i: F.array_join(F.slice("p", F.lit(1), i), "/")
    return rows.select(path(F.col("i")).alias("path"), path(F.col("i") - 1).alias("parent"), F.element_at("p", F.col("i")).alias("name"), (F.col("i") < F.col("n")).alias("is_dir")).distinct()


def slugs(spark, d):
    t = load(spark, d, "documents").where("title is not null").select("doc_id", "title")
    return t.select("doc_id", T.heading_slug(F.col("title")).alias("heading_slug"), T.chunk_slug(F.col("title")).alias("chunk_slug"))


def snippets(spark, d):
    return load(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def reading_time(spark, d):
    return load(spark, d, "documents").select("doc_id", T.reading_minutes(F.col("text")).cast("long").alias("minutes"))


def camel_vocabulary(spark, d):
    c = S.definitions(_files(spark, d)).where("kind = 'class'").select(F.explode(T.camel_words(F.col("name"))).alias("word"))
    return c.groupBy("word").agg(F.count("*").alias("uses"))


def known_identifiers(spark, d):
    """Quoted names in documents, and whether anything is called so."""
    defs = S.definitions(_files(spark, d)).select("name").distinct()
    quoted = load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`([^`\n]+)`"), 1))).alias("name"))
    return quoted.join(defs.withColumn("known", F.lit(True)), "name", "left").groupBy("doc_id").agg(F.count("*").alias("quoted"), F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("unknown"))


def checklist_like(spark, d):
    """Texts that are mostly list items, or hardly a text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    marked = F.filter(lines, lambda x: F.trim(x).rlike(r"^([-*] |\d+\. )"))
    return load(spark, d, "documents").select("doc_id", ((F.octet_length("text") < 20) | (F.size(marked) > 0.5 * F.size(lines))).alias("checklist"))


def doc_budget(spark, d):
    """The texts of a repository in their order within a budget of 8000 characters; the one that
    crosses it is cut."""
    from pyspark.sql import Window as W

    docs = load(spark, d, "documents").where("repo is not null").select("repo", "doc_id", F.substring("text", 1, 3000).alias("text"))
    used = F.sum(F.length("text")).over(W.partitionBy("repo").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1))
    rows = docs.withColumn("used", F.coalesce(used, F.lit(0))).where("used < 8000")
    return rows.select("repo", "doc_id", F.least(F.length("text").cast("long"), 8000 - F.col("used")).alias("taken"))


QUERIES = {f.__name__: f for f in (definitions, signatures, end_lines, containment_join, asof_definition, symbol_totals, richest_classes, detect_language, python_imports, import_chunks, class_chunks, function_chunks, module_chunks, document_sections, noise_filter, source_scan, file_tree, slugs, snippets, reading_time, camel_vocabulary, known_identifiers, checklist_like, doc_budget)}

DEFS = LATEST + """, cl AS (SELECT file_id, unnest(classes) AS c FROM fr), fn AS (SELECT file_id, unnest(functions) AS f FROM fr), me AS (SELECT file_id, c.name AS owner, unnest(c.methods) AS f FROM cl),
 defs AS (SELECT file_id, 'class' AS kind, NULL::VARCHAR AS owner, c.name AS name, c.start_line::BIGINT AS start_line, c.end_line::BIGINT AS end_line, NULL::VARCHAR[] AS params, NULL::VARCHAR AS return_type FROM cl
  UNION ALL SELECT file_id, 'function', NULL, f.name, f.start_line, f.end_line, f.params, f.return_type FROM fn UNION ALL SELECT file_id, 'method', owner, f.name, f.start_line, f.end_line, f.params, f.return_type FROM me)"""
SIG = "name || '(' || array_to_string(coalesce(params, []), ', ') || ')' || CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END"
LANG = "CASE lower(regexp_extract(filename, '\\.([^./]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_OF.items()) + " END"
SKIP = ", ".join(f"'{x}'" for x in T.SKIPPED)
SQL = {
    "definitions": f"WITH {DEFS} SELECT file_id, kind, owner, name, start_line, end_line FROM defs",
    "signatures": f"WITH {DEFS} SELECT file_id, kind, start_line, {SIG} AS signature FROM defs WHERE kind <> 'class'",
    "end_lines": f"""WITH {DEFS}, ln AS (SELECT file_id, arg_max(length(content) - length(replace(content, chr(10), '')) + 1, scanned_at)::BIGINT AS lines FROM source_file WHERE file_id IS NOT NULL GROUP BY 1)
      SELECT file_id, kind, name, start_line, greatest(start_line, coalesce(lead(start_line) OVER (PARTITION BY file_id ORDER BY start_line, kind, name) - 1, lines, start_line)) AS est_end FROM defs LEFT JOIN ln USING (file_id) WHERE kind <> 'method' AND start_line > 0""",
    "containment_join": f"WITH {DEFS} SELECT i.file_id, i.name, i.start_line, arg_min(o.name, (o.start_line, o.name)) AS class_name FROM defs i JOIN defs o ON i.file_id = o.file_id AND i.kind = 'method' AND o.kind = 'class' AND o.end_line > 0 AND i.start_line >= o.start_line AND i.end_line <= o.end_line GROUP BY 1, 2, 3",
    "asof_definition": f"WITH {DEFS}, p AS (SELECT DISTINCT file_id, start_line AS line FROM defs WHERE kind = 'method' AND start_line > 0), c AS (SELECT file_id, start_line AS def_line, min(name) AS name FROM defs WHERE kind = 'class' AND start_line > 0 GROUP BY 1, 2) SELECT p.file_id, p.line, c.name, c.def_line FROM p ASOF JOIN c ON p.file_id = c.file_id AND p.line >= c.def_line",
    "symbol_totals": f"WITH {LATEST} SELECT split_part(filename, '/', 1) AS repo, count(*) AS modules, sum(coalesce(len(classes), 0))::BIGINT AS classes, sum(coalesce(len(functions), 0) + coalesce(list_sum(list_transform(classes, lambda c: coalesce(len(c.methods), 0))), 0))::BIGINT AS functions FROM fr GROUP BY 1",
    "richest_classes": f"WITH {LATEST}, cl AS (SELECT file_id, unnest(classes) AS c FROM fr) SELECT c.name AS name, file_id, coalesce(len(c.methods), 0)::BIGINT AS methods FROM cl QUALIFY row_number() OVER (PARTITION BY c.name ORDER BY coalesce(len(c.methods), 0) DESC, file_id) = 1",
    "detect_language": f"""WITH {LATEST}, l AS (SELECT split_part(filename, '/', 1) AS repo, {LANG} AS lang FROM fr), k AS (SELECT repo, lang, count(*) AS k FROM l WHERE lang IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, sum(k) OVER (PARTITION BY repo) AS n, row_number() OVER (PARTITION BY repo ORDER BY k DESC, lang) AS r FROM k),
      m AS (SELECT repo, string_agg(lang || '（' || k || ' 个文件）', '、' ORDER BY r) FILTER (k >= n * 0.15) AS many, max(lang) FILTER (r = 1) AS first_lang, max(k) FILTER (r = 1) AS first_k, max(n) AS n FROM n GROUP BY 1)
      SELECT repo, CASE WHEN first_k >= n * 0.85 THEN first_lang WHEN many IS NOT NULL THEN many ELSE first_lang END AS language FROM m""",
    "python_imports": """WITH s AS (SELECT file_id, arg_max(content, scanned_at) AS content FROM source_file WHERE file_id IS NOT NULL AND filename LIKE '%.py' GROUP BY 1),
      x AS (SELECT file_id, string_split(content, chr(10)) AS a FROM s), y AS (SELECT file_id, unnest(range(1, len(a) + 1)) AS line_no, a FROM x),
      l AS (SELECT file_id, line_no, trim(regexp_replace(regexp_replace(a[line_no], '[\\r\\t]', ' ', 'g'), '\\s*#.*$', ''), ' ') AS l FROM y),
      f AS (SELECT file_id, line_no, regexp_extract(l, '^from +(\\S+) +import', 1) AS module, unnest(string_split(regexp_replace(regexp_extract(l, ' import +(.*)$', 1), '[()]', '', 'g'), ',')) AS n, TRUE AS is_from FROM l WHERE regexp_matches(l, '^from +\\S+ +import +[\\w*]')),
      i AS (SELECT file_id, line_no, unnest(string_split(regexp_extract(l, '^import +(.*)$', 1), ',')) AS n FROM l WHERE regexp_matches(l, '^import +\\w')),
      j AS (SELECT file_id, line_no, regexp_extract(n, '^ *(\\S+)', 1) AS module, n, FALSE AS is_from FROM i), u AS (SELECT * FROM f UNION ALL SELECT * FROM j),
      r AS (SELECT file_id, line_no, module, CASE WHEN regexp_extract(n, ' as +(\\w+) *$', 1) <> '' THEN regexp_extract(n, ' as +(\\w+) *$', 1) WHEN is_from THEN trim(n, ' ') ELSE regexp_extract(module, '([^.]*)$', 1) END AS name FROM u)
      SELECT file_id, line_no, module, name, starts_with(module, '.') AS is_relative FROM r WHERE name <> ''""",
    "import_chunks": f"WITH {LATEST} SELECT filename || '#imports' AS id, 'File ' || filename || ' imports:' || chr(10) || array_to_string(list_transform(imports, lambda i: '- ' || CASE WHEN coalesce(i.name, '') = '' THEN i.module ELSE i.name || ' from ' || i.module END), chr(10)) || chr(10) AS content FROM fr WHERE len(imports) > 0",
    "class_chunks": f"""WITH {LATEST}, cl AS (SELECT filename, unnest(classes) AS c FROM fr) SELECT concat_ws('#', filename, c.name) AS id, 'Class ' || c.name || CASE WHEN len(c.bases) > 0 THEN ' extends ' || array_to_string(c.bases, ', ') ELSE '' END || CASE WHEN len(c.decorators) > 0 THEN ' [decorators: ' || array_to_string(c.decorators, ', ') || ']' ELSE '' END || chr(10) ||
      CASE WHEN len(c.methods) > 0 THEN 'Methods:' || chr(10) || array_to_string(list_transform(c.methods, lambda m: '- ' || m.name || '(' || array_to_string(coalesce(m.params, []), ', ') || ')' || CASE WHEN coalesce(m.return_type, '') <> '' THEN ' -> ' || m.return_type ELSE '' END), chr(10)) || chr(10) ELSE '' END AS content FROM cl""",
    "function_chunks": f"WITH {LATEST}, fn AS (SELECT filename, unnest(functions) AS f FROM fr) SELECT concat_ws('#', filename, f.name) AS id, 'Function ' || f.name || '(' || array_to_string(coalesce(f.params, []), ', ') || ')' || CASE WHEN coalesce(f.return_type, '') <> '' THEN ' -> ' || f.return_type ELSE '' END || CASE WHEN len(f.decorators) > 0 THEN ' [decorators: ' || array_to_string(f.decorators, ', ') || ']' ELSE '' END || chr(10) AS content FROM fn",
    "module_chunks": f"WITH {LATEST} SELECT filename || '#module' AS id, 'File: ' || filename || chr(10) AS content FROM fr WHERE coalesce(len(imports), 0) = 0 AND coalesce(len(classes), 0) = 0 AND coalesce(len(functions), 0) = 0",
    "document_sections": """WITH p AS (SELECT doc_id, string_split(chr(10) || text, chr(10) || '## ') AS a FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, unnest(range(2, len(a) + 1)) AS i, a FROM p),
      r AS (SELECT doc_id, i - 1 AS section_no, trim(split_part(a[i], chr(10), 1), ' ') AS heading, regexp_replace(CASE WHEN contains(a[i], chr(10)) THEN substring(a[i], instr(a[i], chr(10)) + 1) ELSE '' END, '^\\s+|\\s+$', '', 'g') AS body FROM q),
      k AS (SELECT *, lower(regexp_replace(translate(heading, ' /', '--'), '[^A-Za-z0-9_-]', '', 'g')) AS s FROM r WHERE body <> '')
      SELECT doc_id, section_no, heading, 'wiki/' || doc_id || '#' || CASE WHEN heading = '' THEN 'top' WHEN s = '' THEN 'section' ELSE s END AS id, CASE WHEN length(body) > 800 THEN substring(body, 1, 800) || '...' ELSE body END AS content FROM k""",
    "noise_filter": f"WITH {LATEST}, n AS (SELECT regexp_replace(filename, '\\.[^./]*$', '') AS name FROM fr) SELECT name, ends_with(name, '_test') OR (contains(name, 'testdata') AND NOT contains(name, 'testdata/repos/')) OR contains(name, 'scripts/debug') AS noise FROM n",
    "source_scan": f"SELECT DISTINCT filename, lower(regexp_extract(filename, '\\.([^./]*)$', 1)) IN ({', '.join(repr(x) for x in T.EXTENSIONS)}) AND len(list_filter(string_split(filename, '/')[:-2], lambda x: x IN ({SKIP}) OR starts_with(x, '.'))) = 0 AS kept FROM source_file WHERE filename IS NOT NULL",
    "file_tree": f"WITH {LATEST}, p AS (SELECT string_split(filename, '/') AS p FROM fr), q AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p) SELECT DISTINCT array_to_string(p[1:i], '/') AS path, array_to_string(p[1:i-1], '/') AS parent, p[i] AS name, i < len(p) AS is_dir FROM q",
    "slugs": "WITH t AS (SELECT doc_id, title, lower(regexp_replace(translate(title, ' /', '--'), '[^A-Za-z0-9_-]', '', 'g')) AS s FROM documents WHERE title IS NOT NULL) SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS heading_slug, CASE WHEN title = '' THEN 'top' WHEN s = '' THEN 'section' ELSE s END AS chunk_slug FROM t",
    "snippets": "WITH f AS (SELECT doc_id, replace(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), '  ', ' ') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substring(t, 1, 120) || '…' ELSE t END AS snippet FROM f",
    "reading_time": "SELECT doc_id, greatest(1, length(regexp_replace(text, '[ \\n]', '', 'g')) // 400)::BIGINT AS minutes FROM documents",
    "camel_vocabulary": f"WITH {DEFS}, w AS (SELECT unnest(regexp_extract_all(name, '[A-Z]?[^A-Z]*')) AS w FROM defs WHERE kind = 'class') SELECT lower(w) AS word, count(*) AS uses FROM w WHERE w <> '' GROUP BY 1",
    "known_identifiers": f"WITH {DEFS}, q AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '`([^`\\n]+)`', 1))) AS name FROM documents) SELECT doc_id, count(*) AS quoted, sum(CASE WHEN name IN (SELECT name FROM defs) THEN 0 ELSE 1 END)::BIGINT AS unknown FROM q GROUP BY 1",
    "checklist_like": "WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents) SELECT doc_id, strlen(text) < 20 OR len(list_filter(l, lambda x: regexp_matches(trim(x, ' '), '^([-*] |\\d+\\. )'))) > 0.5 * len(l) AS checklist FROM l",
    "doc_budget": "WITH t AS (SELECT repo, doc_id, length(substring(text, 1, 3000)) AS n FROM documents WHERE repo IS NOT NULL), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY repo ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t) SELECT repo, doc_id, least(n, 8000 - used)::BIGINT AS taken FROM u WHERE used < 8000",
}
