"""Queries that parse and render whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import extension, module_name
from ..operators import calls, parsing, render
from ..operators import graph as G
from ..operators.chunks import with_source
from ..session import load, once


def _sources(spark, d):
    return once(load(spark, d, "source_file").where("file_id is not null").select("file_id", "filename", "content", "scanned_at"), "file_id", "scanned_at")


def parsed_symbols(spark, d):
    return parsing.parse_files(_sources(spark, d), "file_id", "filename", "content")


def parse_agreement(spark, d):
    """Per language: definitions of the given symbol table, and how many the parser finds at the same line."""
    from ..operators.symbols import definitions, latest_files

    given = latest_files(load(spark, d, "file_result"))
    ext = given.select("file_id", extension(F.col("filename")).alias("ext"))
    mine = definitions(parsed_symbols(spark, d)).select("file_id", "name", "start_line").distinct().withColumn("hit", F.lit(1))
    both = definitions(given).where("start_line > 0").select("file_id", "name", "start_line").distinct().join(mine, ["file_id", "name", "start_line"], "left").join(ext, "file_id")
    return both.groupBy("ext").agg(F.count("*").alias("given"), F.count("hit").alias("found"))


def call_sites(spark, d):
    return calls.call_sites(_sources(spark, d), "file_id", "filename", "content")


def call_graph(spark, d):
    """Calls found in the sources, linked to the definitions of the symbol table."""
    from ..operators.symbols import definitions, latest_files

    files = latest_files(load(spark, d, "file_result"))
    return calls.call_graph(call_sites(spark, d), definitions(files).where("kind <> 'class'"), files.select("file_id", module_name(F.col("filename")).alias("module")))


def markdown_outline(spark, d):
    """Headings of the texts with their level."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike("^#{1,6} "))
    return lines.select("doc_id", (F.col("no") + 1).cast("long").alias("line_no"), F.length(F.regexp_extract("line", "^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("heading"))


def shifted_headings(spark, d):
    """Every heading one level deeper, the sixth stays."""
    text = F.regexp_replace("text", r"(?m)^(#{1,5}) ", "$1# ")
    return load(spark, d, "documents").select("doc_id", F.md5(text).alias("md5"))


def plain_texts(spark, d):
    """Texts without inline markup."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"), r"\*\*([^*\n]+)\*\*", "$1"), "`([^`\n]+)`", "$1")
    return load(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("length"), F.md5(t).alias("md5"))


def source_chunks(spark, d):
    """Function chunks with up to 60 lines of their source."""
    files = latest(spark, d)
    f = files.select("filename", F.explode("functions").alias("f")).select("filename", F.concat(F.lit("Function "), "f.name", F.lit("\n")).alias("content"), F.col("f.name").alias("name"), F.col("f.start_line").alias("start_line"), F.col("f.end_line").alias("end_line"))
    out = with_source(f, _sources(spark, d).select("filename", "content"))
    return out.select("filename", "name", F.col("start_line").cast("long").alias("start_line"), F.md5("content").alias("md5"))


def latest(spark, d):
    from ..operators.symbols import latest_files

    return latest_files(load(spark, d, "file_result"))


def import_groups(spark, d):
    """Imports per module and language, from the parser."""
    p = parsed_symbols(spark, d).select(extension(F.col("filename")).alias("ext"), F.inline("imports"))
    return p.groupBy("ext").agg(F.count("*").alias("imports"), F.countDistinct("module").alias("modules"))


def sequence_diagrams(spark, d):
    return render.sequence_lines(G.call_paths(load(spark, d, "call_edge"), 10))


def mermaid_validate(spark, d):
    """Errors of the texts' own code blocks, read as diagrams."""
    docs = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?s)```[a-z]*\n(.*?)```"), 1)).alias("block"))
    return render.validate_diagrams(docs, "doc_id", "block")


def markdown_bodies(spark, d):
    return render.rendered(load(spark, d, "documents"), "doc_id", "text")


def dir_keywords(spark, d):
    """The three most used words of class names per top folder."""
    from pyspark.sql import Window as W

    from ..functions.text import camel_words, top_directory
    from ..operators.symbols import definitions, latest_files

    f = latest_files(load(spark, d, "file_result"))
    c = definitions(f).where("kind = 'class'").join(f.select("file_id", top_directory(F.col("filename")).alias("dir")), "file_id").select("dir", F.explode(camel_words(F.col("name"))).alias("word"))
    k = c.groupBy("dir", "word").agg(F.count("*").alias("uses"))
    return k.withColumn("place", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("uses"), "word")).cast("long")).where("place <= 3")


QUERIES = {f.__name__: f for f in (parsed_symbols, parse_agreement, call_sites, call_graph, markdown_outline, shifted_headings, plain_texts, source_chunks, import_groups, sequence_diagrams, mermaid_validate, markdown_bodies, dir_keywords)}
def _sequence_sql() -> str:
    """Chains of up to ten calls as lines of diagrams."""
    from ..functions import labels as L

    act = lambda n: "(" + L.rules_sql(L.ACTIONS, "starts_with({n}, '{w}')", "{n} || ' 操作'").format(n=n) + ")"
    ident = lambda n: f"regexp_replace({n}, '[^A-Za-z0-9_]', '_', 'g')"
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT from_module || '#' || from_name AS a, to_module || '#' || to_name AS b, from_module AS ma, to_module AS mb FROM call_edge),
      heads AS (SELECT * FROM e WHERE a <> b AND a NOT IN (SELECT b FROM e WHERE a <> b)),
      walk(p, m, n) AS (SELECT [a, b], [ma, mb], 1 FROM heads UNION ALL SELECT list_append(p, b), list_append(m, mb), n + 1 FROM walk JOIN e ON e.a = p[-1] WHERE n < 10 AND NOT list_contains(p[2:], b)),
      c AS (SELECT list_aggregate(p, 'string_agg', ' -> ') AS path, p, m, split_part(p[1], '#', 2) AS fn, split_part(p[-1], '#', 2) AS ln, len(list_distinct(list_transform(m, lambda x: split_part(x, '/', 1)))) AS layers FROM walk WHERE n >= 2 AND len(list_distinct(m)) >= 2),
      s AS (SELECT path, unnest(range(1, len(p))) AS i, p, m FROM c), t AS (SELECT path, i, m[i] AS f, m[i + 1] AS t, split_part(p[i + 1], '#', 2) AS name FROM s),
      u AS (SELECT *, name || '() — ' || {act('name')} AS label FROM t), v AS (SELECT *, lag(f) OVER w AS pf, lag(t) OVER w AS pt, lag(label) OVER w AS pl FROM u WINDOW w AS (PARTITION BY path ORDER BY i)),
      k AS (SELECT path, unnest(range(1, len(m) + 1)) AS i, m FROM c), q AS (SELECT path, m[i] AS x, min(i) AS i FROM k GROUP BY 1, 2),
      l AS (SELECT path, 0 AS part, 0 AS i, 'sequenceDiagram' AS line FROM c
        UNION ALL SELECT path, 0, 1, '    %% 触发条件：调用 ' || split_part(m[1], '/', 1) || ' 的 ' || {act('fn')} || CASE WHEN layers > 2 THEN '；经过 ' || layers || ' 个模块协作' ELSE '' END || '；最终由 ' || split_part(m[-1], '/', 1) || ' 完成 ' || {act('ln')} FROM c
        UNION ALL SELECT path, 1, i, '    participant ' || {ident('x')} || ' as ' || x FROM q
        UNION ALL SELECT path, 2, i, '    ' || {ident('f')} || CASE WHEN coalesce(pf = t AND pt = f, FALSE) THEN '-->>' ELSE '->>' END || {ident('t')} || ': ' || label FROM v WHERE NOT coalesce(pf = f AND pt = t AND pl = label, FALSE))
      SELECT path, row_number() OVER (PARTITION BY path ORDER BY part, i) - 1 AS line_no, line FROM l"""


SQL = {
    "sequence_diagrams": _sequence_sql(),
    "markdown_outline": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), m AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, a FROM l) SELECT doc_id, line_no, length(regexp_extract(a[line_no], '^(#+)', 1)) AS level, trim(regexp_replace(a[line_no], '^#+ ', ''), ' ') AS heading FROM m WHERE regexp_matches(a[line_no], '^#{1,6} ')",
    "shifted_headings": "SELECT doc_id, md5(regexp_replace(text, '(?m)^(#{1,5}) ', '\\1# ', 'g')) AS md5 FROM documents",
    "plain_texts": "WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)', '\\1', 'g'), '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '`([^`\\n]+)`', '\\1', 'g') AS t FROM documents) SELECT doc_id, length(t) AS length, md5(t) AS md5 FROM p",
    "source_chunks": """WITH fr AS (SELECT * FROM file_result WHERE file_id IS NOT NULL AND filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) = 1), fn AS (SELECT filename, unnest(functions) AS f FROM fr),
      s AS (SELECT filename, string_split(replace(content, chr(13), ''), chr(10)) AS a FROM (SELECT * FROM source_file WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) = 1)),
      j AS (SELECT fn.filename, f.name AS name, f.start_line AS b, f.end_line AS e, a, 'Function ' || f.name || chr(10) AS c FROM fn LEFT JOIN s ON s.filename = fn.filename)
      SELECT filename, name, b::BIGINT AS start_line, md5(CASE WHEN b > 0 AND e > b AND a IS NOT NULL THEN c || chr(10) || '```' || chr(10) || regexp_replace(array_to_string(a[b:least(e, b + 59, len(a))], chr(10)), '\\s+$', '') || chr(10) || '```' || chr(10) ELSE c END) AS md5 FROM j""",
    "dir_keywords": """WITH fr AS (SELECT * FROM file_result WHERE file_id IS NOT NULL AND filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) = 1), cl AS (SELECT split_part(filename, '/', 1) AS dir, unnest(classes) AS c FROM fr),
      w AS (SELECT dir, unnest(regexp_extract_all(c.name, '[A-Z]?[^A-Z]*')) AS w FROM cl), k AS (SELECT dir, lower(w) AS word, count(*) AS uses FROM w WHERE w <> '' GROUP BY 1, 2) SELECT dir, word, uses, row_number() OVER (PARTITION BY dir ORDER BY uses DESC, word) AS place FROM k QUALIFY place <= 3""",
}
