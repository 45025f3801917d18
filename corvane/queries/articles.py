"""Queries over documents, source lines and kept states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import is_noise, module_name, reading_minutes, symbols
from ..operators import incremental as I
from ..operators import texts as X
from ..operators.chunks import file_chunks, with_source
from ..operators.selection import ranked_within
from ..operators.symbols import definitions, latest_files
from ..session import cut_lineage, load, once
from .graphs import LATEST
from .modules import CL, DEF2, FILES, NOISE, PATHS
from .search import SYM

# Words by which a project's documents are put in order; the earlier, the more they say about it.
ARTIFACT_FOLDERS = ("build", "dist", "out", "target", "bin", "obj", "node_modules", "__pycache__")
ARTIFACT_ENDINGS = r"\.(?:min\.js|map|lock|pyc|class|o|generated\.\w+|pb\.\w+)$"
PRIORITY = ("architecture", "design", "overview", "guide", "api", "config", "deploy", "release")


def _files(spark, d):
    return latest_files(load(spark, d, "file_result")).withColumn("module", module_name(F.col("filename")))


def _docs(spark, d):
    return load(spark, d, "documents")


def _lines(spark, d):
    s = once(load(spark, d, "source_file").where("file_id is not null").select("file_id", "content", "scanned_at"), "file_id", "scanned_at")
    return s.select("file_id", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("no", "line")).select("file_id", (F.col("no") + 1).cast("long").alias("line_no"), "line")


def readme_source(spark, d):
    """Each repository's first readme, cut to 4000 bytes."""
    r = _docs(spark, d).where("repo is not null and doc_kind = 'readme' and text is not null")
    first = r.groupBy("repo").agg(F.min(F.struct("doc_id", F.octet_length("text").alias("n"))).alias("x"))
    return first.select("repo", "x.doc_id", F.least("x.n", F.lit(4000)).cast("long").alias("bytes"), (F.col("x.n") > 4000).alias("cut"))


def project_docs(spark, d):
    """Up to twelve documents of each repository, those that speak of its structure first, cut to 3000
    characters."""
    o = _docs(spark, d).where("repo is not null and doc_kind <> 'readme' and text is not null")
    name = F.lower(F.coalesce("title", F.lit("")))
    rank = L.first_rule([((w,), i) for i, w in enumerate(PRIORITY)], name.contains, F.lit(len(PRIORITY)))
    return ranked_within(o.select("repo", "doc_id", rank.alias("priority"), F.least(F.length("text"), F.lit(3000)).cast("long").alias("taken")), ["repo"], F.asc("priority"), F.asc("doc_id")).where("place <= 12").select("repo", "doc_id", "taken", "place")


def front_matter(spark, d):
    t = _docs(spark, d).where("text is not null").withColumn("name", X.title_of(F.col("title"), F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))
    return t.select("doc_id", F.col("name").alias("shown_title"), F.md5(X.with_front_matter(F.col("text"), F.col("name"), F.col("repo"))).alias("md5"))


def front_matter_stripped(spark, d):
    """Front matter is put before every text and taken away again."""
    t = _docs(spark, d).where("text is not null")
    return t.select("doc_id", F.md5(X.without_front_matter(X.with_front_matter(F.col("text"), F.lit("x"), F.col("repo")))).alias("md5"))


def fences_stripped(spark, d):
    t = _docs(spark, d).where("text is not null")
    return t.select("doc_id", F.md5(X.without_fence(F.concat(F.lit("```markdown\n"), "text", F.lit("\n```")))).alias("md5"))


def next_reading(spark, d):
    """The documents before and after each one of its repository."""
    p = cut_lineage(ranked_within(_docs(spark, d).where("repo is not null").select("repo", "doc_id"), ["repo"], F.asc("doc_id")))
    after = p.select("repo", (F.col("place") - 1).alias("place"), F.col("doc_id").alias("next_doc"))
    before = p.select("repo", (F.col("place") + 1).alias("place"), F.col("doc_id").alias("previous_doc"))
    return p.join(after, ["repo", "place"], "left").join(before, ["repo", "place"], "left").select("repo", "doc_id", "previous_doc", "next_doc")


def compilation(spark, d):
    """The parts of each repository's compilation in order, headings one level deeper."""
    t = _docs(spark, d).where("repo is not null and text is not null").select("repo", "doc_id", F.md5(F.concat(F.lit("\n\n"), F.regexp_replace("text", r"(?m)^(#{1,5}) ", "$1# "))).alias("md5"))
    return ranked_within(t, ["repo"], F.asc("doc_id")).select("repo", "place", "doc_id", "md5")


def navigation(spark, d):
    """Sections of the navigation with their reading time and difficulty."""
    t = _docs(spark, d).where("text is not null")
    level = F.when(F.col("doc_kind").isin("readme", "wiki_page"), "easy").when(F.col("doc_kind").isin("answer", "changelog"), "medium").otherwise("hard")
    return t.groupBy("repo", "doc_kind", level.alias("difficulty")).agg(F.count("*").alias("articles"), F.sum(reading_minutes(F.col("text")).cast("long")).alias("minutes"))


def readme_hints(spark, d):
    return X.hints(_docs(spark, d), "doc_id", "text")


def unknown_names(spark, d):
    f = _files(spark, d)
    return X.unknown_names(X.quoted_names(_docs(spark, d), "doc_id", "text"), "doc_id", f.select(F.col("module").alias("path")).union(f.select("filename")), definitions(f).select("name"))


def import_statements(spark, d):
    return X.import_statements(_lines(spark, d), "line").select("file_id", "line_no", "module", "is_relative")


def named_calls(spark, d):
    """How many lines of source call each known function by name."""
    names = definitions(_files(spark, d)).where("kind <> 'class' and length(name) >= 6").select("name").distinct()
    return X.named_calls(_lines(spark, d), names, ["file_id", "line_no"], "line").groupBy("name").agg(F.count("*").alias("lines"))


def attributions(spark, d):
    """Source attributions as spans: a path in brackets, its module and its folder."""
    f = _files(spark, d).select("file_id", F.concat(F.lit("["), "filename", F.lit("]，"), "module", F.lit(", "), F.regexp_replace("filename", "[^/]*$", "")).alias("said"), F.concat(F.lit("."), F.regexp_extract("filename", r"([^.]*)$", 1)).alias("ext"))
    return f.select("file_id", X.source_spans(X.attribution(F.col("said")), F.col("ext")).alias("spans"))


def description_lines(spark, d):
    return X.descriptions(_docs(spark, d), "doc_id", "text")


def description_matches(spark, d):
    """Described names and the function they mean: of the same name, else of the same last part. The
    descriptions are list items made from the call table."""
    calls = load(spark, d, "call_edge").select("to_name", "from_name", F.split_part("to_module", F.lit("-"), F.lit(1)).alias("top")).distinct()
    items = calls.select(F.explode(F.array(F.concat(F.lit("- `"), "top", F.lit("."), "to_name", F.lit("`: called")), F.concat(F.lit("* **"), "from_name", F.lit("**: calls")))).alias("said")).withColumn("doc_id", F.xxhash64("said"))
    told = X.descriptions(items, "doc_id", "said").select("name").distinct()
    names = definitions(_files(spark, d)).where("kind <> 'class'").select(F.col("name").alias("function")).distinct()
    exact = told.join(names, F.col("name") == F.col("function")).select("name", "function", F.lit(1).cast("long").alias("rule"))
    last = told.join(exact, "name", "left_anti").withColumn("function", F.regexp_extract("name", r"([^.]*)$", 1)).join(names, "function").select("name", "function", F.lit(2).cast("long").alias("rule"))
    return exact.unionByName(last)


def name_resolution(spark, d):
    """Names of called modules, whole and by their last two parts, and the module they mean: the module
    itself, its file, its last parts."""
    called = load(spark, d, "call_edge").select("to_module").distinct()
    asked = called.select(F.explode(F.array(F.col("to_module"), F.regexp_extract("to_module", "([^/]*/[^/]*)$", 1))).alias("name")).where("name <> ''").distinct()
    f = _files(spark, d).select("module", "filename")
    keys = f.select("module", F.col("module").alias("name"), F.lit(1).alias("rule")).union(f.select("module", "filename", F.lit(2))).union(f.select("module", F.explode(X.path_ends(F.col("module"))), F.lit(3)))
    hit = asked.join(keys, "name").groupBy("name").agg(F.min(F.struct("rule", "module")).alias("x"))
    return hit.select("name", "x.module", F.col("x.rule").cast("long").alias("rule"))


def source_lookup(spark, d):
    """Files of called modules: by the whole path, by the path without its first segments, by name."""
    asked = load(spark, d, "call_edge").select(F.col("to_module").alias("name")).where("not contains(name, '..')").distinct()
    f = _files(spark, d).select("module", "filename")
    tries = asked.select("name", F.posexplode(X.path_ends(F.col("name"))).alias("priority", "try"))
    known = f.select(F.col("module").alias("try"), "filename").union(f.select(F.regexp_extract("module", "([^/]*)$", 1), "filename"))
    hit = tries.join(known, "try").groupBy("name").agg(F.min(F.struct("priority", "filename")).alias("x"))
    return hit.select("name", "x.filename", F.col("x.priority").cast("long").alias("priority"))


def tree_order(spark, d):
    """Files and folders below each folder in their order: folders first."""
    f = _files(spark, d).select("filename")
    parts = F.split("filename", "/")
    rows = f.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    path = lambda i: F.array_join(F.slice("p", F.lit(1), i), "/")
    tree = rows.select(path(F.col("i") - 1).alias("parent"), path(F.col("i")).alias("path"), (F.col("i") == F.size("p")).cast("int").alias("leaf")).distinct()
    return ranked_within(tree, ["parent"], F.asc("leaf"), F.asc("path")).select("parent", "path", "place")


def all_chunks(spark, d):
    """Every chunk of the symbol tables; classes and functions with up to 60 lines of source."""
    f = _files(spark, d)
    made = file_chunks(f).where("chunk_type in ('import', 'module')").select("id", "chunk_type", "content")
    spans = f.select("filename", F.explode("classes").alias("x")).select(F.concat_ws("#", "filename", "x.name").alias("id"), F.col("x.start_line").alias("start_line"), F.col("x.end_line").alias("end_line"), F.lit("class").alias("chunk_type"))
    spans = spans.union(f.select("filename", F.explode("functions").alias("x")).select(F.concat_ws("#", "filename", "x.name"), "x.start_line", "x.end_line", F.lit("function")))
    coded = file_chunks(f).where("chunk_type in ('class', 'function')").select("id", "chunk_type", "content", "filename").distinct().join(spans.groupBy("id", "chunk_type").agg(F.min(F.struct("start_line", "end_line")).alias("s")), ["id", "chunk_type"]).select("id", "chunk_type", "content", "filename", "s.start_line", "s.end_line")
    sources = once(load(spark, d, "source_file").where("file_id is not null").select("file_id", "filename", "content", "scanned_at"), "file_id", "scanned_at")
    coded = with_source(coded, sources.select("filename", "content")).select("id", "chunk_type", "content")
    return made.unionByName(coded).select("id", "chunk_type", F.md5("content").alias("md5"))


def _states(spark, d):
    """(first, newest) states of every path."""
    i = load(spark, d, "file_index").where("path is not null")
    first = i.groupBy("path").agg(F.min(F.struct("mtime", "size")).alias("x")).select("path", "x.mtime", "x.size")
    return first, I.newest(i)


def cache_hits(spark, d):
    """Whether a parse kept for a file's first state still holds."""
    first, now = _states(spark, d)
    return now.join(first.toDF("path", "m", "s"), "path").select("path", ((F.col("m") == F.col("mtime")) & (F.col("s") == F.col("size"))).alias("hit"))


def cache_counts(spark, d):
    return cache_hits(spark, d).groupBy("hit").agg(F.count("*").alias("files"))


def graph_cache(spark, d):
    """Repositories whose graph can be kept: none of their files changed."""
    return cache_hits(spark, d).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")).agg(F.min("hit").alias("valid"))


def manifest_changes(spark, d):
    """The newest states against the first ones."""
    first, now = _states(spark, d)
    return I.changed(now, first).select("path", "mtime", "size", "is_new")


def manifest_vanished(spark, d):
    """Kept paths that a scan of Python and TypeScript files doesn't find."""
    now = load(spark, d, "source_file").select(F.col("filename").alias("path")).where("path like '%.py' or path like '%.ts'").distinct()
    return I.vanished(now, _states(spark, d)[1])


def _functions(spark, d):
    return _files(spark, d).select("module", F.inline("functions")).select(F.concat_ws("#", "module", "name").alias("key")).distinct()


def resume_pending(spark, d):
    """Functions that a checkpoint of called functions doesn't have."""
    kept = load(spark, d, "call_edge").select(F.concat_ws("#", "to_module", "to_name").alias("key")).distinct()
    return _functions(spark, d).join(kept, "key", "left_anti")


def resume_stale(spark, d):
    """Keys of that checkpoint that are no function any more."""
    kept = load(spark, d, "call_edge").select(F.concat_ws("#", "to_module", "to_name").alias("key")).distinct()
    return kept.join(_functions(spark, d), "key", "left_anti")


def history_turns(spark, d):
    """The turns of each repository's conversation in order."""
    t = _docs(spark, d).where("repo is not null and doc_kind = 'answer' and text is not null").select("repo", "doc_id", "created_at", F.md5(F.concat(F.lit("问："), F.coalesce("title", F.lit("")), F.lit("\n答："), "text", F.lit("\n\n"))).alias("md5"))
    return ranked_within(t, ["repo"], F.asc_nulls_first("created_at"), F.asc("doc_id"), name="turn").select("repo", "turn", "doc_id", "md5")


def versions_kept(spark, d):
    """The ten newest versions of each repository's documents, by their names."""
    v = _docs(spark, d).where("repo is not null and created_at is not null").select("repo", F.date_format("created_at", "yyyyMMddHHmmss").alias("version")).distinct()
    return ranked_within(v, ["repo"], F.desc("version")).where("place <= 10").select("repo", "version", "place")


def record_counts(spark, d):
    v = load(spark, d, "vectors").where("vector is not null and id is not null")
    return v.groupBy(F.size("vector").cast("long").alias("dim")).agg(F.count_distinct("id").alias("records"))


def record_lookup(spark, d):
    """Whether the store has a vector for each chunk id."""
    c = load(spark, d, "chunk").where("id is not null").select("id").distinct()
    s = load(spark, d, "vectors").where("vector is not null").select("id").distinct().withColumn("stored", F.lit(True))
    return c.join(s, "id", "left").select("id", F.coalesce("stored", F.lit(False)).alias("stored"))


def records_deleted(spark, d):
    """The store without the vectors of documents."""
    gone = load(spark, d, "chunk").where("chunk_type = 'document' and id is not null").select("id").distinct()
    return I.without(load(spark, d, "vectors").where("id is not null").select("id").distinct(), gone, "id")


def masked_ids(spark, d):
    c = load(spark, d, "chunk").where("id is not null").select("id", "chunk_type", "name").distinct()
    depth = F.length(F.coalesce("name", F.lit(""))) - F.length(F.replace(F.coalesce("name", F.lit("")), F.lit("_"), F.lit("")))
    return c.select("id", F.coalesce("name", F.lit("")).alias("name"), L.masked(F.col("id")).alias("masked"), F.when(F.col("chunk_type") == "document", "article").otherwise(F.col("chunk_type")).alias("label"), F.when(depth <= 1, "easy").when(depth == 2, "medium").otherwise("hard").alias("difficulty")).distinct()


def theme_members(spark, d):
    """Modules of each theme with their files, in order."""
    f = _files(spark, d).where(~is_noise(F.col("module"))).select(L.theme(F.col("module")).alias("theme"), "module", "filename").distinct()
    return ranked_within(f, ["theme"], F.asc("module"), F.asc("filename")).select("theme", "place", "module", "filename")


def theme_sequences(spark, d):
    """Up to two call chains for each theme in which one of its modules takes part."""
    from ..operators.graph import call_paths

    paths = call_paths(load(spark, d, "call_edge"), 3)
    themes = paths.select("path", F.explode(F.array_distinct(F.transform(F.split("path", " -> "), lambda x: L.theme(F.split_part(x, F.lit("#"), F.lit(1)))))).alias("theme"))
    return ranked_within(themes, ["theme"], F.asc("path")).where("place <= 2").select("theme", "path", "place")


def build_artifacts(spark, d):
    """Repository paths that a build makes, by a folder or an ending."""
    f = _files(spark, d)
    folders = F.slice(F.split("filename", "/"), F.lit(1), F.size(F.split("filename", "/")) - 1)
    made = F.exists(folders, lambda x: x.isin(*ARTIFACT_FOLDERS)) | F.lower("filename").rlike(ARTIFACT_ENDINGS)
    return f.select("filename", made.alias("artifact")).distinct()


def answered(spark, d):
    """Answers that repeat the context of a question where they share two symbols at least, else refuse;
    an answer that fails has no sources and doesn't pass."""
    docs = _docs(spark, d).where("title is not null and text is not null")
    told = docs.select("doc_id", F.size(F.array_intersect(symbols(F.col("title")), symbols(F.col("text")))).alias("shared"), "doc_kind")
    return told.select("doc_id", (F.col("shared") >= 2).alias("grounded"), F.when(F.col("doc_kind") == "commit_note", "error").when(F.col("shared") >= 2, "context").otherwise("refused").alias("answer"), F.when((F.col("shared") >= 2) & (F.col("doc_kind") != "commit_note"), 1).otherwise(0).cast("long").alias("sources"))


def sections_by_id(spark, d):
    """The sections of documents whose heading several documents have."""
    from ..functions.text import heading_slug
    from ..operators.chunks import document_sections

    told = document_sections(_docs(spark, d), "doc_id", "text").select("doc_id", "section_no", heading_slug(F.col("heading")).alias("slug"))
    wanted = told.groupBy("slug").agg(F.count_distinct("doc_id").alias("k")).where("k > 1").select("slug")
    return told.join(wanted, "slug", "left_semi").select("doc_id", "section_no", "slug")


QUERIES = {f.__name__: f for f in (readme_source, project_docs, front_matter, front_matter_stripped, fences_stripped, next_reading, compilation, navigation, readme_hints, unknown_names, import_statements, named_calls, attributions, description_lines, description_matches, name_resolution, source_lookup, tree_order, all_chunks, cache_hits, cache_counts, graph_cache, manifest_changes, manifest_vanished, resume_pending, resume_stale, history_turns, versions_kept, record_counts, record_lookup, records_deleted, masked_ids, theme_members, theme_sequences, build_artifacts, answered, sections_by_id)}

TRIM = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
LN = "sf AS (SELECT file_id, string_split(replace(arg_max(content, scanned_at), chr(13), ''), chr(10)) AS a FROM source_file WHERE file_id IS NOT NULL GROUP BY 1), ln AS (SELECT file_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM sf)"
QUOTED = "q AS (SELECT doc_id, name FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '`([^`]*)`', 1), lambda x: trim(x, ' ')))) AS name FROM documents WHERE text IS NOT NULL) WHERE name <> '' AND (regexp_matches(name, '[/.\\\\]') OR NOT regexp_matches(name, '[^\\x00-\\x7f]')))"
ENDS = "list_transform(range(1, len(string_split({c}, '/')) + 1), lambda i: array_to_string(string_split({c}, '/')[i:], '/'))"
DESC = "ds AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), db AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+', ''), '[`*]', '', 'g') AS b FROM ds), dl AS (SELECT doc_id, line_no, regexp_extract(b, '^([A-Za-z_][\\w.]*)(?:\\(\\))?\\s*[:：]\\s*(\\S.*)$', 1) AS name, trim(regexp_extract(b, '^([A-Za-z_][\\w.]*)(?:\\(\\))?\\s*[:：]\\s*(\\S.*)$', 2), ' ') AS description FROM db)"
STATES = "first AS (SELECT path, min((mtime, size)) AS x FROM file_index WHERE path IS NOT NULL GROUP BY 1), newest AS (SELECT path, max((mtime, size)) AS x FROM file_index WHERE path IS NOT NULL GROUP BY 1), hits AS (SELECT path, f.x = n.x AS hit FROM newest n JOIN first f USING (path))"
SIGN = "'(' || array_to_string(coalesce({x}.params, []), ', ') || ')' || CASE WHEN coalesce({x}.return_type, '') <> '' THEN ' -> ' || {x}.return_type ELSE '' END"
MARKS = "CASE WHEN len({x}.decorators) > 0 THEN ' [decorators: ' || array_to_string({x}.decorators, ', ') || ']' ELSE '' END"
SECTIONS = "p AS (SELECT doc_id, string_split(chr(10) || text, chr(10) || '## ') AS a FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, unnest(range(2, len(a) + 1)) AS i, a FROM p), r AS (SELECT doc_id, i - 1 AS section_no, trim(split_part(a[i], chr(10), 1), ' ') AS heading, regexp_replace(CASE WHEN contains(a[i], chr(10)) THEN substring(a[i], instr(a[i], chr(10)) + 1) ELSE '' END, '^\\s+|\\s+$', '', 'g') AS body FROM q)"
SLUG = "regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
KEYS = "fk AS (SELECT DISTINCT module || '#' || f.name AS key FROM fn), ck AS (SELECT DISTINCT to_module || '#' || to_name AS key FROM call_edge)"
SQL = {
    "readme_source": "SELECT repo, arg_min(doc_id, doc_id) AS doc_id, least(arg_min(strlen(text), doc_id), 4000)::BIGINT AS bytes, arg_min(strlen(text), doc_id) > 4000 AS cut FROM documents WHERE repo IS NOT NULL AND doc_kind = 'readme' AND text IS NOT NULL GROUP BY repo",
    "project_docs": f"WITH o AS (SELECT repo, doc_id, {L.rules_sql([((w,), i) for i, w in enumerate(PRIORITY)], "contains(lower(coalesce(title, '')), '{w}')", repr(str(len(PRIORITY))))} AS priority, least(length(text), 3000)::BIGINT AS taken FROM documents WHERE repo IS NOT NULL AND doc_kind <> 'readme' AND text IS NOT NULL) SELECT repo, doc_id, taken, row_number() OVER (PARTITION BY repo ORDER BY priority, doc_id) AS place FROM o QUALIFY place <= 12",
    "front_matter": "WITH t AS (SELECT doc_id, repo, text, CASE WHEN coalesce(title, '') <> '' THEN title WHEN trim(regexp_extract(text, '(?m)^# (.+)$', 1), ' ') <> '' THEN trim(regexp_extract(text, '(?m)^# (.+)$', 1), ' ') ELSE 'doc-' || doc_id END AS name FROM documents WHERE text IS NOT NULL) SELECT doc_id, name AS shown_title, md5('---' || chr(10) || 'title: ' || name || chr(10) || 'project: ' || coalesce(repo, '') || chr(10) || '---' || chr(10) || chr(10) || text) AS md5 FROM t",
    "front_matter_stripped": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "fences_stripped": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "next_reading": "SELECT repo, doc_id, lag(doc_id) OVER w AS previous_doc, lead(doc_id) OVER w AS next_doc FROM documents WHERE repo IS NOT NULL WINDOW w AS (PARTITION BY repo ORDER BY doc_id)",
    "compilation": "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS place, doc_id, md5(chr(10) || chr(10) || regexp_replace(text, '(?m)^(#{1,5}) ', '\\1# ', 'g')) AS md5 FROM documents WHERE repo IS NOT NULL AND text IS NOT NULL",
    "navigation": "SELECT repo, doc_kind, CASE WHEN doc_kind IN ('readme', 'wiki_page') THEN 'easy' WHEN doc_kind IN ('answer', 'changelog') THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS articles, sum(greatest(1, length(regexp_replace(text, '[ \\n]', '', 'g')) // 400))::BIGINT AS minutes FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "readme_hints": f"WITH p AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10) || chr(10))))) AS paragraph_no, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, paragraph_no, {TRIM.format(t='p')} AS p FROM p), h AS (SELECT doc_id, paragraph_no, strlen(p) AS n FROM t WHERE p <> '' AND {' + '.join(f"contains(lower(p), '{w}')::INT" for w in L.ARCHITECTURE)} >= 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY paragraph_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM h) SELECT doc_id, paragraph_no, least(n, 800 - b)::BIGINT AS taken FROM r WHERE b <= 800 AND (b + n <= 800 OR 800 - b > 50)",
    "unknown_names": f"""WITH {DEF2}, {QUOTED}, paths AS (SELECT module AS path FROM f UNION SELECT filename FROM f), names AS (SELECT DISTINCT name FROM named UNION SELECT c.name FROM cl), whole AS (SELECT path AS t FROM paths UNION SELECT name FROM names),
      sg AS (SELECT DISTINCT string_split(path, '/') AS p FROM paths), si AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM sg), sk AS (SELECT p, i, unnest(range(i, len(p) + 1)) AS k FROM si), runs AS (SELECT array_to_string(p[i:k], '/') AS t FROM sk UNION SELECT name FROM names),
      a AS (SELECT DISTINCT name FROM q), e AS (SELECT name, unnest(list_append({ENDS.format(c='name')}, regexp_replace(name, '/\\*.*$', ''))) AS t FROM a),
      known AS (SELECT name FROM e WHERE t IN (SELECT t FROM whole) UNION SELECT name FROM a WHERE name IN (SELECT t FROM runs) UNION SELECT name FROM a WHERE contains(name, '/*') AND regexp_replace(name, '/\\*.*$', '') IN (SELECT t FROM runs)),
      r AS (SELECT doc_id, count(*) AS quoted, sum((name NOT IN (SELECT name FROM known))::BIGINT)::BIGINT AS unknown FROM q GROUP BY 1) SELECT *, unknown >= 8 OR (quoted > 3 AND unknown > 0.6 * quoted) AS flagged FROM r""",
    "import_statements": f"""WITH {LN}, s AS (SELECT file_id, line_no, {TRIM.format(t='line')} AS s FROM ln), x AS (SELECT *, regexp_extract(s, '.*\\sfrom\\s+(.*)$', 1) AS b, coalesce(nullif(regexp_extract(s, '"([^"]*)"', 1), ''), regexp_extract(s, '''([^'']*)''', 1)) AS q, regexp_split_to_array(s, '\\s+')[2] AS w FROM s),
      m AS (SELECT file_id, line_no, CASE WHEN starts_with(s, 'import') OR starts_with(s, 'export') THEN CASE WHEN b <> '' THEN regexp_replace(b, '[`''";]', '', 'g') WHEN starts_with(s, 'import') THEN q ELSE '' END WHEN starts_with(s, 'from ') THEN w WHEN starts_with(s, '#include') THEN regexp_replace(trim(substring(s, 9, 1000), ' '), '[<>"]', '', 'g') WHEN starts_with(s, 'using ') OR starts_with(s, 'use ') THEN regexp_replace(coalesce(w, ''), ';$', '') WHEN starts_with(s, 'require') THEN q END AS module FROM x)
      SELECT file_id, line_no, module, starts_with(module, '.') AS is_relative FROM m WHERE module <> ''""",
    "named_calls": f"WITH {DEF2}, {LN}, n AS (SELECT DISTINCT name FROM named WHERE length(name) >= 6), l AS (SELECT file_id, line_no, line FROM ln WHERE contains(line, '(')) SELECT name, count(*) AS lines FROM n JOIN l ON contains(line, name || '(') GROUP BY 1",
    "attributions": f"""WITH {FILES}, a AS (SELECT file_id, [filename, module, regexp_replace(regexp_replace(filename, '[^/]*$', ''), '/+$', '')] AS ps, '.' || regexp_extract(filename, '([^.]*)$', 1) AS ext FROM f), b AS (SELECT file_id, list_transform(list_filter(ps, lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '\\.[^./]*$') THEN p ELSE p || ext END) AS ps FROM a)
      SELECT file_id, array_to_string(list_transform(ps, lambda p: '<span class="source-ref" data-file="' || p || '"><strong>' || regexp_extract(p, '([^/]*)$', 1) || '</strong></span>'), '、') AS spans FROM b""",
    "description_lines": f"WITH {DESC} SELECT doc_id, line_no, name, description FROM dl WHERE name <> ''",
    "description_matches": f"WITH {DEF2}, t AS (SELECT split_part(to_module, '-', 1) || '.' || to_name AS name FROM call_edge UNION SELECT from_name FROM call_edge), n AS (SELECT DISTINCT name AS function FROM named) SELECT name, function, 1::BIGINT AS rule FROM t JOIN n ON name = function UNION ALL SELECT name, function, 2 FROM t JOIN n ON regexp_extract(name, '([^.]*)$', 1) = function WHERE name NOT IN (SELECT function FROM n)",
    "name_resolution": f"WITH {FILES}, a AS (SELECT to_module AS name FROM call_edge UNION SELECT regexp_extract(to_module, '([^/]*/[^/]*)$', 1) FROM call_edge WHERE contains(to_module, '/')), k AS (SELECT module, module AS name, 1 AS rule FROM f UNION ALL SELECT module, filename, 2 FROM f UNION ALL SELECT module, unnest({ENDS.format(c='module')}), 3 FROM f) SELECT name, arg_min(module, (rule, module)) AS module, min(rule)::BIGINT AS rule FROM a JOIN k USING (name) GROUP BY 1",
    "source_lookup": f"WITH {FILES}, a AS (SELECT DISTINCT to_module AS name FROM call_edge WHERE NOT contains(to_module, '..')), t AS (SELECT name, unnest(range(0, len(string_split(name, '/')))) AS priority, unnest({ENDS.format(c='name')}) AS t FROM a), k AS (SELECT module AS t, filename FROM f UNION ALL SELECT regexp_extract(module, '([^/]*)$', 1), filename FROM f) SELECT name, arg_min(filename, (priority, filename)) AS filename, min(priority)::BIGINT AS priority FROM t JOIN k USING (t) GROUP BY 1",
    "tree_order": f"WITH {LATEST}, p AS (SELECT string_split(filename, '/') AS p FROM fr), q AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p), t AS (SELECT DISTINCT array_to_string(p[1:i-1], '/') AS parent, array_to_string(p[1:i], '/') AS path, i = len(p) AS leaf FROM q) SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY leaf, path) AS place FROM t",
    "all_chunks": f"""WITH {CL}, sf AS (SELECT filename, string_split(replace(content, chr(13), ''), chr(10)) AS a FROM (SELECT * FROM source_file WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) = 1)),
      k AS (SELECT concat_ws('#', filename, c.name) AS id, 'class' AS chunk_type, filename, c.start_line AS b, c.end_line AS e, 'Class ' || c.name || CASE WHEN len(c.bases) > 0 THEN ' extends ' || array_to_string(c.bases, ', ') ELSE '' END || {MARKS.format(x='c')} || chr(10) || CASE WHEN len(c.methods) > 0 THEN 'Methods:' || chr(10) || array_to_string(list_transform(c.methods, lambda m: '- ' || m.name || {SIGN.format(x='m')}), chr(10)) || chr(10) ELSE '' END AS t FROM cl
        UNION ALL SELECT concat_ws('#', filename, f.name), 'function', filename, f.start_line, f.end_line, 'Function ' || f.name || {SIGN.format(x='f')} || {MARKS.format(x='f')} || chr(10) FROM fn),
      s AS (SELECT id, chunk_type, min((b, e)) AS x FROM k GROUP BY 1, 2), j AS (SELECT DISTINCT id, chunk_type, filename, t, x[1] AS b, x[2] AS e FROM k JOIN s USING (id, chunk_type)),
      w AS (SELECT id, chunk_type, CASE WHEN b > 0 AND e > b AND a IS NOT NULL THEN t || chr(10) || '```' || chr(10) || regexp_replace(array_to_string(a[b:least(e, b + 59, len(a))], chr(10)), '\\s+$', '') || chr(10) || '```' || chr(10) ELSE t END AS content FROM j LEFT JOIN sf USING (filename)
        UNION ALL SELECT filename || '#imports', 'import', 'File ' || filename || ' imports:' || chr(10) || array_to_string(list_transform(imports, lambda i: '- ' || CASE WHEN coalesce(i.name, '') = '' THEN i.module ELSE i.name || ' from ' || i.module END), chr(10)) || chr(10) FROM f WHERE len(imports) > 0
        UNION ALL SELECT filename || '#module', 'module', 'File: ' || filename || chr(10) FROM f WHERE coalesce(len(imports), 0) = 0 AND coalesce(len(classes), 0) = 0 AND coalesce(len(functions), 0) = 0)
      SELECT id, chunk_type, md5(content) AS md5 FROM w""",
    "cache_hits": f"WITH {STATES} SELECT path, hit FROM hits",
    "cache_counts": f"WITH {STATES} SELECT hit, count(*) AS files FROM hits GROUP BY 1",
    "graph_cache": f"WITH {STATES} SELECT split_part(path, '/', 1) AS repo, bool_and(hit) AS valid FROM hits GROUP BY 1",
    "manifest_changes": f"WITH {STATES} SELECT path, n.x[1] AS mtime, n.x[2] AS size, FALSE AS is_new FROM newest n JOIN first f USING (path) WHERE n.x <> f.x",
    "manifest_vanished": f"WITH {STATES} SELECT path FROM newest WHERE path NOT IN (SELECT filename FROM source_file WHERE filename LIKE '%.py' OR filename LIKE '%.ts')",
    "resume_pending": f"WITH {CL}, {KEYS} SELECT key FROM fk WHERE key NOT IN (SELECT key FROM ck)",
    "resume_stale": f"WITH {CL}, {KEYS} SELECT key FROM ck WHERE key NOT IN (SELECT key FROM fk)",
    "history_turns": "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY created_at NULLS FIRST, doc_id) AS turn, doc_id, md5('问：' || coalesce(title, '') || chr(10) || '答：' || text || chr(10) || chr(10)) AS md5 FROM documents WHERE repo IS NOT NULL AND doc_kind = 'answer' AND text IS NOT NULL",
    "versions_kept": "WITH v AS (SELECT DISTINCT repo, strftime(created_at, '%Y%m%d%H%M%S') AS version FROM documents WHERE repo IS NOT NULL AND created_at IS NOT NULL) SELECT repo, version, row_number() OVER (PARTITION BY repo ORDER BY version DESC) AS place FROM v QUALIFY place <= 10",
    "record_counts": "SELECT len(vector) AS dim, count(DISTINCT id) AS records FROM vectors WHERE vector IS NOT NULL AND id IS NOT NULL GROUP BY 1",
    "record_lookup": "SELECT DISTINCT id, id IN (SELECT id FROM vectors WHERE vector IS NOT NULL AND id IS NOT NULL) AS stored FROM chunk WHERE id IS NOT NULL",
    "records_deleted": "SELECT DISTINCT id FROM vectors WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM chunk WHERE chunk_type = 'document' AND id IS NOT NULL)",
    "masked_ids": "WITH c AS (SELECT DISTINCT id, chunk_type, coalesce(name, '') AS name FROM chunk WHERE id IS NOT NULL) SELECT DISTINCT id, name, CASE WHEN length(id) <= 8 THEN '****' ELSE substring(id, 1, 4) || '****' || right(id, 4) END AS masked, CASE WHEN chunk_type = 'document' THEN 'article' ELSE chunk_type END AS label, CASE WHEN length(name) - length(replace(name, '_', '')) <= 1 THEN 'easy' WHEN length(name) - length(replace(name, '_', '')) = 2 THEN 'medium' ELSE 'hard' END AS difficulty FROM c",
    "theme_members": f"WITH {FILES}, t AS (SELECT DISTINCT {L.rules_sql(L.THEMES, "contains(lower(module), '{w}')", "'" + L.OTHER_THEME + "'")} AS theme, module, filename FROM f WHERE NOT {NOISE.format(n='module')}) SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY module, filename) AS place, module, filename FROM t",
    "theme_sequences": PATHS + f", x AS (SELECT DISTINCT path, unnest(m) AS m FROM paths), t AS (SELECT DISTINCT path, {L.rules_sql(L.THEMES, "contains(lower(m), '{w}')", "'" + L.OTHER_THEME + "'")} AS theme FROM x) SELECT theme, path, row_number() OVER (PARTITION BY theme ORDER BY path) AS place FROM t QUALIFY place <= 2",
    "build_artifacts": f"WITH {FILES} SELECT DISTINCT filename, len(list_intersect(string_split(filename, '/')[:-2], {list(ARTIFACT_FOLDERS)})) > 0 OR regexp_matches(lower(filename), '{ARTIFACT_ENDINGS}') AS artifact FROM f",
    "answered": f"WITH s AS (SELECT doc_id, doc_kind, len(list_intersect({SYM.format(t='title')}, {SYM.format(t='text')})) AS shared FROM documents WHERE title IS NOT NULL AND text IS NOT NULL) SELECT doc_id, shared >= 2 AS grounded, CASE WHEN doc_kind = 'commit_note' THEN 'error' WHEN shared >= 2 THEN 'context' ELSE 'refused' END AS answer, (shared >= 2 AND doc_kind <> 'commit_note')::BIGINT AS sources FROM s",
    "sections_by_id": f"WITH {SECTIONS}, t AS (SELECT doc_id, section_no, {SLUG.format(t='heading')} AS slug FROM r WHERE body <> '') SELECT * FROM t WHERE slug IN (SELECT slug FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)",
}
