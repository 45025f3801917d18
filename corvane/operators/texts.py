"""Operations on documents and source lines: front matter, budgets, attributions, names in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import ARCHITECTURE


def title_of(title: Column, text: Column, name: Column) -> Column:
    """The given title, else the first heading of the first level, else the name."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1))
    return F.when(F.coalesce(title, F.lit("")) != "", title).when(heading != "", heading).otherwise(name)


def with_front_matter(text: Column, title: Column, project: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\nproject: "), F.coalesce(project, F.lit("")), F.lit("\n---\n\n"), text)


def without_front_matter(text: Column) -> Column:
    """The text behind a block between two lines of dashes at its start."""
    return F.regexp_replace(text, r"\A---\n(?:[^\n]*\n)*?---\n\n?", "")


def without_fence(text: Column) -> Column:
    """What stands inside of a fence that encloses the whole text."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\A```[A-Za-z]*\n", ""), r"\n```\z", "")


def hints(docs: DataFrame, key: str, text: str, budget: int = 800, least: int = 50) -> DataFrame:
    """(key, paragraph_no, taken): the paragraphs that name two words of architecture or more, within a
    budget of bytes; the one that crosses it is cut if more than `least` bytes are left, and ends the
    list. A text's paragraphs are ordered within the text alone."""
    parts = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n\n")).alias("paragraph_no", "p")).withColumn("p", F.regexp_replace("p", r"^\s+|\s+$", ""))
    low = F.lower("p")
    named = sum((low.contains(w).cast("int") for w in ARCHITECTURE[1:]), low.contains(ARCHITECTURE[0]).cast("int"))
    told = parts.where((F.col("p") != "") & (named >= 2)).select(key, F.col("paragraph_no").cast("long").alias("paragraph_no"), F.octet_length("p").cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("paragraph_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = told.withColumn("before", before).where(F.col("before") <= budget)
    return run.where((F.col("before") + F.col("n") <= budget) | (budget - F.col("before") > least)).select(key, "paragraph_no", F.least(F.col("n"), budget - F.col("before")).alias("taken"))


def import_statements(lines: DataFrame, text: str) -> DataFrame:
    """Adds (module, is_relative) to source lines that import something: what stands behind the last
    `from`, else the first quoted text, else the second word; a leading dot makes it relative."""
    said = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    clean = lambda x: F.regexp_replace(x, "[`'\";]", "")
    behind = F.regexp_extract(said, r".*\sfrom\s+(.*)$", 1)
    quoted = F.coalesce(F.nullif(F.regexp_extract(said, '"([^"]*)"', 1), F.lit("")), F.regexp_extract(said, "'([^']*)'", 1))
    second = F.regexp_replace(F.coalesce(F.get(F.split(said, r"\s+"), F.lit(1)), F.lit("")), ";$", "")
    module = (
        F.when(said.startswith("import") | said.startswith("export"), F.when(behind != "", clean(behind)).when(said.startswith("import"), quoted).otherwise(""))
        .when(said.startswith("from "), F.get(F.split(said, r"\s+"), F.lit(1)))
        .when(said.startswith("#include"), F.regexp_replace(F.trim(F.substring(said, 9, 1000)), '[<>"]', ""))
        .when(said.startswith("using ") | said.startswith("use "), second)
        .when(said.startswith("require"), quoted)
    )
    return lines.withColumn("module", module).where("module <> ''").withColumn("is_relative", F.col("module").startswith("."))


def named_calls(lines: DataFrame, names: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, name): every line that has a known name directly before a parenthesis, also as the end of
    a longer word. The ends of words are rows, so that no line meets every name."""
    words = lines.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_$]+)\("), 1))).alias("w"))
    ends = words.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.expr("w").substr(i, F.length("w")))).alias("name"))
    return ends.join(names.select("name").distinct(), "name").select(*keys, "name").distinct()


def path_runs(path: Column) -> Column:
    """Every run of neighbouring segments of a path, as one text."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/")))))


def path_ends(path: Column) -> Column:
    """A path, and what is left of it after each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def quoted_names(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name): distinct backquoted names of texts that look like code: with a slash, backslash or
    dot, or of ASCII only."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("`([^`]*)`"), 1), F.trim))).alias("name"))
    return rows.where((F.col("name") != "") & (F.col("name").rlike(r"[/.\\]") | ~F.col("name").rlike(r"[^\x00-\x7f]")))


def unknown_names(quoted: DataFrame, key: str, paths: DataFrame, names: DataFrame) -> DataFrame:
    """(key, quoted, unknown, flagged): how many of a text's names are known: as a name, as a run of
    segments of a path, as a path that ends in a known one, or with `/*` after such a run. Flagged are
    eight unknown ones, or more than six tenths of more than three."""
    runs = paths.select(F.explode(path_runs(F.col("path"))).alias("name")).union(names.select("name")).distinct().withColumn("known", F.lit(True))
    asked = quoted.select("name").distinct()
    tried = asked.select("name", F.explode(F.array_distinct(F.concat(path_ends(F.col("name")), F.array(F.regexp_replace("name", r"/\*.*$", ""))))).alias("try"))
    # The ends of a name only count if they are whole known paths, a run of segments if it is the name.
    whole = paths.select(F.col("path").alias("try")).union(names.select("name")).distinct()
    by_end = tried.join(whole, "try", "left_semi").select("name")
    by_run = tried.where((F.col("try") == F.col("name")) | (F.concat("try", F.lit("/*")) == F.regexp_replace("name", r"/\*.*$", "/*"))).join(runs.select(F.col("name").alias("try")), "try", "left_semi").select("name")
    known = by_end.union(by_run).distinct().withColumn("known", F.lit(True))
    per = quoted.join(known, "name", "left").groupBy(key).agg(F.count("*").alias("quoted"), F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("unknown"))
    return per.withColumn("flagged", (F.col("unknown") >= 8) | ((F.col("quoted") > 3) & (F.col("unknown") > 0.6 * F.col("quoted"))))


def attribution(text: Column) -> Column:
    """The paths of a source attribution: separated by commas of any kind, without brackets."""
    parts = F.split(F.regexp_replace(text, "、|，|, ?", "\u0001"), "\u0001")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"^\[|\]$", ""), "[/\\]]+$", "")))
    return F.filter(clean, lambda p: p != "")


def source_spans(paths: Column, extension: Column) -> Column:
    """Clickable spans of paths; one without an extension gets the given one."""
    full = F.transform(paths, lambda p: F.when(p.rlike(r"\.[^./]*$"), p).otherwise(F.concat(p, extension)))
    return F.array_join(F.transform(full, lambda p: F.concat(F.lit('<span class="source-ref" data-file="'), p, F.lit('"><strong>'), F.regexp_extract(p, "([^/]*)$", 1), F.lit("</strong></span>"))), "、")


def descriptions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, name, description) of lines `name: text`, list marks and emphasis removed."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)])\s+", ""), r"[`*]", "")
    told = lines.select(key, (F.col("no") + 1).cast("long").alias("line_no"), F.regexp_extract(bare, r"^([A-Za-z_][\w.]*)(?:\(\))?\s*[:：]\s*(\S.*)$", 1).alias("name"), F.trim(F.regexp_extract(bare, r"^([A-Za-z_][\w.]*)(?:\(\))?\s*[:：]\s*(\S.*)$", 2)).alias("description"))
    return told.where("name <> ''")
