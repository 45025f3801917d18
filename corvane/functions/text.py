"""Column builders for names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of graph roles and their weights.
ENTRY, CORE, BUSINESS, SUPPORT, UTILITY, ALONE = "入口层", "核心领域", "业务模块", "支撑模块", "工具库", "独立模块"
ROLE_WEIGHT = {ENTRY: 1.0, CORE: 1.0, BUSINESS: 0.6, UTILITY: 0.3, SUPPORT: 0.3}
# Languages by file extension, and the scan's extensions and skipped folders.
LANGUAGE_OF = {"py": "Python", "js": "JavaScript/TypeScript", "ts": "JavaScript/TypeScript", "tsx": "JavaScript/TypeScript", "go": "Go", "java": "Java", "rs": "Rust", "cpp": "C/C++", "cc": "C/C++", "c": "C/C++", "h": "C/C++", "hpp": "C/C++"}
EXTENSIONS = ("py", "js", "ts", "tsx", "go", "java", "rs", "cpp", "cc", "h", "hpp", "c")
SKIPPED = ("node_modules", "__pycache__", "vendor", "dist", "build", "out", "testdata", "test", "tests", "__tests__", "spec", "fixtures")


def module_name(path: Column) -> Column:
    """The path without its extension, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^./]*$", "")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def top_directory(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_noise(module: Column) -> Column:
    """Tests, test data and debugging scripts."""
    return module.endswith("_test") | (module.contains("testdata") & ~module.contains("testdata/repos/")) | module.contains("scripts/debug")


def heading_slug(text: Column) -> Column:
    """Letters and digits, all else as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def chunk_slug(text: Column) -> Column:
    """Blanks and slashes as dashes, ASCII word characters only."""
    kept = F.lower(F.regexp_replace(F.translate(text, " /", "--"), "[^A-Za-z0-9_-]", ""))
    return F.when(text == "", "top").when(kept == "", "section").otherwise(kept)


def snippet(text: Column, n: int = 120) -> Column:
    """One line of at most n characters."""
    flat = F.replace(F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def reading_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.regexp_replace(text, "[ \n]", "")) / 400).cast("int"))


def signature(name: Column, params: Column, returns: Column) -> Column:
    head = F.concat(name, F.lit("("), F.array_join(F.coalesce(params, F.array()), ", "), F.lit(")"))
    return F.when(F.coalesce(returns, F.lit("")) != "", F.concat(head, F.lit(" -> "), returns)).otherwise(head)


def camel_words(name: Column) -> Column:
    """Lower-case words; each capital begins one."""
    return F.filter(F.transform(F.regexp_extract_all(name, F.lit("([A-Z]?[^A-Z]*)"), 1), F.lower), lambda w: w != "")


def symbols(text: Column) -> Column:
    """The set of lower-case words, their parts between underscores and their runs of letters."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.split(w, "_"), F.regexp_extract_all(w, F.lit("([a-z]+)"), 1))))
    return F.filter(F.array_distinct(parts), lambda w: w != "")


def join_comma(values: Column) -> Column:
    return F.array_join(values, ", ")
