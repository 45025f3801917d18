"""Functions paired with their documentation (problem 7).

The generalised LL recogniser finds the functions: each is a derivation of its language's function
rules, tried wherever a declaration can begin, in files that are broken elsewhere too (see
grammar/islands.py). Its documentation is the comment that stands before the derivation's signature or
marks, in Python the string that its body begins with. Comments that parse as code are none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread
from .grammar.gll import BASE, INDENT
from .grammar.islands import Function, Reader, functions
from .grammar.languages import ALIASES, language
from .syntax import extension

COMMENT = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*")
LITERAL = re.compile(r"(?i)(?P<p>[rbuft]{0,2})(?P<q>\"\"\"|\'\'\'|\"|\')(?P<t>[\s\S]*)(?P=q)")
#: Line comments that document, by language.
LINES = {"go": "//", "rs": "///", "cpp": "///", "c": "///", "h": "///"}
# Headings of parameter lists, tags, and announcements of documentation to come.
SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|yields|throws|attributes|examples?|see also|notes?|todo)\s*:?\s*$", re.I)
TAG = re.compile(r"^\s*[@\\](?:param|tparam|arg|args|returns?|throws|exception|raises|type|template|see|since|author|version|deprecated|override|inheritdoc|todo)\b.*$|^\s*:(?:param|type|returns?|rtype|raises|arg)\b[^:]*:.*$", re.I)
ITEM = re.compile(r"^\s*(?:[-*+]\s+)?`?\*{0,2}[\w$]+\*{0,2}`?(?:\s*\([^)]*\))?\s*(?::|-|--|–)\s")
PENDING = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|hack)\b.*|(?:please )?(?:document|describe|explain) (?:me|this|it|that|here)\b.*|(?:no|missing) (?:docs?|documentation|docstring|description|comment)\b.*|(?:docs?|documentation|docstring|description|comments?)\s*(?:is|are|to|will|missing|pending|coming|goes|follows?|needed|required|here|not|still|later|soon|yet|tbd|todo|must|should|has yet|have yet)\b.*|(?:needs?|requires?|awaiting|waiting for|lacks?) (?:a |an |some |more |better |proper )?(?:docs?|documentation|docstring|description|comments?)\b.*"
    r"|(?:write|add|insert|put|fill in|provide|complete|update|finish)\b(?: \w+){0,4} (?:docs?|documentation|docstring|description|comments?)\b.*|(?:to be|will be|not yet|yet to be|still to be|needs to be|must be|should be) (?:documented|described|written|filled in|added)\b.*|(?:see|as) above\W*|same as above\W*|.*\b(?:to be documented|documentation to follow|docs to follow|description to follow|will be documented|will be described) ?(?:later|soon|here)?\W*)$",
    re.I | re.S,
)
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def prose(comment: str) -> str:
    """A documentation text without markup, tags and parameter lists."""
    out, listing = [], False
    for line in comment.replace("\r", "").split("\n"):
        if SECTION.match(line):
            listing = True
            continue
        if TAG.match(line):
            continue
        if listing:
            if not line.strip():
                listing = False
            elif ITEM.match(line) or line.startswith((" ", "\t")):
                continue
            else:
                listing = False
        if re.fullmatch(r"\s*[-=~*_#]{3,}\s*", line):
            continue
        out.append(line)
    text = "\n".join(out)
    text = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>", " ", text)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"```.*?(?:```|\Z)", " ", text, flags=re.S)
    return re.sub(r"[`*#>|]+", " ", text).strip()


def trivial(comment: str, name: str, least: int = 5) -> bool:
    """Whether a documentation text says nothing: empty, fewer than `least` words besides those of
    the function's name, or only an announcement."""
    return _empty(prose(comment), name, least)


def _empty(text: str, name: str, least: int = 5) -> bool:
    if not text or PENDING.match(re.sub(r"\s+", " ", text)):
        return True
    own = {w.lower() for w in SPLIT.findall(name)} | {name.lower()}
    return sum(w.lower() not in own for w in WORD.findall(text)) < least


def _is_code(comment: str, ext: str) -> bool:
    """Whether a comment's text is code of its language: it reads as statements, not as words."""
    text = comment.strip()
    if not re.search(r"[(){};=]", text) or not text:
        return False
    spoken = language(ext)
    wrapped = {"go": "package p\nfunc f() {\n%s\n}\n", "java": "class C { void f() {\n%s\n} }", "rs": "fn f() {\n%s\n}", "cpp": "void f() {\n%s\n}", "js": "function f() {\n%s\n}", "ts": "function f() {\n%s\n}"}.get(ALIASES.get(ext, ext))
    return bool(spoken and wrapped and spoken.accepts(wrapped % text))


def comment_in(gap: str, ext: str, at_line_start: bool) -> tuple[bool, str | None]:
    """(whether the gap before a token holds a comment, the text of its last one if that documents)."""
    found = list(COMMENT.finditer(gap))
    if not found:
        return False, None
    last = found[-1]
    line = gap.rfind("\n", 0, last.start()) + 1
    if gap[line : last.start()].strip() or line == 0 and not at_line_start or gap.count("\n", last.end()) > (1 if ext == "go" else 2):
        return True, None
    text = last.group(0)
    if not text.startswith("//"):
        if ext == "go" or not text.startswith("/**") or text.startswith("/***") or text == "/**/":
            return True, None
        return True, "\n".join(re.sub(r"^\s*\*\s?", "", x) for x in text[3:-2].split("\n"))
    mark = LINES.get(ext)
    if not mark or not text.startswith(mark) or mark == "///" and text.startswith("////"):
        return True, None
    body = [text]
    for m, after in zip(found[-2::-1], found[:0:-1]):
        # Lines of one comment follow each other without anything between them.
        start = gap.rfind("\n", 0, m.start()) + 1
        if not m.group(0).startswith(mark) or gap[m.end() : after.start()].strip(" \t\r") != "\n" or gap[start : m.start()].strip() or start == 0 and not at_line_start:
            break
        body.append(m.group(0))
    lines = [x[len(mark) :].rstrip("\r") for x in reversed(body)]
    if ext == "go":
        lines = [x for x in lines if not re.match(r"go:\w+|nolint\b|export \w", x)]
    return True, "\n".join(x[1:] if x.startswith(" ") else x for x in lines)


def _above(text: str, f: Function, ext: str) -> str | None:
    """The documentation before a signature, or before the marks above it."""
    for i in range(f.signature, f.first - 1, -1):
        begin = f.level.before(i)
        some, doc = comment_in(text[begin : f.level.start(i)], ext, begin == 0 or text[begin - 1] == "\n")
        if some:
            return doc
    return None


def _docstring(text: str, f: Function, spoken) -> str | None:
    """The string that a Python function's body begins with."""
    level, stop = f.level, f.end
    last = level.tokens[stop - 1]
    if last >= BASE and spoken.recogniser.kinds[last - BASE] == INDENT:
        level, i = level.below[stop - 1], 0
        stop = len(level.tokens)
    else:
        colon = spoken.terms(":")
        i = next((k + 1 for k in range(f.name, stop) if level.tokens[k] == colon), stop)
    out = []
    while i < stop and level.tokens[i] == spoken.str:
        m = LITERAL.fullmatch(text[level.start(i) : level.end(i)])
        if not m or set(m["p"].lower()) & set("bft"):
            return None
        out.append(m["t"])
        i += 1
    ends = {spoken.nl, spoken.semi}
    return "".join(out) if out and (i >= stop or level.tokens[i] in ends) else None


def documented(text: str, ext: str) -> list[dict]:
    """Every function of a text with documentation that isn't trivial: name, start_line (of the
    signature, from 1), end_line, doc, code, hash (of the description's words), parses."""
    ext = ALIASES.get(ext, ext)
    spoken = language(ext)
    if spoken is None:
        return []
    text = text.replace("\r\n", "\n")
    rows = Reader(spoken, text)
    out = []
    for f in functions(spoken, text, rows):
        level = f.level
        doc = _docstring(text, f, spoken) if spoken.mode == "py" else _above(text, f, ext)
        if doc is None:
            continue
        name = text[level.start(f.name - 1) : level.end(f.name - 1)]
        said = prose(doc)
        if _empty(said, name) or spoken.mode != "py" and _is_code(doc, ext):
            continue
        first, end = rows.row(level.start(f.signature)), level.end(f.end - 1)
        words = re.sub(r"\W+", " ", said.lower())
        out.append(
            {"name": name, "start_line": first + 1, "end_line": rows.row(max(0, end - 1)) + 1, "doc": doc, "code": text[rows.rows[first] : end], "hash": int.from_bytes(hashlib.blake2b(words.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True), "parses": f.valid}
        )
    return out


def documented_functions(files: DataFrame, symbols: DataFrame, template_share: float = 0.001) -> DataFrame:
    """(file_id, start_line, end_line, name, doc, code, parses) of functions and methods with
    documentation that isn't trivial.

    files has file_id, filename, content and scanned_at, symbols file_id, classes, functions and
    scanned_at; of each the latest delivery counts. The grammar extracts functions; symbols only says
    which of them are asked for, by the line of their signature. A description that more than
    `template_share` of all documented functions share, ten at least and with five different names, is
    a template; these are dropped. parses is false where only the head of a function is valid. Null
    texts, lists and lines give no rows; equal (file_id, start_line) come out once; empty tables and
    other languages give none; other columns are ignored.
    """
    at = lambda c: F.coalesce(F.col(c), F.lit("1900-01-01").cast("timestamp"))
    lines = lambda c: F.transform(c, lambda x: x["start_line"].cast("int"))
    none = F.array().cast("array<int>")
    listed = symbols.where("file_id is not null").select(
        "file_id", F.concat(F.coalesce(lines("functions"), none), F.coalesce(F.flatten(F.transform(F.filter("classes", lambda c: c["methods"].isNotNull()), lambda c: lines(c["methods"]))), none)).alias("lines"), at("scanned_at").alias("at")
    )
    listed = listed.groupBy("file_id").agg(F.max_by("lines", "at").alias("lines")).select("file_id", F.explode("lines").alias("start_line")).distinct()
    texts = spread(files.where("file_id is not null and content is not null and filename is not null").select("file_id", extension(F.col("filename")).alias("ext"), "content", at("scanned_at").alias("seen")))
    fields = [("start_line", pa.int32()), ("end_line", pa.int32()), ("name", pa.string()), ("doc", pa.string()), ("code", pa.string()), ("hash", pa.int64()), ("parses", pa.bool_())]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            whose: list[int] = []
            for k, (ext, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                # A row of its own says that this delivery was seen, whatever it holds.
                found = [{n: None for n, _ in fields}, *documented(text, ext)]
                rows += found
                whose += [k] * len(found)
            taken = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(3).take(taken), *(pa.array([r[n] for r in rows], t) for n, t in fields)], ["file_id", "seen", *(n for n, _ in fields)])

    key_type = texts.schema["file_id"].dataType.simpleString()
    # Texts are parsed where they are read, once: the counts below read the pairs again.
    pairs = cut_lineage(texts.mapInArrow(extract, f"file_id {key_type}, seen timestamp, start_line int, end_line int, name string, doc string, code string, hash long, parses boolean"))
    newest = pairs.groupBy("file_id").agg(F.max("seen").alias("seen"))
    pairs = pairs.where("start_line is not null").join(newest, ["file_id", "seen"], "left_semi").join(listed, ["file_id", "start_line"], "left_semi").dropDuplicates(["file_id", "start_line"])
    counts = pairs.groupBy("hash", "name").agg(F.count("*").alias("k")).groupBy("hash").agg(F.sum("k").alias("k"), F.count("*").alias("names"))
    total = counts.agg(F.sum("k").alias("total"))
    templates = counts.where("k >= 10 and names >= 5").crossJoin(F.broadcast(total)).where(F.col("k") > template_share * F.col("total")).select("hash")
    return pairs.join(templates, "hash", "left_anti").select("file_id", "start_line", "end_line", "name", "doc", "code", "parses")
