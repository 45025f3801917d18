"""Symbols from source text: one pass over the lines of a file, per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

FUNCTION = "struct<name:string,params:array<string>,return_type:string,decorators:array<string>,start_line:int,end_line:int>"
SCHEMA = f"classes array<struct<name:string,bases:array<string>,methods:array<{FUNCTION}>,decorators:array<string>,start_line:int,end_line:int>>, functions array<{FUNCTION}>, imports array<struct<module:string,name:string,is_relative:boolean>>"

_A = re.ASCII
# What a definition looks like at its first line, after the grammar of each language: words before the
# name in any order, the name, type parameters, then bases or parameters, brackets one level deep.
_NAME = r"[^\W\d]\w*"
_NESTED = r"(?:[^()]|\([^()]*\))*"
CLASS = {
    "py": re.compile(rf"class[ \t]+(?P<n>{_NAME})[ \t]*(?:\[[^\]]*\])?[ \t]*(?:\((?P<b>{_NESTED})\))?[ \t]*:", _A),
    "js": re.compile(r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?:class|interface|enum)\s+(?P<n>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<b>[\w$.,\s]+?))?(?:\s+implements\s+[^{]+)?\s*\{", _A),
    "go": re.compile(r"type\s+(?P<n>\w+)\s+(?:struct|interface)\b", _A),
    "java": re.compile(r"(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<n>\w+)(?:<[^{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<b>[\w.,<>\s]+?))?(?:\s+implements\s+[^{]+)?\s*\{", _A),
    "rs": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<n>\w+)", _A),
    "cpp": re.compile(r"(?:class|struct)\s+(?P<n>\w+)(?:\s+final)?(?:\s*:\s*(?P<b>[^{;]+))?\s*(?:\{|$)", _A),
}
DEF = {
    "py": re.compile(r"(?:async\s+)?def\s+(?P<n>\w+)\s*\((?P<p>.*?)\)?\s*(?:->\s*(?P<r>[^:]+?))?\s*:?\s*(?:#.*)?$", _A),
    "js": re.compile(r"(?:(?:export|default|declare|async)\b\s*)*function\b\s*\*?\s*(?P<n>[\w$]+)\s*(?:<[^(]*>)?\s*\((?P<p>[^)]*)\)?\s*(?::\s*(?P<r>[^{]+?))?\s*\{?\s*$", _A),
    "go": re.compile(r"func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)(?:\[[^\]]*\])?\s*\((?P<p>[^)]*)\)\s*(?P<r>[^{]*?)\s*\{?\s*$", _A),
    "java": re.compile(r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]+>\s+)?(?P<r>[\w.<>\[\],?]+)\s+(?P<n>\w+)\s*\((?P<p>[^)]*)\)?", _A),
    "rs": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+(?P<n>\w+)\s*(?:<[^(]*>)?\((?P<p>[^)]*)\)?\s*(?:->\s*(?P<r>[^{;]+?))?\s*(?:where.*)?[{;]?\s*$", _A),
    "cpp": re.compile(r"(?:(?:static|inline|virtual|constexpr|explicit)\s+)*(?P<r>(?:const\s+)?[\w:<>,]+(?:\s*[*&]+)?)\s+(?P<o>\w+::)?(?P<n>~?\w+)\s*\((?P<p>[^;{]*?)\)\s*(?:const|noexcept|override|final|\s)*\{?\s*$", _A),
}
METHOD = re.compile(r"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?(?P<n>#?[\w$]+)\s*(?:<[^(]*>)?\((?P<p>[^)]*)\)\s*(?::\s*(?P<r>[^{]+?))?\s*\{\s*$", _A)
ARROW = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\((?P<p>[^)]*)\)|(?P<q>[\w$]+))\s*(?::\s*(?P<r>[^=]+?))?\s*=>", _A)
IMPL = re.compile(r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>,\s&']+?\s+for\s+)?(?P<n>\w+)", _A)
NOT_NAMES = frozenset("if for while switch catch return else do new throw sizeof function match constructor".split())
MARK = {"py": re.compile(r"@([\w.]+)"), "java": re.compile(r"@(\w+)(?!\s*interface)"), "js": re.compile(r"@([\w.]+)")}
KIND = {"py": "py", "pyi": "py", "js": "js", "ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "go": "go", "java": "java", "rs": "rs", "cpp": "cpp", "cc": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp"}
LITERALS = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|//[^\n]*|/\*.*?\*/', re.S)
PY_LITERALS = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*', re.S)


def blank_literals(text: str, kind: str) -> str:
    """The text with strings and comments emptied, its lines kept."""
    return (PY_LITERALS if kind == "py" else LITERALS).sub(lambda m: (m.group(0)[:1] if m.group(0)[0] in "\"'`" else "") + "\n" * m.group(0).count("\n") + (m.group(0)[-1:] if m.group(0)[0] in "\"'`" else ""), text)


def parameters(text: str, kind: str) -> list[str]:
    """Names of a parameter list; commas inside of brackets don't separate."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append(text[last:i])
            last = i + 1
    parts.append(text[last:])
    out = []
    for p in parts:
        p = p.strip().split("=")[0].strip()
        if not p:
            continue
        if kind in ("py", "js", "rs"):
            p = p.split(":")[0].strip() if not p.startswith("{") else p
            p = re.sub(r"^(?:public|private|protected|readonly|mut)\s+", "", p).rstrip("?")
        elif kind == "go":
            p = p.split()[0]
        else:
            p = re.sub(r"\[\s*\d*\s*\]$", "", p).split()[-1].lstrip("*&.")
        if p:
            out.append(p)
    return out


def imports_of(text: str, kind: str) -> list[tuple[str, str, bool]]:
    """(module, name, is relative) in the order of the text."""
    out: list[tuple[str, str, bool]] = []

    def names(spec: str, module: str) -> None:
        for part in re.sub(r"[(){}\\\n]", " ", spec).split(","):
            words = part.split()
            if words:
                out.append((module, words[-1], module.startswith(".")))

    if kind == "py":
        for m in re.finditer(r"(?m)^[ \t]*(?:from[ \t]+(\S+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]+)|import[ \t]+([^\n#]+))", text):
            if m.group(1):
                names(m.group(2), m.group(1))
            else:
                for part in m.group(3).split(","):
                    words = part.split()
                    if words:
                        out.append((words[0], words[-1] if len(words) > 2 else words[0].rpartition(".")[2], False))
    elif kind == "js":
        for m in re.finditer(r"(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?(?:([^'\";]*?)\s+from\s+)?['\"]([^'\"]+)['\"]", text):
            module, spec = m.group(2), m.group(1) or ""
            inner = re.search(r"\{([^}]*)\}", spec)
            before = re.sub(r"\{[^}]*\}", "", spec).strip(" ,")
            if before:
                names(before, module)
            if inner:
                names(inner.group(1), module)
            if not spec:
                out.append((module, "", module.startswith(".")))
    elif kind == "go":
        for m in re.finditer(r"(?m)^import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", text):
            for path in re.findall(r'"([^"]+)"', m.group(1)) if m.group(1) else [m.group(2)]:
                out.append((path, "", False))
    elif kind == "java":
        for m in re.finditer(r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", text):
            out.append((m.group(1), "*" if m.group(2) else m.group(1).rpartition(".")[2], False))
    elif kind == "rs":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub\s+)?use\s+([^;]+);", text):
            path = m.group(1).strip()
            out.append((path.partition("::{")[0], path.rpartition("::")[2].strip("{} "), path.startswith(("self", "super", "crate"))))
    else:
        for m in re.finditer(r"(?m)^[ \t]*#\s*include\s*([<\"])([^>\"]+)", text):
            out.append((m.group(2), "", m.group(1) == '"'))
    return out


def parse(filename: str, text: str) -> dict:
    """Classes with methods, functions and imports of one file; other languages give empty lists."""
    kind = KIND.get(filename.rpartition(".")[2].lower())
    if kind is None:
        return {"classes": [], "functions": [], "imports": []}
    text = text.replace("\r\n", "\n")
    lines = blank_literals(text, kind).split("\n")
    classes: list[dict] = []
    functions: list[dict] = []
    by_name: dict[str, dict] = {}
    open_: list[tuple[int, dict | None]] = []  # (indentation or depth, class or None for a function)
    marks: list[str] = []
    depth = 0
    for number, line in enumerate(lines, 1):
        body = line.strip()
        if not body:
            continue
        at = len(line) - len(line.lstrip()) if kind == "py" else depth
        while open_ and at <= open_[-1][0]:
            open_.pop()
        owner = open_[-1][1] if open_ else None
        mark = MARK[kind].match(body) if kind in MARK else None
        if mark and body[0] == "@":
            marks.append(mark.group(1))
            rest = body[mark.end() :].strip()
            if not rest or rest[0] == "(":
                depth += 0 if kind == "py" else body.count("{") - body.count("}")
                continue
        made = None
        m = CLASS[kind].match(body)
        if m:
            bases = [re.sub(r"^(?:public|private|protected|virtual)\s+", "", b.strip()) for b in (m.groupdict().get("b") or "").split(",")]
            made = {"name": m["n"], "bases": [b for b in bases if b and "=" not in b], "methods": [], "decorators": marks, "start_line": number, "end_line": 0}
            classes.append(made)
            by_name.setdefault(m["n"], made)
            open_.append((at, made))
        elif kind == "rs" and (i := IMPL.match(body)):
            made = by_name.get(i["n"])
            if made is None:
                made = by_name[i["n"]] = {"name": i["n"], "bases": [], "methods": [], "decorators": marks, "start_line": number, "end_line": 0}
                classes.append(made)
            open_.append((at, made))
        else:
            inside = bool(open_) and open_[-1][1] is None
            m = None if inside and kind != "py" else DEF[kind].match(body)
            if not m and kind == "js" and owner is not None:
                m = METHOD.match(body)
            if not m and kind == "js" and not inside:
                m = ARROW.match(body)
            if m and (kind in ("py", "rs", "go") or m["n"] not in NOT_NAMES) and not (kind == "cpp" and (m["r"] in NOT_NAMES or m["r"] in ("else", "return"))):
                given = m["p"] if m["p"] is not None else m.groupdict().get("q") or ""
                returns = re.sub(r"\s+", " ", (m["r"] or "").strip())
                made = {"name": m["n"], "params": parameters(given, kind), "return_type": returns, "decorators": marks, "start_line": number, "end_line": 0}
                home = owner
                if kind == "cpp" and m["o"]:
                    home = by_name.get(m["o"][:-2])
                (home["methods"] if home is not None and not inside else functions).append(made)
                open_.append((at, None))
        marks = []
        if kind != "py":
            depth += body.count("{") - body.count("}")
    _fill_ends(classes, functions, len(lines))
    return {"classes": classes, "functions": functions, "imports": [{"module": a, "name": b, "is_relative": c} for a, b, c in imports_of(text, kind)]}


def _fill_ends(classes: list[dict], functions: list[dict], total: int) -> None:
    """Top-level items end before the next one starts, methods before the next or with their class."""
    tops = sorted(classes + functions, key=lambda x: x["start_line"])
    for item, after in zip(tops, [*tops[1:], None]):
        item["end_line"] = max(item["start_line"], after["start_line"] - 1 if after else total)
    for c in classes:
        methods = sorted(c["methods"], key=lambda x: x["start_line"])
        for item, after in zip(methods, [*methods[1:], None]):
            item["end_line"] = max(item["start_line"], after["start_line"] - 1 if after else c["end_line"])


def parse_files(df: DataFrame, key: str, filename: str, text: str) -> DataFrame:
    """(key, filename, classes, functions, imports) of every file with a name and a text."""
    rows = df.where(F.col(filename).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(filename).alias("filename"), F.col(text).alias("text"))
    rows = spread(rows)
    key_type = rows.schema["key"].dataType.simpleString()
    fn = pa.struct([("name", pa.string()), ("params", pa.list_(pa.string())), ("return_type", pa.string()), ("decorators", pa.list_(pa.string())), ("start_line", pa.int32()), ("end_line", pa.int32())])
    cl = pa.struct([("name", pa.string()), ("bases", pa.list_(pa.string())), ("methods", pa.list_(fn)), ("decorators", pa.list_(pa.string())), ("start_line", pa.int32()), ("end_line", pa.int32())])
    im = pa.struct([("module", pa.string()), ("name", pa.string()), ("is_relative", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(n, t) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.list_(t)) for k, t in (("classes", cl), ("functions", fn), ("imports", im)))], ["key", "filename", "classes", "functions", "imports"]
            )

    return rows.mapInArrow(run, f"key {key_type}, filename string, {SCHEMA}").withColumnRenamed("key", key)
