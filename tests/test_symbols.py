"""Parsers and chunkers on small sources."""

from corvane.operators import chunks, parsing
from corvane.operators.render import markdown_html, validate_diagrams


def test_python_symbols():
    got = parsing.parse("a/b.py", 'import os\nfrom ..models.user import User as U, Other\n\n@dataclass\nclass Repo(Base, Mixin):\n    @classmethod\n    def make(cls, a: int, b=2) -> "Repo":\n        def inner(): pass\n        return cls()\n\nasync def main(argv):\n    """def not_me(): pass"""\n')
    assert got["imports"] == [{"module": "os", "name": "os", "is_relative": False}, {"module": "..models.user", "name": "U", "is_relative": True}, {"module": "..models.user", "name": "Other", "is_relative": True}]
    (c,) = got["classes"]
    assert (c["name"], c["bases"], c["decorators"], c["start_line"]) == ("Repo", ["Base", "Mixin"], ["dataclass"], 5)
    assert [(m["name"], m["params"], m["decorators"]) for m in c["methods"]] == [("make", ["cls", "a", "b"], ["classmethod"])]
    assert [f["name"] for f in got["functions"]] == ["inner", "main"]


def test_script_symbols():
    got = parsing.parse("x.ts", "import React, { useState as s } from 'react';\nexport class Card extends Base {\n  render(a: string, {b, c}: P): Node {\n    if (a) { call(a); }\n  }\n}\nexport const load = async (id: string) => {\n  return get(id);\n};\nfunction plain(x) {\n}\n")
    assert [(i["module"], i["name"]) for i in got["imports"]] == [("react", "React"), ("react", "s")]
    assert [m["name"] for m in got["classes"][0]["methods"]] == ["render"]
    assert [(f["name"], f["params"]) for f in got["functions"]] == [("load", ["id"]), ("plain", ["x"])]


def test_other_languages():
    go = parsing.parse("x.go", 'package p\n\nimport (\n\t"a/b"\n)\n\ntype Store struct {\n}\n\nfunc (s *Store) Get(key string, n int) (int, error) {\n\treturn 0, nil\n}\n')
    assert go["imports"][0]["module"] == "a/b" and go["functions"][0]["params"] == ["key", "n"] and go["classes"][0]["name"] == "Store"
    rust = parsing.parse("x.rs", "pub struct P;\nimpl P {\n    pub fn new(a: u32) -> Self {\n        P\n    }\n}\n")
    assert [m["name"] for m in rust["classes"][0]["methods"]] == ["new"]
    java = parsing.parse("X.java", "import java.util.List;\npublic class X extends Y {\n    public String get(int a) {\n        return f(a);\n    }\n}\n")
    assert java["classes"][0]["bases"] == ["Y"] and java["classes"][0]["methods"][0]["params"] == ["a"]
    assert parsing.parse("x.txt", "def a(): pass") == {"classes": [], "functions": [], "imports": []}


def test_document_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n## One two\nbody\n\n## Empty\n\n## Ö\n" + "x" * 900), (2, "no heading"), (3, None)], "no int, text string")
    got = {r["section_no"]: r for r in chunks.document_sections(docs, "no", "text").collect()}
    assert set(got) == {1, 3} and got[1]["id"] == "wiki/1#one-two" and got[1]["content"] == "body"
    assert got[3]["id"] == "wiki/1#section" and len(got[3]["content"]) == 803


def test_diagram_errors(spark):
    texts = [
        "graph TD\n  a[x] --> b[y]\n  subgraph s\n  end\n", "", "hello\n\ngraph LR\na --> b", "graph TD\n a[x --> b", "flowchart LR\nend\nsubgraph x", "classDiagram\n class A {\n}\n}\n class B {", "graph TD\n --> b\n a -->", None, "sequenceDiagram\n a->>b: (x", "%% note\ngraph TD\n}\n{\n}\n}",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, text string")
    got = {}
    for r in validate_diagrams(df, "no", "text").collect():
        got.setdefault(r["no"], set()).add((r["line"], r["message"]))
    assert got == {
        1: {(0, "empty diagram")}, 2: {(1, "unrecognized diagram type")}, 3: {(2, "unclosed node bracket")}, 4: {(2, "unmatched 'end' for subgraph"), (3, "unclosed subgraph block")}, 5: {(4, "unmatched closing brace"), (5, "unclosed brace block")},
        6: {(2, "edge missing source node"), (3, "edge missing target node")}, 7: {(0, "empty diagram")}, 9: {(3, "unmatched closing brace"), (3, "unclosed node brace"), (4, "unclosed node brace"), (5, "unclosed node brace"), (6, "unmatched closing brace"), (6, "unclosed node brace")},
    }
    assert validate_diagrams(df.where("false"), "no", "text").count() == 0


def test_markdown():
    html = markdown_html("# T\n\ntext `a<b` **x**\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx < 1\n```\n> q\n---")
    assert "<h1>T</h1>" in html and "<code>a&lt;b</code> <strong>x</strong>" in html and "<li>two</li>" in html
    assert "<th>a</th>" in html and "<td>2</td>" in html and "x &lt; 1" in html and "<blockquote>q</blockquote>" in html and "<hr>" in html
    assert markdown_html("") == ""


def test_whole_pipeline(spark):
    from corvane.plans.pipeline import build

    files = spark.createDataFrame([("app/main.py", "from app.svc import run\nrun()\n"), ("app/svc.py", "from app import db\nfrom .db import q\ndef run():\n    return q()\n"), ("app/db.py", "class Q:\n    def get(self):\n        pass\ndef q(): pass\n")], "filename string, content string")
    k = build(files)
    assert {tuple(r) for r in k.edges.collect()} == {("app/main", "app/svc"), ("app/svc", "app/db")}
    assert {r["name"]: r["role"] for r in k.roles.collect()}["app/main"] == "入口层"
    assert {r["id"] for r in k.chunks.collect()} >= {"app/db.py#Q", "app/db.py#q", "app/svc.py#imports"}


def test_call_sites_and_graph(spark):
    from corvane.operators import calls

    text = 'def run(a):\n    b = load(a)  # not_a_call()\n    x.y.save(b, "nor(this)")\n\ndef load(p):\n    return run.load(p)\n'
    assert calls.sites("m.py", text) == [(2, "", "load"), (3, "x.y", "save"), (6, "run", "load")]
    files = spark.createDataFrame([(1, "m.py", text), (2, "n.py", "def save(z):\n    pass\n"), (3, "o.py", "def load(q):\n    return save(q)\n")], "file_id long, filename string, content string")
    defs = spark.createDataFrame([(1, "run", 1), (1, "load", 5), (2, "save", 1), (3, "load", 1)], "file_id long, name string, start_line long")
    modules = spark.createDataFrame([(1, "m"), (2, "n"), (3, "o")], "file_id long, module string")
    got = {tuple(r) for r in calls.call_graph(calls.call_sites(files, "file_id", "filename", "content"), defs, modules).collect()}
    assert got == {("m", "run", "m", "load"), ("m", "run", "n", "save"), ("o", "load", "n", "save")}


def test_message_returns_and_repetitions(spark):
    from corvane.operators.render import messages, sequence_lines, summaries

    paths = spark.createDataFrame([("a/x#f -> b#get_y -> a/x#g -> a/x#g2 -> c#run",), ("a#f -> a#s -> a#s",)], "path string")
    got = {(r["path"][:4], r["message_no"]): (r["from_module"], r["to_module"], r["label"], r["is_return"]) for r in messages(paths).collect()}
    assert got[("a/x#", 1)] == ("a/x", "b", "get_y() — 数据查询", False) and got[("a/x#", 2)][3] and got[("a/x#", 4)][2] == "run() — 主流程执行"
    assert [k for k in got if k[0] == "a#f "] == [("a#f ", 1)]
    lines = [r["line"] for r in sequence_lines(paths).where("path like 'a/x%'").orderBy("line_no").collect()]
    assert lines[0] == "sequenceDiagram" and lines[2] == "    participant a_x as a/x" and lines[5] == "    a_x->>b: get_y() — 数据查询" and lines[6].startswith("    b-->>a_x")
    assert [r["title"] for r in summaries(paths).where("path like 'a/x%'").collect()] == ["a/x.f -> c.run"]


def test_text_operations(spark):
    from pyspark.sql import functions as F

    from corvane.functions import labels as L
    from corvane.operators import texts as X

    one = spark.createDataFrame([("[a/b.py]，c/d、e/, ",)], "t string")
    assert one.select(X.attribution(F.col("t"))).first()[0] == ["a/b.py", "c/d", "e"]
    assert one.select(X.source_spans(F.array(F.lit("a/b")), F.lit(".py"))).first()[0] == '<span class="source-ref" data-file="a/b.py"><strong>b.py</strong></span>'
    lines = spark.createDataFrame([(1, 'import {a} from "./x";'), (2, "from .y import z"), (3, "#include <vector>"), (4, "use a::b;"), (5, "import 'side'"), (6, "x = 1"), (7, None)], "no int, line string")
    assert {r["no"]: (r["module"], r["is_relative"]) for r in X.import_statements(lines, "line").collect()} == {1: ("./x", True), 2: (".y", True), 3: ("vector", False), 4: ("a::b", False), 5: ("side", False)}
    calls = spark.createDataFrame([(1, "my_load(x); load(y)"), (2, "loader (z)"), (3, "")], "no int, line string")
    assert {tuple(r) for r in X.named_calls(calls, spark.createDataFrame([("load",), ("my_load",)], "name string"), ["no"], "line").collect()} == {(1, "load"), (1, "my_load")}
    docs = spark.createDataFrame([(1, "`a/b` `b/c.py` `nope` `x/y` `c`"), (2, "no names"), (3, None)], "no int, text string")
    paths, names = spark.createDataFrame([("z/b/c.py",)], "path string"), spark.createDataFrame([("c",)], "name string")
    assert [tuple(r) for r in X.unknown_names(X.quoted_names(docs, "no", "text"), "no", paths, names).collect()] == [(1, 5, 3, False)]
    assert one.select(L.masked(F.lit("abcdefghijkl")), L.masked(F.lit("short")), L.action(F.lit("zip"))).first()[:] == ("abcd****ijkl", "****", "zip 操作")
