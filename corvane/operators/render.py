"""Diagram and document text as ordered line rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import action
from ..session import global_rank


def node_id(name):
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def dependency_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line): a flow chart of the modules, nodes and edges in their order."""
    spark = nodes.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("k"), F.lit("graph LR").alias("line"))
    boxes = nodes.select(F.lit(1), "name", F.concat(F.lit("    "), node_id(F.col("name")), F.lit('["'), "name", F.lit('"]')))
    arrows = edges.select(F.lit(2), F.concat_ws(" ", "src", "dst"), F.concat(F.lit("    "), node_id(F.col("src")), F.lit(" --> "), node_id(F.col("dst"))))
    return global_rank(head.union(boxes).union(arrows), F.asc("part"), F.asc("k"), name="line_no").select("line_no", "line")


def _steps(paths: DataFrame) -> DataFrame:
    """(path, message_no, from_module, to_module, name) of chains `a#f -> b#g -> ...`."""
    steps = F.split("path", " -> ")
    module = lambda x: F.split_part(x, F.lit("#"), F.lit(1))
    calls = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1),
        lambda i: F.struct(i.cast("long").alias("message_no"), module(F.element_at(steps, i)).alias("from_module"), module(F.element_at(steps, i + 1)).alias("to_module"), F.split_part(F.element_at(steps, i + 1), F.lit("#"), F.lit(2)).alias("name")),
    )
    return paths.select("path", F.inline(calls))


def messages(paths: DataFrame) -> DataFrame:
    """(path, message_no, from_module, to_module, label, is_return): the messages of call chains. One
    that goes back where the message before it came from is a return; one that equals the message
    before it is left out."""
    told = _steps(paths).withColumn("label", F.concat("name", F.lit("() — "), action(F.col("name"))))
    before = lambda c: F.lag(c).over(W.partitionBy("path").orderBy("message_no"))
    back = (before("from_module") == F.col("to_module")) & (before("to_module") == F.col("from_module"))
    again = (before("from_module") == F.col("from_module")) & (before("to_module") == F.col("to_module")) & (before("label") == F.col("label"))
    marked = told.select("path", "message_no", "from_module", "to_module", "label", F.coalesce(back, F.lit(False)).alias("is_return"), F.coalesce(again, F.lit(False)).alias("again"))
    return marked.where("not again").drop("again")


def summaries(paths: DataFrame) -> DataFrame:
    """(path, title, description) of call chains: where they start, over how many top folders they go
    and where they end."""
    steps = F.split("path", " -> ")
    part = lambda x, i: F.split_part(x, F.lit("#"), F.lit(i))
    first, last = F.element_at(steps, 1), F.element_at(steps, -1)
    top = lambda x: F.split_part(part(x, 1), F.lit("/"), F.lit(1))
    layers = F.size(F.array_distinct(F.transform(steps, top)))
    title = F.concat(part(first, 1), F.lit("."), part(first, 2), F.lit(" -> "), part(last, 1), F.lit("."), part(last, 2))
    over = F.when(layers > 2, F.concat(F.lit("；经过 "), layers.cast("string"), F.lit(" 个模块协作"))).otherwise("")
    said = F.concat(F.lit("触发条件：调用 "), top(first), F.lit(" 的 "), action(part(first, 2)), over, F.lit("；最终由 "), top(last), F.lit(" 完成 "), action(part(last, 2)))
    return paths.select("path", title.alias("title"), said.alias("description"))


def sequence_lines(paths: DataFrame) -> DataFrame:
    """(path, line_no, line): call chains as sequence diagrams: a line of description, participants in
    the order of their first appearance, then the messages."""
    modules = F.transform(F.split("path", " -> "), lambda x: F.split_part(x, F.lit("#"), F.lit(1)))
    head = summaries(paths).select("path", F.lit(0).alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("sequenceDiagram").alias("line")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("    %% "), "description").alias("line")))).alias("x")).select("path", "part", "x.k", "x.line")
    people = paths.select("path", F.posexplode(F.array_distinct(modules)).alias("k", "m")).select("path", F.lit(1).alias("part"), "k", F.concat(F.lit("    participant "), node_id(F.col("m")), F.lit(" as "), "m").alias("line"))
    arrow = F.when(F.col("is_return"), "-->>").otherwise("->>")
    said = messages(paths).select("path", F.lit(2).alias("part"), F.col("message_no").cast("int").alias("k"), F.concat(F.lit("    "), node_id(F.col("from_module")), arrow, node_id(F.col("to_module")), F.lit(": "), "label").alias("line"))
    rows = head.union(people).union(said)
    # The lines of one chain, which its length bounds.
    return rows.withColumn("line_no", F.row_number().over(W.partitionBy("path").orderBy("part", "k")) - 1).select("path", "line_no", "line")


# The kinds of diagrams by their first word, arrows of flow charts, pairs of brackets, and
# what is said of an error.
ARROW = r"-->|-\.->|==>|--x|--o|-\.-"
BRACKETS = (("[", "]", "unclosed node bracket"), ("(", ")", "unclosed node parenthesis"), ("{", "}", "unclosed node brace"))
EMPTY, UNKNOWN, EXTRA_BRACE, OPEN_BRACE, EXTRA_END, OPEN_GRAPH, NO_SOURCE, NO_TARGET = "empty diagram", "unrecognized diagram type", "unmatched closing brace", "unclosed brace block", "unmatched 'end' for subgraph", "unclosed subgraph block", "edge missing source node", "edge missing target node"


def validate_diagrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, message): structural errors of diagram texts, lines from 1; 0 for an empty text.

    Lines are rows. The balance of braces and of subgraphs is a running sum over a text's lines; a line
    closes more than is open where the sum falls below every earlier one. Lines before the first word
    of a known kind are unrecognised; flow charts are also tested line by line. A null text is empty;
    null keys are left out.
    """
    given = df.where(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    blank = given.where(F.trim(F.regexp_replace("text", r"\s", "")) == "").select("key", F.lit(0).cast("long").alias("line"), F.lit(EMPTY).alias("message"))
    split = given.where(F.trim(F.regexp_replace("text", r"\s", "")) != "").select("id", "key", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    shown = split.select("id", "key", "n", (F.col("k") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("said")).where("said <> '' and said not like '%!%!%%' escape '!'")
    word = F.lower(F.regexp_extract("said", r"^(\w+)", 1))
    known = F.when(F.lower("said").rlike(r"^(graph|flowchart)( |$)"), "flow").when(word.startswith("classdiagram"), "class").when(word.startswith("sequencediagram"), "sequence")
    upto = W.partitionBy("id").orderBy("line")
    typed = shown.withColumn("kind", F.first(known, True).over(upto.rowsBetween(W.unboundedPreceding, 0))).withColumn("opens", F.row_number().over(W.partitionBy("id", F.col("kind").isNull()).orderBy("line")) == 1)
    lost = typed.where("kind is null").select("key", "line", F.lit(UNKNOWN).alias("message"))
    body = typed.where("kind is not null and not opens")
    many = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    graphs = F.when(F.col("kind") != "flow", 0).when(F.col("said").startswith("subgraph "), 1).when(F.col("said") == "end", -1).otherwise(0)
    run = body.withColumn("braces", F.sum(many(F.col("said"), "{") - many(F.col("said"), "}")).over(upto)).withColumn("graphs", F.sum(graphs).over(upto))
    earlier = lambda c: F.least(F.lit(0), F.coalesce(F.min(c).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    low = run.withColumn("low_braces", earlier("braces")).withColumn("low_graphs", earlier("graphs"))
    uneven = F.coalesce(*[F.when(many(F.col("said"), a) != many(F.col("said"), b), message) for a, b, message in BRACKETS])
    left, right = F.regexp_extract("said", rf"^(.*?)(?:{ARROW})", 1), F.regexp_extract("said", rf"^.*?(?:{ARROW})(.*)$", 1)
    bare = F.when(F.col("said").rlike(ARROW), F.when(F.trim(left) == "", NO_SOURCE).when(F.trim(right) == "", NO_TARGET))
    plain = (F.col("kind") == "flow") & ~F.col("said").startswith("subgraph ") & (F.col("said") != "end")
    found = F.array_compact(F.array(F.when(F.col("braces") < F.col("low_braces"), EXTRA_BRACE), F.when(F.col("graphs") < F.col("low_graphs"), EXTRA_END), F.when(plain, F.coalesce(uneven, bare))))
    wrong = low.select("key", "line", F.explode(found).alias("message"))
    # What is open at the end: the last balance above the lowest one.
    last = low.groupBy("id", "key", "n").agg(F.max_by(F.struct((F.col("braces") - F.least("braces", "low_braces")).alias("b"), (F.col("graphs") - F.least("graphs", "low_graphs")).alias("g")), "line").alias("x"))
    ends = last.select("key", F.col("n").cast("long").alias("line"), F.explode(F.array_compact(F.array(F.when(F.col("x.b") > 0, OPEN_BRACE), F.when(F.col("x.g") > 0, OPEN_GRAPH)))).alias("message"))
    return blank.union(lost).union(wrong).union(ends).withColumnRenamed("key", key)


INLINE = ((re.compile(r"`([^`]+)`"), "code"), (re.compile(r"\*\*(.+?)\*\*"), "strong"), (re.compile(r"(?<![\w*])\*([^*\s][^*]*)\*"), "em"))


def inline_html(text: str) -> str:
    """Code spans, emphasis, links and images of one piece of text; everything else escaped."""
    kept: list[str] = []

    def keep(html: str) -> str:
        kept.append(html)
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"`([^`]+)`", lambda m: keep(f"<code>{escape(m.group(1))}</code>"), text)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", lambda m: keep(f'<img src="{escape(m.group(2))}" alt="{escape(m.group(1))}">'), text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: keep(f'<a href="{escape(m.group(2))}">{escape(m.group(1))}</a>'), text)
    text = escape(text)
    for pattern, tag in INLINE[1:]:
        text = pattern.sub(rf"<{tag}>\1</{tag}>", text)
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m.group(1))], text)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def markdown_html(text: str) -> str:
    """Blocks of Markdown as HTML: fences, rules, quotes, tables, lists, headings, paragraphs."""
    out: list[str] = []
    lines = text.replace("\r\n", "\n").split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        body = line.strip()
        if body.startswith("```"):
            stop = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith("```")), len(lines))
            language = body[3:].strip()
            inner = "".join(escape(x) + "\n" for x in lines[k + 1 : stop])
            out.append(f'<div class="mermaid">\n{inner}</div>' if language == "mermaid" else f"<pre><code{f' class=' + chr(34) + 'language-' + escape(language) + chr(34) if language else ''}>{inner}</code></pre>")
            k = stop + 1
        elif not body:
            k += 1
        elif re.fullmatch(r"-{3,}|\*{3,}|_{3,}", body):
            out.append("<hr>")
            k += 1
        elif m := re.match(r"(#{1,6}) (.*)", body):
            out.append(f"<h{len(m[1])}>{inline_html(m[2].strip())}</h{len(m[1])}>")
            k += 1
        else:
            test = next(t for t in BLOCKS if t[0](body))
            stop = k
            while stop < len(lines) and (s := lines[stop].strip()) and test[0](s) and not (test[1] == "p" and (stop > k and any(t[0](s) for t in BLOCKS[:-1]) or re.match(r"#{1,6} |```", s))):
                stop += 1
            out.append(_block(test[1], [x.strip() for x in lines[k:stop]]))
            k = stop
    return "\n".join(out)


BLOCKS = ((lambda s: s.startswith(">"), "blockquote"), (lambda s: s.startswith("|"), "table"), (lambda s: re.match(r"[-*+] ", s) is not None, "ul"), (lambda s: re.match(r"\d+\. ", s) is not None, "ol"), (lambda s: True, "p"))


def _block(tag: str, lines: list[str]) -> str:
    if tag == "table":
        rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines]
        rows = [r for r in rows if not all(re.fullmatch(r"[ :-]*", c) for c in r)]
        cells = lambda r, t: "".join(f"<{t}>{inline_html(c)}</{t}>" for c in r)
        return "<table>\n" + "\n".join(f"<tr>{cells(r, 'th' if n == 0 else 'td')}</tr>" for n, r in enumerate(rows)) + "\n</table>"
    if tag in ("ul", "ol"):
        items = [re.sub(r"^(?:[-*+]|\d+\.) ", "", x) for x in lines]
        return f"<{tag}>\n" + "\n".join(f"<li>{inline_html(x)}</li>" for x in items) + f"\n</{tag}>"
    if tag == "blockquote":
        return f"<blockquote>{inline_html(' '.join(x.lstrip('> ') for x in lines))}</blockquote>"
    return f"<p>{inline_html(' '.join(lines))}</p>"


def rendered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, html) of Markdown texts; null texts are empty."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([markdown_html(t) for t in batch.column(1).to_pylist()], pa.string())], ["key", "html"])

    return rows.mapInArrow(run, f"key {key_type}, html string").withColumnRenamed("key", key)
