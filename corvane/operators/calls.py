"""Call sites in source texts, and the call graph they make."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import DEF, KIND, METHOD, blank_literals
from .symbols import nearest_before

CALL = re.compile(r"(?<![\w.@])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*)([A-Za-z_$][\w$]*)\s*(?:!\s*)?\(", re.ASCII)
# Words before a parenthesis that call nothing.
WORDS = frozenset("if for while switch catch return else do new throw sizeof function def class match elif except with assert and or not in is lambda yield await async print super import from func fn typeof delete case raise del global".split())


def sites(filename: str, text: str) -> list[tuple[int, str, str]]:
    """(line from 1, qualifier, name) of the calls of one file, those in strings, comments and
    definitions left out."""
    kind = KIND.get(filename.rpartition(".")[2].lower())
    if kind is None:
        return []
    out = []
    for number, line in enumerate(blank_literals(text.replace("\r\n", "\n"), kind).split("\n"), 1):
        if "(" not in line:
            continue
        body = line.strip()
        m = DEF[kind].match(body) or (METHOD.match(body) if kind == "js" else None)
        own = m["n"] if m else None
        for c in CALL.finditer(line):
            if c.group(2) not in WORDS and not (own == c.group(2)):
                out.append((number, c.group(1).rstrip(".:->"), c.group(2)))
    return out


def call_sites(df: DataFrame, key: str, filename: str, text: str) -> DataFrame:
    """(key, line, qualifier, callee) of every call; null names and texts give none."""
    rows = df.where(F.col(filename).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(filename).alias("name"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, quals, names = [], [], [], []
            for k, (n, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for line, q, c in sites(n, t):
                    at.append(k)
                    lines.append(line)
                    quals.append(q)
                    names.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.int64()), pa.array(quals, pa.string()), pa.array(names, pa.string())], ["key", "line", "qualifier", "callee"])

    return rows.mapInArrow(run, f"key {key_type}, line long, qualifier string, callee string").withColumnRenamed("key", key)


def call_graph(calls: DataFrame, defs: DataFrame, modules: DataFrame) -> DataFrame:
    """(from_module, from_name, to_module, to_name): calls (file_id, line, callee) joined to the
    nearest definition before them and to what the called name means: a definition of the same file,
    else the first one by module and line.

    defs has file_id, name, start_line, modules file_id and module. A name that many files define is
    first reduced to one definition per file and one in all, so that no call meets all of them.
    """
    named = defs.where("start_line > 0 and name is not null").select("file_id", "name", "start_line").distinct()
    callers = nearest_before(calls.select("file_id", "line").distinct(), named).select("file_id", "line", F.col("name").alias("from_name"))
    made = calls.join(callers, ["file_id", "line"])
    placed = named.join(modules, "file_id")
    first = placed.groupBy("name").agg(F.min(F.struct("module", "start_line")).alias("x")).select(F.col("name").alias("callee"), F.col("x.module").alias("any_module"))
    own = named.select("file_id", F.col("name").alias("callee"), F.lit(True).alias("is_own")).distinct()
    linked = made.join(first, "callee").join(own, ["file_id", "callee"], "left").join(modules, "file_id")
    out = linked.select(F.col("module").alias("from_module"), "from_name", F.when(F.col("is_own"), F.col("module")).otherwise(F.col("any_module")).alias("to_module"), F.col("callee").alias("to_name"))
    return out.where("not (from_module = to_module and from_name = to_name)").distinct()
