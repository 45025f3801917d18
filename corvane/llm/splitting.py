"""Cutting oversized texts at natural boundaries (problem 4).

A text is read as a tree. In prose, headings contain what follows them down to the next heading of
their level; code has functions, whose spans are given by lines or by the grammar of its language, with
the comments above them. Blocks are separated by blank lines, lines contain the more deeply indented
lines below them, lines contain sentences, sentences words. Siblings are merged as long as they fit;
only a node that is larger than the limit is opened, and of what it is cut into only small remains, of
less than a quarter of the limit, are merged with what stands beside it. A heading stays with what it
heads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar.islands import Reader, functions
from .grammar.languages import language

HEADING = re.compile(r"(#{1,6})\s")
FENCE = re.compile(r"\s*(```|~~~)")
SENTENCE = re.compile(r"(?<=[.!?;。！？；,，])\s*|(?<=[)}\]])\s+")
WORD = re.compile(r"\s+")
CODE = re.compile(r"[{}();,:=\\]\s*$|^\s*[\w.\[\]]+\s*[-+*/|&:]?=\s*\S|^\s*(?:def|class|import|from|return|func|fn|pub|let|const|var|if|for|while|package|use|#include)\b.*[^.]$")
#: Lines that belong to a function below them, and a heading without anything below it.
ABOVE = re.compile(r"[ \t]*(?://|/\*|\*|#|@|\[\[|template\s*<)")
BARE = re.compile(r"\s*#{1,6}\s[^\n]*\s*")


def _line_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    spans, at = [], start
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop + 1
        spans.append((at, stop))
        at = stop
    return spans


def _by_marks(spans: list[tuple[int, int]], opens: list[bool]) -> list[tuple[int, int]]:
    """Join line spans to blocks; a block begins at each line marked as opening."""
    blocks: list[tuple[int, int]] = []
    for (a, b), first in zip(spans, opens):
        if blocks and not first:
            blocks[-1] = (blocks[-1][0], b)
        else:
            blocks.append((a, b))
    return blocks


def _cut_at(text: str, start: int, end: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    cuts = sorted({start, end, *(m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end)})
    return list(zip(cuts, cuts[1:]))


def is_prose(text: str) -> bool:
    """Whether most lines outside of fences are words: few end or begin as code does."""
    lines, inside, coded = 0, False, 0
    for line in text.split("\n"):
        if FENCE.match(line):
            inside = not inside
        elif line.strip() and not inside:
            lines += 1
            coded += CODE.search(line) is not None
    return coded <= 0.2 * lines


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def function_nodes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of functions that are given by lines (from 1), each with the comment and
    annotation lines directly above it; those inside of others are left out."""
    starts = line_starts(text)
    nodes: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if not 0 < first <= last or first > len(starts):
            continue
        k = first - 1
        while k > 0 and ABOVE.match(text, starts[k - 1], starts[k]):
            k -= 1
        a, b = starts[k], starts[last] if last < len(starts) else len(text)
        if not nodes or a >= nodes[-1][1]:
            nodes.append((a, b))
    return nodes


def parsed_nodes(text: str, extension: str) -> list[tuple[int, int]]:
    """The functions that the grammar of a language finds in a text."""
    spoken = language(extension)
    if spoken is None or "\r" in text:
        return []
    rows = Reader(spoken, text)
    return function_nodes(text, [(rows.row(f.level.start(f.first)) + 1, rows.row(max(0, f.level.end(f.end - 1) - 1)) + 1) for f in functions(spoken, text, rows)])


def children(text: str, start: int, end: int, limit: int, prose: bool, nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of an oversized span at its outermost structure; runs of characters at last."""
    cuts = sorted({start, end, *(x for a, b in nodes if start <= a and b <= end and (a, b) != (start, end) for x in (a, b))})
    if len(cuts) > 2:
        return list(zip(cuts, cuts[1:]))
    lines = _line_spans(text, start, end)
    if len(lines) > 1:
        if prose:
            fenced, inside = [], False
            for a, b in lines:
                mark = FENCE.match(text, a, b) is not None
                fenced.append(inside or mark)
                inside ^= mark
            levels = [0 if f else len(m.group(1)) if (m := HEADING.match(text, a, b)) else 0 for (a, b), f in zip(lines, fenced)]
            for level in range(1, 7):
                parts = _by_marks(lines, [v == level for v in levels])
                if len(parts) > 1:
                    return parts
        blank = [not text[a:b].strip() for a, b in lines]
        indents = [len(s := text[a:b]) - len(s.lstrip()) for a, b in lines]
        for depth in sorted({i for i, e in zip(indents, blank) if not e}):
            for opens in ([k > 0 and blank[k - 1] and not blank[k] and indents[k] <= depth for k in range(len(lines))], [not e and i <= depth for i, e in zip(indents, blank)]):
                parts = _by_marks(lines, opens)
                if len(parts) > 1:
                    return parts
        return lines
    for pattern in (SENTENCE, WORD):
        parts = _cut_at(text, start, end, pattern)
        if len(parts) > 1:
            return parts
    return [(a, min(a + limit, end)) for a in range(start, end, limit)]


def pack(text: str, start: int, end: int, limit: int, prose: bool = True, nodes: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Bodies of at most `limit` characters that cover the span without gap or overlap."""
    nodes = nodes or []
    packed: list[tuple[int, int]] = []
    #: Spans still to be placed, the next one last, with the number of the node they are parts of.
    todo, opened, last = [(start, end, 0)], 0, -1
    while todo:
        a, b, parent = todo.pop()
        if b - a <= limit:
            bare = bool(packed) and prose and BARE.fullmatch(text, *packed[-1]) is not None
            blank = not text[a:b].strip()
            if packed and b - packed[-1][0] <= limit and (parent == last or bare or blank):
                packed[-1] = (packed[-1][0], b)
            else:
                packed.append((a, b))
            last = last if blank and bool(packed) else parent
            continue
        opened += 1
        todo += [(c, d, opened) for c, d in reversed(children(text, a, b, limit, prose, nodes))]
        last = -1
    # Small remains of opened nodes go to a neighbour where that fits, a heading never to what precedes it.
    whole: list[tuple[int, int]] = []
    for a, b in packed:
        small = whole and min(b - a, whole[-1][1] - whole[-1][0]) < limit // 4
        if small and b - whole[-1][0] <= limit and not (prose and BARE.fullmatch(text, a, b)):
            whole[-1] = (whole[-1][0], b)
        else:
            whole.append((a, b))
    return whole


def split_text(text: str, limit: int, overlap: int, prose: bool = True, nodes: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces. Each piece but the first begins exactly `overlap` characters
    before the previous one ends, or with the text where that has fewer; none is longer than `limit`."""
    if len(text) <= limit:
        return [(0, len(text))]
    first_fits = pack(text, 0, len(text), limit - overlap, prose, nodes)
    return [(max(0, a - overlap) if k else a, b) for k, (a, b) in enumerate(first_fits)]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 4000, overlap: int = 200, only_oversized: bool = False, extension: str | None = None, spans: str | None = None) -> DataFrame:
    """Pieces of every text: (key, piece_no, n_pieces, start, end, piece); start and end count
    code points from 0.

    A text within the limit is one piece and never leaves the JVM; only oversized texts go to
    Python. Null texts give no piece, empty ones a single empty piece. Repeated rows are split
    each on its own. Columns other than key and text are ignored, whatever their names.
    only_oversized drops the texts that need no cut. extension names a column with the file extension
    of code, null for prose; without it the lines tell. spans names a column with arrays of (start,
    end) lines, from 1, of the functions in the text; without it the grammar of the extension finds
    them. Lines outside of the text, null spans and null arrays are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = F.col(extension).cast("string") if extension else F.lit(None).cast("string")
    lines = F.transform(F.col(spans), lambda x: F.array(x.getField("start").cast("int"), x.getField("end").cast("int"))) if spans else F.lit(None).cast("array<array<int>>")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), kind.alias("ext"), lines.alias("spans")).where(F.col("text").isNotNull())
    key_type = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), {k: [] for k in ("row", "piece_no", "n_pieces", "start", "end", "piece")}
            for row, (value, ext, given) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                told = [(x[0], x[1]) for x in given or [] if x and None not in x]
                nodes = function_nodes(value, told) if told else parsed_nodes(value, ext) if ext else []
                cuts = split_text(value, limit, overlap, is_prose(value) if not ext else False, nodes)
                for number, (a, b) in enumerate(cuts):
                    for name, x in zip(out, (row, number, len(cuts), a, b, value[a:b])):
                        out[name].append(x)
            rows_of = pa.array(out.pop("row"), pa.int64())
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [keys.take(rows_of), *(pa.array(v, t) for v, t in zip(out.values(), types))],
                ["key", *out],
            )

    columns = "piece_no int, n_pieces int, start int, end int, piece string"
    large = rows.where(F.length("text") > limit).mapInArrow(cut, f"key {key_type}, {columns}")
    if only_oversized:
        return large.withColumnRenamed("key", key)
    small = rows.where(F.length("text") <= limit).select(
        "key", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("piece")
    )
    return large.unionByName(small).withColumnRenamed("key", key)
