"""Texts that lost their end (problem 10).

A stack automaton reads the whole text and says in which state it stops: inside a code block, a table row, a literal or a bracket, inside a sentence, or at a
place where texts do stop. What a place means depends on the corpus: whether a source's texts end
with a full stop at all, at which length its field was cut, which words and closing phrases exist.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread

# What is appended at a cut, and abbreviations inside of sentences.
NOTE = re.compile(r"\s*(?:[\[(<{]\s*(?:\.{3}|…)?\s*(?:more|read more|continued|cont\.?|to be continued|continue reading|truncated|cut|cut off|snip(?:ped)?|clipped|message clipped|trimmed|shortened)\s*(?:\.{3}|…)?\s*[\])>}])\s*$", re.I)
ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…|\. \. \.)\s*$")
ABBREVIATION = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|cf|vs|z\.B|bzw|d\.h|u\.a|p\.\s?ex|p\.\s?ej|approx|Mr|Mrs|Dr|No|Nr)\.$")
STOP = re.compile(r"[.!?。！？؟।](?:[)\]}\"'`”’»›*_）】」』]|</\w+>)*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})", re.M)
LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(?=\S)")
HEAD = re.compile(r"^([A-Z][\w-]*(?: [\w-]+){0,3})\s*:\s+\S")
LABEL = re.compile(r"^(?:[A-Z][\w-]*(?: [\w-]+){0,3}\s*:\s+\S.*|[A-Z]\w* v?\d+(?:\.\d+)+|(?:--|—|–)\s*\S.*|https?://\S+|#{1,6} .*|\[[^\]]+\](?:\([^)\s]*\)|: \S+)|!\[[^\]]*\]\([^)\s]*\))$")
URL_TAIL = re.compile(r"https?:?/?/?\S*$")
WHOLE_URL = re.compile(r"https?://[^\s/]+\.[a-z]{2,}(?:[:/]\S*)?$")
BROKEN = re.compile(r"(?:�|[\ud800-\udfff]|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#x?[0-9a-fA-F]*|[a-zA-Z]{2,8})?|%[0-9A-F]?)$")
OPENS, CLOSES = "([{“«「『（【", {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『", "）": "（", "】": "【"}
# Elements of markup that have to be closed, and what the automaton reads.
ELEMENTS = "a|b|blockquote|center|code|details|div|em|i|kbd|ol|pre|section|span|strong|sub|summary|sup|table|ul"
TOKEN = re.compile(
    rf"(?m)^ {{0,3}}(?P<fence>`{{3,}}|~{{3,}})|(?P<blank>\n[ \t]*(?=\n))|(?P<comment><!--)|(?P<endcomment>-->)|(?P<element><(?P<slash>/?)(?P<name>(?i:{ELEMENTS}))(?:\s[^<>]*)?(?<!/)>)|(?P<escape>\\[\s\S])|(?P<tick>`)|(?P<mark>\*\*|\")|(?P<open>[" + re.escape(OPENS) + "])|(?P<close>[" + re.escape("".join(CLOSES)) + "])"
)
LAST_WORD = re.compile(r"[^\W\d_]+$")
WORDS = re.compile(r"[^\W\d_]+")


class Stack:
    """The automaton: reads a text from its start to its end and holds what is open. Code fences,
    comments and elements of markup stay open over paragraphs; code spans, brackets, quotes and
    emphasis end with theirs."""

    def __init__(self, text: str) -> None:
        self.fence, self.comment = "", False
        self.elements: list[str] = []
        self.spans: list[str] = []
        for m in TOKEN.finditer(text):
            kind, value = m.lastgroup, m.group(0)
            if kind == "fence":
                self._fence(value.strip())
            elif not self.fence:
                self._inline(kind, value, m)

    def _fence(self, mark: str) -> None:
        if not self.fence:
            self.fence = mark
            self.spans.clear()
        elif mark[0] == self.fence[0] and len(mark) >= len(self.fence):
            self.fence = ""

    def _inline(self, kind: str, value: str, m: re.Match) -> None:
        spans = self.spans
        if kind == "blank":
            spans.clear()
        elif self.comment:
            self.comment = kind != "endcomment"
        elif spans and spans[-1] == "`":
            if kind == "tick":
                spans.pop()
        elif kind == "comment":
            self.comment = True
        elif kind == "element":
            name = m["name"].lower()
            if not m["slash"]:
                self.elements.append(name)
            elif name in self.elements:
                del self.elements[len(self.elements) - 1 - self.elements[::-1].index(name) :]
        elif kind == "tick" or value in OPENS:
            spans.append(value)
        elif kind == "mark":
            if value in spans:
                del spans[spans.index(value) :]
            else:
                spans.append(value)
        elif kind == "close" and CLOSES[value] in spans:
            del spans[len(spans) - 1 - spans[::-1].index(CLOSES[value]) :]


def head(text: str) -> str:
    """What stands before the colon at the start of the last line, if it looks like a label."""
    body = text.rstrip()
    m = HEAD.match(body[body.rfind("\n") + 1 :])
    return m.group(1) if m else ""


def ending(text: str) -> tuple[str, str]:
    """(state, word) of a text's end. States: whole; cut; open: a list item, label or the like that
    needs no full stop; plain: words without one; dots: an ellipsis after words. word is the last
    word of open and plain, the last two of dots."""
    body = text.rstrip()
    if not body:
        return "whole", ""
    note = NOTE.search(body)
    if note:
        body = body[: note.start()].rstrip()
    dots = None if note else ELLIPSIS.search(body)
    if dots:
        body = body[: dots.start()].rstrip()
    if not body:
        return "whole", ""
    left = Stack(body)
    if left.fence:
        return "cut", "code"
    if left.comment or left.elements:
        return "cut", "markup"
    tail = body[body.rfind("\n\n") + 2 :] if "\n\n" in body else body
    line = body[body.rfind("\n") + 1 :]
    if FENCE.match(line):
        return "whole", ""
    if STOP.search(line) is None and BROKEN.search(line) and not re.search(r"&\s*$|\s%$|\d%$", line):
        return "cut", "bytes"
    if line.startswith("|"):
        rows = re.findall(r"^\|.*$", tail, re.M)
        cells = lambda r: r.count("|") - r.count("\\|")
        if not line.endswith("|") or cells(line) < cells(rows[0]):
            return "cut", "table"
        if len(rows) == 1 or re.fullmatch(r"[|\s:-]+", line):
            return "cut", "table"
        return "open", ""
    left = left.spans
    if "`" in left:
        return "cut", "span"
    version = re.fullmatch(r"[A-Z]\w* v?\d+(?:\.\d+)*\.", line)
    if STOP.search(line) and not ABBREVIATION.search(line) and not version and not dots:
        return ("cut", "span") if URL_TAIL.search(line) and left else ("whole", "")
    if version:
        return "cut", "label"
    if left:
        return "cut", "span"
    if dots:
        return "dots", " ".join(WORDS.findall(line.lower())[-2:])
    if note or ABBREVIATION.search(line):
        return "cut", "sentence"
    word = (LAST_WORD.search(line.lower()) or re.match("", "")).group(0)
    if LIST.match(line):
        return "open", word
    if LABEL.match(line):
        url = URL_TAIL.search(line)
        if url and not WHOLE_URL.search(url.group(0)) or line.endswith((",", ":", ":-")):
            return "cut", "label"
        return "open", word
    return ("plain", word) if not line.endswith((",", ";", ":")) else ("cut", "sentence")


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, cut, reason) for every text.

    Counts over the whole corpus decide what an ending means: a word at the end counts as broken
    off if other texts have words that it begins, fifty times as often as itself; a phrase before
    an ellipsis is a way to close if a twentieth of such texts, three at least, end in it, copies
    counted once, and they come from three sources or from as many as have such texts; a missing
    full stop means nothing in a source where most texts lack one, or after a label whose lines
    mostly lack one; a text as long as its source's
    longest ones (three at least) stopped at the limit of its field.

    Null keys are left out. Null, empty and blank texts are whole. Repeated rows come out repeated.
    Null sources form one source. Other columns are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")).where("key is not null")
    rows = spread(rows)
    key_type = rows.schema["key"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [ending(t or "") for t in batch.column(1).to_pylist()]
            lengths = [len(t or "") for t in batch.column(1).to_pylist()]
            hashes = [int.from_bytes(hashlib.blake2b(t.rstrip().encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True) if e[0] == "dots" else 0 for e, t in zip(ends, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lengths, pa.int32()), pa.array([e[0] for e in ends]), pa.array([e[1] for e in ends]), pa.array([head(t or "") for t in batch.column(1).to_pylist()]), pa.array(hashes, pa.int64())],
                ["key", "source", "length", "state", "word", "head", "hash"],
            )

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                # How often a word comes before the end of a text: the last one may be cut itself.
                found = WORDS.findall((t or "").lower())
                counts.update(found[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    judged = cut_lineage(rows.mapInArrow(judge, f"key {key_type}, source string, length int, state string, word string, head string, hash long"))
    # A label whose lines mostly do end in a full stop introduces a sentence.
    heads = judged.where("head <> ''").groupBy("head").agg(F.avg(F.when(F.col("state") == "open", 1.0).otherwise(0.0)).alias("bare_head"))
    heads = heads.where("bare_head < 0.5").select("head", F.lit(True).alias("spoken"))
    judged = judged.join(heads, "head", "left").withColumn("state", F.when((F.col("state") == "open") & F.col("spoken"), "plain").otherwise(F.col("state"))).drop("head", "spoken")
    words = rows.select("text").mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    asked = judged.where("state in ('open', 'plain') and word <> ''").select("word").distinct()
    longer = words.where("n >= 3 and length(word) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.expr("word").substr(F.lit(1), k))).alias("word"), "n")
    longer = longer.join(asked, "word", "left_semi").groupBy("word").agg(F.max("n").alias("longer"))
    broken = longer.join(words, "word", "left").where("coalesce(n, 0) * 50 <= longer").select("word", F.lit(True).alias("broken"))

    sources = judged.groupBy("source").agg(
        F.max("length").alias("longest"), F.avg(F.when(F.col("state") == "plain", 1.0).otherwise(0.0)).alias("bare")
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    at_longest = judged.withColumnRenamed("source", "s").join(sources.withColumnRenamed("source", "s2"), same("s", "s2") & (F.col("length") == F.col("longest")))
    limits = at_longest.groupBy("s2").agg(F.count("*").alias("at_limit"))
    sources = sources.join(limits, same("source", "s2")).select(F.col("source").alias("of"), "longest", "bare", "at_limit")

    # A copied text is one witness, from one source.
    dotted = judged.where("state = 'dots'").groupBy("word", "hash").agg(F.min("source").alias("source"))
    origins = F.count_distinct(F.struct("source"))
    closings = dotted.groupBy("word").agg(F.count("*").alias("k"), origins.alias("origins"))
    total = dotted.agg(F.count("*").alias("all"), origins.alias("all_origins"))
    closings = closings.crossJoin(total).where("k >= 3 and k * 20 >= all and origins >= least(3, all_origins)").select("word", F.lit(True).alias("closes"))

    # Most texts end as they should: only the others meet the tables of words.
    doubtful = F.col("state").isin("open", "plain", "dots") & (F.col("word") != "")
    looked_up = judged.where(doubtful).join(broken, "word", "left").join(closings, "word", "left")
    clear = judged.where(~doubtful).withColumn("broken", F.lit(None).cast("boolean")).withColumn("closes", F.lit(None).cast("boolean"))
    out = looked_up.unionByName(clear).join(sources, same("source", "of"), "left")
    limit = (F.col("at_limit") >= 3) & (F.col("length") == F.col("longest"))
    is_broken, state = F.coalesce("broken", F.lit(False)), F.col("state")
    reason = (
        F.when(state == "cut", F.col("word"))
        .when((state == "dots") & ~F.coalesce("closes", F.lit(False)), F.lit("dots"))
        .when((state == "plain") & (F.col("bare") < 0.5), F.lit("sentence"))
        .when(state.isin("plain", "open") & is_broken, F.lit("word"))
        .when(state.isin("plain", "open") & limit, F.lit("limit"))
    )
    return out.select(F.col("key").alias(key), F.col("source").alias(source), reason.isNotNull().alias("cut"), reason.alias("reason"))


def rates(flagged: DataFrame, source: str) -> DataFrame:
    """(source, texts, cut_texts, rate) per source."""
    cut = F.sum(F.col("cut").cast("long"))
    return flagged.groupBy(source).agg(F.count("*").alias("texts"), cut.alias("cut_texts"), F.round(cut / F.count("*"), 6).alias("rate"))
