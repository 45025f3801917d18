"""Files that nobody wrote by hand for their repository (problem 5).

Character n-gram models decide. One per language is trained on the identifiers of the whole corpus:
mangled names are short strings that it finds improbable and that carry few bits each; names that
differ from each other only by a number have a low diversity; a file whose names nearly all follow a
style that its language's other names don't have is foreign. Others (see provenance.py) read the
names of folders and files and the opening comment, and tell what generators and libraries write from
what people write. Data are files that are made of literals but for a few names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread
from .grammar.languages import ALIASES, MAKERS
from .provenance import GENERATED, KEPT, MINIFIED, ORDER, VENDORED, Origin, Runs, runs
from .syntax import valid

IDENTIFIER = re.compile(r"\b[A-Za-z_$][\w$]*", re.ASCII)
STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\w{0,3}")
# How comments begin, and how those of several lines end.
OPENING = re.compile(r"#!?(?!include|define|if|pragma|!?\[)|//|/\*|<!--|--|\"\"\"|\'\'\'")
CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|pragma|!\[|\[)|/\*|\*|<!--|--|\"\"\"|''')")
NEW = math.log2(20 / 0.5)
DIGIT = re.compile(r"\d+")
# Characters of folded names, and by byte their numbers; a trigram is a number of three digits of this base.
ALPHABET = "^$_0abcdefghijklmnopqrstuvwxyz"
BASE = len(ALPHABET)
CODES = np.array([max(0, ALPHABET.find("0" if c in "123456789" else c.lower())) for c in map(chr, range(256))], np.int32)
INNER = re.compile(r"^[ \t]*(?://|#|\*)[^\n]*", re.M)
# Words of the languages, which say nothing about who wrote the file.
WORDS = frozenset("and as assert async await break case catch class const continue def default defer del do double elif else enum except export extends false final finally float fn for from func function go if impl implements import in int interface is lambda let long match mod module mut namespace new nil none not null or package pass private protected pub public raise range return self static str string struct super switch this throw throws trait true try type typeof use using var void while with yield bool boolean auto include std usize".split())


def leading_comment(text: str) -> list[str]:
    """The comment lines before the first line of code, blank lines left out."""
    out, at, close = [], 0, ""
    while at < len(text):
        stop = text.find("\n", at)
        line = text[at : len(text) if stop < 0 else stop].strip("\r\ufeff \t")
        at = len(text) if stop < 0 else stop + 1
        if not line:
            continue
        if not close:
            mark = OPENING.match(line)
            if not mark:
                break
            close = CLOSE.get(mark.group(0), "")
            if close and close in line[mark.end() :]:
                out.append(line)
                if not line.endswith(close):
                    break
                close = ""
                continue
        elif close in line:
            close = ""
        out.append(line)
    return out


def trigrams(name: str) -> list[str]:
    folded = name.lower() if name.isalpha() else re.sub(r"\d", "0", name.lower())
    padded = f"^{folded}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def coded(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the trigrams of names, where those of each name begin, how many it has). Those that
    span two names lie between; none of a name has ^ as its second or third character, as they do."""
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    c = CODES[np.frombuffer(f"^{'$^'.join(names)}$".encode("ascii"), np.uint8)]
    return (c[:-2] * BASE + c[1:-1]) * BASE + c[2:], np.cumsum(sizes + 2) - sizes - 2, sizes


class Trigrams:
    """Counts of the trigrams of names by language; few names are held at a time."""

    def __init__(self) -> None:
        self.names: dict[str, tuple[list[str], list[int]]] = {}
        self.sums: dict[str, np.ndarray] = {}

    def add(self, language: str, names: dict[str, int]) -> None:
        held, uses = self.names.setdefault(language, ([], []))
        held += names.keys()
        uses += names.values()
        if len(held) > 10_000:
            self.flush(language)

    def flush(self, language: str) -> None:
        held, uses = self.names.pop(language)
        if held:
            codes, _, sizes = coded(held)
            n = np.repeat(np.array(uses, np.int64), sizes + 2)[:-2]
            self.sums[language] = np.bincount(codes, n, BASE**3).astype(np.int64) + self.sums.get(language, 0)

    def counts(self) -> Iterator[tuple[str, str, int]]:
        """(language, trigram, count)."""
        for language in list(self.names):
            self.flush(language)
        for language, n in self.sums.items():
            for g in np.flatnonzero(n).tolist():
                gram = ALPHABET[g // BASE**2] + ALPHABET[g // BASE % BASE] + ALPHABET[g % BASE]
                if "^" not in gram[1:]:
                    yield language, gram, int(n[g])


class NameModel:
    """Cross-entropy of identifiers under trigram counts of a language, half a count and twenty
    characters added to each context."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        #: By language, the bits of each trigram by its number; those that span two names have none.
        self.tables: dict[str, np.ndarray] = {}
        #: By language, the mean bits of a name and of a character of a name, where a thousand names of
        #: the whole corpus are added to each language.
        self.usual: dict[str, tuple[float, float]] = {}
        sums: dict[str, tuple[float, int, int]] = {}
        for language, grams in counts.items():
            contexts: Counter[str] = Counter()
            for g, n in grams.items():
                contexts[g[:2]] += n
            known = {g: math.log2((contexts[g[:2]] + 20) / (n + 0.5)) for g, n in grams.items()}
            self.tables[language] = self.table(known, {c: math.log2((n + 20) / 0.5) for c, n in contexts.items()})
            bits = sum(n * known[g] for g, n in grams.items())
            names = sum(n for g, n in grams.items() if g[0] == "^")
            sums[language] = bits, names, sum(grams.values())
        self.unknown = self.table({}, {})
        bits, names, all_grams = (sum(x[i] for x in sums.values()) for i in range(3))
        for language, (b, n, g) in sums.items():
            k = 1000 / max(1, names)
            self.usual[language] = (b + k * bits) / (n + k * names), (b + k * bits) / (g + k * all_grams)

    @staticmethod
    def table(known: dict[str, float], unseen: dict[str, float]) -> np.ndarray:
        """Bits by number of a trigram: of those that were seen, and of others by their context."""
        out = np.full((BASE, BASE, BASE), NEW)
        at = ALPHABET.index
        for c, b in unseen.items():
            out[at(c[0]), at(c[1])] = b
        for g, b in known.items():
            out[at(g[0]), at(g[1]), at(g[2])] = b
        out[:, at("^")] = out[:, :, at("^")] = 0.0
        return out.reshape(-1)

    def bits(self, language: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits, characters) of each name, its end included."""
        if not names:
            return np.zeros(0), np.zeros(0)
        codes, begins, sizes = coded(names)
        return np.add.reduceat(self.tables.get(language, self.unknown)[codes], begins), sizes


@lru_cache(maxsize=10_000)
def family(extension: str) -> str:
    """The language of an extension; those without a grammar share one model."""
    known = ALIASES.get(extension, extension)
    return known if known in MAKERS else "other"


def language_of(filename: str) -> str:
    return family(filename.rpartition(".")[2].lower()) if "." in filename else "other"


@lru_cache(maxsize=200_000)
def style(name: str) -> str:
    """snake, camel, pascal, upper or plain."""
    core = name.strip("_$")
    if "_" in core:
        return "upper" if core.isupper() else "snake"
    if re.match(r"[a-z]+\d*[A-Z]", core):
        return "camel"
    return "pascal" if re.match(r"[A-Z][a-z0-9]+[A-Z]", core) else "plain"


def mangled(uses: np.ndarray, bits: np.ndarray, characters: np.ndarray, usual: tuple[float, float], text: str) -> bool:
    """Whether names, given by uses, bits and characters, carry little more than half of the usual
    information each, though per character they are less probable than usual, or stand on lines that
    nobody types, of 200 characters on average. Twenty usual names are added, so that few names prove
    nothing."""
    per_name, per_character = usual
    information = (float(uses @ bits) + 20 * per_name) / (int(uses.sum()) + 20)
    if not information < 0.6 * per_name:
        return False
    code = [x for x in text.split("\n") if x.strip() and not COMMENT.match(x)]
    return (float((bits / characters).sum()) + 5 * per_character) / (len(bits) + 5) > per_character or sum(map(len, code)) > 200 * len(code)


def judge(filename: str, text: str, model: NameModel, origin: Origin | None, styles: dict[str, dict[str, float]]) -> tuple[str | None, str | None, float]:
    """(reason or None, what tells it, bits per character of the names)."""
    language = language_of(filename)
    bare = STRING.sub('""', text)
    names = {x: n for x, n in Counter(IDENTIFIER.findall(bare)).items() if x.lower() not in WORDS}
    uses = np.fromiter(names.values(), np.int64, len(names))
    each, characters = model.bits(language, list(names))
    bits = float(uses @ (each / characters)) / int(uses.sum()) if names else 0.0
    classes = origin.classes(filename, leading_comment(text)) if origin else set()
    kept = KEPT in classes
    if GENERATED in classes and not kept:
        return GENERATED, "origin", bits
    if VENDORED in classes:
        return VENDORED, "origin", bits
    if MINIFIED in classes:
        return MINIFIED, "origin", bits
    if mangled(uses, each, characters, model.usual.get(language, (0.0, 0.0)), text):
        return MINIFIED, "names", bits
    # Literals only: names make up a tenth, thirty more characters of names allowed for.
    shown = len(text) - sum(text.count(c) for c in " \n\t\r")
    if int(uses @ characters) + 30 <= 0.1 * shown:
        literals = len(text) - len(bare) + sum(map(len, NUMBER.findall(bare))) + sum(bare.count(c) for c in ',[]{}"')
        if literals >= 0.85 * shown:
            return "data", "literals", bits
    # Names of one template: most differ from others only by a number.
    enough = 0.5 * (len(names) + 30)
    numbered = [] if kept else [x for x in names if not x.isalpha() and DIGIT.search(x)]
    if len(numbered) >= enough and max(Counter([DIGIT.sub("#", x) for x in numbered]).values()) >= enough:
        return GENERATED, "diversity", bits
    usual = styles.get(language)
    if usual and any(usual.get(s, 0.0) < 0.02 for s in ("snake", "camel", "pascal")):
        own = Counter(map(style, names))
        distinct = sum(own[s] for s in ("snake", "camel", "pascal", "upper"))
        odd = max(("snake", "camel", "pascal"), key=lambda s: own[s])
        # A text that isn't of its language at all has no style of it.
        if own[odd] >= 0.95 * (distinct + 0.8) and usual.get(odd, 0.0) < 0.02 and valid(language, text) is not False:
            return VENDORED, "style", bits
    return None, None, bits


def not_handwritten(df: DataFrame, key: str, filename: str, text: str, libraries: list[str] | None = None) -> DataFrame:
    """(key, filename, reason, told_by, bits) for every file; reason is generated, vendored,
    minified, data or null for what was written by hand, told_by what decided: origin, names,
    literals, diversity or style. bits is the names' cross-entropy per character.

    libraries are names of third-party libraries, which notes are read with. All models count the whole
    corpus: names, the comments behind the opening one, folders and endings. Null keys, names and
    texts: rows with a null key are left out, a null name or text counts as empty. Empty files are
    handwritten. Repeated rows come out repeated. Other columns are ignored. The tables of names are
    bounded by the alphabet (letters, 0, _ and $: at most 40^3 trigrams per language); of the n-grams of
    comments and paths only those come to the driver that opening comments, folders and endings have
    which are like the phrases of provenance.py.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(filename), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key is not null")
    rows = spread(rows)
    key_type = rows.schema["key"].dataType.simpleString()
    libraries = sorted({x.lower() for x in libraries or []})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = Origin(libraries)
        for batch in batches:
            names = Trigrams()
            written: Counter[tuple[str, str]] = Counter()
            asked: set[tuple[str, str]] = set()
            told: list[tuple[str, str, str, int, list[str] | None, int]] = []
            for name, body, copy in zip(*(batch.column(i).to_pylist() for i in range(3))):
                language = language_of(name)
                found = Counter(IDENTIFIER.findall(STRING.sub('""', body)))
                names.add(language, {x: n for x, n in found.items() if x.lower() not in WORDS})
                own: dict[str, list[str]] = {}
                for x in found:
                    own.setdefault(style(x), []).append(x)
                told += [(language, s, "", 0, x, copy) for s, x in own.items() if s != "plain"]
                opening = leading_comment(body)
                written.update(origin.examples(name, [x.strip() for x in INNER.findall(body)[len(opening) :]]))
                asked.update(origin.texts(name, opening))
            told += [(language, "", g, n, None, 0) for language, g, n in names.counts()]
            grams: dict[str, Runs] = {}
            for (kind, x), n in written.items():
                grams.setdefault(kind, Runs()).add(x, n)
            told += [(kind, "hand", g, n, None, 0) for kind, x in grams.items() for g, n in x.counts().items()]
            asked = {(kind, g) for kind, x in asked if origin.kinds[kind].nearest(x)[0] < math.inf for g in runs(x)}
            told += [(kind, "asked", g, 0, None, 0) for kind, g in asked]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in told], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64()))], ["language", "style", "gram", "n", "names", "copy"])

    counted = rows.select("name", "text", F.xxhash64("text").alias("copy")).mapInArrow(count, "language string, style string, gram string, n long, names array<string>, copy long")
    counted = cut_lineage(counted)
    # What several repositories have, by text or by file name, says nothing about how a language is
    # written by hand; of the other files each name counts once in the corpus.
    places = cut_lineage(rows.select(F.xxhash64("text").alias("copy"), F.lower(F.regexp_extract("name", r"([^/]*)$", 1)).alias("base"), F.regexp_extract("name", "^([^/]*)/", 1).alias("repo")).distinct())
    several = lambda c: places.groupBy(c).agg(F.count_distinct("repo").alias("repos")).where("repos > 1").select(c)
    shared_texts = places.join(several("base"), "base", "left_semi").select("copy").union(several("copy")).distinct()
    own = counted.where(F.col("style").isin("snake", "camel", "pascal", "upper")).join(shared_texts, "copy", "left_anti").select("language", "style", F.explode("names").alias("own")).groupBy("language", "style").agg(F.count_distinct("own").alias("n"))
    grams: dict[str, dict[str, int]] = {}
    styles: dict[str, dict[str, float]] = {}
    for r in counted.where("style = ''").groupBy("language", "gram").agg(F.sum("n").alias("n")).collect():
        grams.setdefault(r["language"], {})[r["gram"]] = r["n"]
    for r in own.collect():
        styles.setdefault(r["language"], {})[r["style"]] = r["n"]
    for s in styles.values():
        told = sum(s.get(x, 0) for x in ("snake", "camel", "pascal", "upper")) or 1
        for x in s:
            s[x] /= told
    shared = df.sparkSession.sparkContext.broadcast((grams, styles, _written(counted), libraries))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, styles, hand, names = shared.value
        model, origin = NameModel(grams), Origin(names, hand)
        for batch in batches:
            told = [judge(n, t, model, origin, styles) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.string()), pa.array([x[2] for x in told], pa.float64())], ["key", "name", "reason", "told_by", "bits"])

    return rows.mapInArrow(score, f"key {key_type}, name string, reason string, told_by string, bits double").toDF(key, filename, "reason", "told_by", "bits")


def _written(counted: DataFrame) -> dict[str, list[tuple]]:
    """By kind of text, the rows of Model.counted that the texts which are asked for need: n-grams of all
    orders, as ends of the longest, with the counts of their contexts over the whole corpus."""
    told = counted.where(F.col("style").isin("hand", "asked")).groupBy(F.col("language").alias("kind"), "gram").agg(F.sum("n").alias("n"), F.max(F.col("style") == "asked").alias("asked"))
    ends = told.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ORDER)))).select("kind", F.expr("substring(gram, -k, k)").alias("gram"), F.expr("substring(gram, -k, k - 1)").alias("context"), "n", "asked")
    ends = ends.groupBy("kind", "context", "gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    contexts = ends.groupBy("kind", "context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("different"), F.max("asked").alias("_asked")).where("_asked and total > 0")
    got: dict[str, list[tuple]] = {}
    for r in ends.where("asked").join(contexts.hint("merge"), ["kind", "context"]).select("kind", "gram", "n", "total", "different").collect():
        got.setdefault(r["kind"], []).append(tuple(r)[1:])
    return got
