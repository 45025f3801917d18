"""Character n-gram models of what files say about their origin.

A file tells where it comes from in its opening comment, in the folders it lies in and in the end of
its name. Each such piece of text is given to the class whose n-gram model needs the fewest bits for
it: what generators write, what third-party libraries write, what people write who took a file over,
and what people write otherwise. The first three are trained on phrases that public tools and
licences use, the last on all comments, folders and names of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

HAND, GENERATED, VENDORED, MINIFIED, KEPT = "hand", "generated", "vendored", "minified", "kept"

# How public tools and licences mark files, with # for the name of a tool or library and
# 0 for numbers.
NOTES = {
    GENERATED: (
        "code generated by #. do not edit.", "code generated by #-gen. do not edit.", "code generated by # v0.0. do not edit.", "generated by the protocol buffer compiler. do not edit!", "@generated by # from x.schema", "@generated by #", "@generated", "<auto-generated> tool # 0.0 </auto-generated>", "<auto-generated>", "<auto-generated/>",
        "this file was automatically generated by #.", "this file was automatically produced by the # compiler.", "this file is automatically generated", "this file is generated by #, do not edit", "this code was generated by a tool.", "this is an autogenerated file", "autogenerated by # v0.0; do not modify by hand", "auto-generated by # do not edit", "autogenerated file - changes will be overwritten", "auto-generated file, do not edit or modify by hand",
        "changes to this file will be overwritten", "generated from x.proto, edit the source instead", "generated from x.proto by #", "generated with #. do not edit this file", "automatically generated by #, do not modify", "do not edit this file by hand", "do not edit - generated file", "generated file. do not edit", "source: x.proto",
        "diese datei wurde automatisch erzeugt (#).", "diese datei wurde automatisch generiert", "automatisch erzeugt, nicht bearbeiten", "ce fichier a été généré automatiquement par #", "fichier généré automatiquement", "archivo generado automáticamente por #", "este archivo fue generado automáticamente", "此文件由工具自动生成，请勿修改", "自动生成",
    ),
    VENDORED: (
        "@license # 0.0.0 (bsd-0-clause)", "@license # v0.0.0", "# v0.0.0 | mit license", "# v0.0 | mit", "# v0.0 | bsd", "# v0.0.0 | apache-0.0", "# v0.0.0 (c) 0 | isc license", "# javascript library v0.0.0", "part of the # library, version 0.0", "this file is part of the # library", "copyright (c) the # contributors", "copyright (c) 0 the # contributors", "copyright (c) 0 # project contributors", "# 0.0 - bundled copy, see upstream for changes", "# 0.0.0 - bundled copy", "vendored copy of # 0.0", "this is a copy of # 0.0", "taken from # 0.0, see upstream", "upstream: #",
    ),
    KEPT: (
        "first generated by #, maintained by hand since the rewrite.", "first generated by #-gen, maintained by hand since the rewrite.", "originally generated by #, now edited by hand", "initially generated, since then maintained manually", "no longer generated, edit freely", "was generated once, kept by hand since", "generated by # at first, rewritten by hand since",
    ),
    HAND: ("copyright the authors. all rights reserved.", "copyright (c) 0 the authors. all rights reserved.", "spdx-license-identifier: apache-0.0", "spdx-license-identifier: mit", "licensed under the apache license", "talks to the generator of the team.", "talks to the # generator of the team.", "finds files marked as generated and skips them in the view.", "do not edit the list while the job runs.", "nobody should edit this by hand; run the tool instead.", "helpers that generate reports; edit the template next to this file.", "vendor accounts and their terms.", "wrapper around #", "adapter for #", "uses # to read the files"),
}
FOLDERS = {VENDORED: ("vendor", "vendored", "_vendor", "third_party", "third-party", "thirdparty", "0rdparty", "0rd_party", "0rd-party", "node_modules", "bower_components", "jspm_packages", "site-packages", "external", "externals", "extern", "deps/src", "godeps")}
ENDINGS = {
    GENERATED: ("_pb0.py", "_pb0.pyi", "_pb0_grpc.py", "_grpc.py", ".pb.go", ".pb.cc", ".pb.cpp", ".pb.h", ".pb.rs", ".pb.ts", ".pb.js", ".pb.java", "_pb.js", "_pb.ts", ".generated.ts", ".generated.js", ".generated.go", ".generated.java", ".generated.rs", ".generated.py", ".generated.cpp", "_generated.go", "_generated.py", "_generated.ts", "_generated.rs", ".gen.go", ".gen.ts", ".gen.rs", ".gen.py", ".gen.js", ".gen.java", "_gen.go", "_gen.py", "_gen.rs", ".g.java", ".g.ts", ".g.cpp", ".g.py", ".g.rs", ".designer.py", ".designer.cpp", ".freezed.ts"),
    MINIFIED: (".min.js", ".min.mjs", ".min.ts", "-min.js", ".bundle.js", ".bundle.ts", ".umd.js", ".prod.js", ".packed.js"),
}
ORDER = 5
BEFORE = "\x02" * (ORDER - 1)


@lru_cache(maxsize=200_000)
def folded(text: str) -> str:
    """Lower case, numbers as 0, blanks as one, without comment marks."""
    text = re.sub(r"^\W*?(?=[\w@<#(])|[\s*/\"'-]+$", "", text.strip())
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", text.lower()))


def ending(base: str) -> str:
    """What follows the own part of a file's name: from its first dot, or the last _ or - before it."""
    own = re.sub(r"\d+", "0", base.lower().lstrip("._"))
    dot = own.find(".")
    if dot < 0:
        return ""
    stem = own[:dot].removesuffix("_grpc")
    mark = max(stem.rfind("_"), stem.rfind("-"))
    return own[mark:] if mark > 0 and own.count(".") == 1 else own[dot:]


def folders(path: str) -> list[str]:
    """The folders below the first one, alone and with the one that follows."""
    parts = re.sub(r"\d+", "0", path.lower()).split("/")[1:-1]
    return [*parts, *(f"{a}/{b}" for a, b in zip(parts, parts[1:]))]


def runs(text: str, order: int = ORDER) -> list[str]:
    """The n-grams of the whole text; those of lower orders are their ends."""
    padded = "\x02" * (order - 1) + text + "\x03"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Runs:
    """Counts of the n-grams of texts, as runs() gives them; few texts are held at a time."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.uses: list[int] = []
        self.size = 0
        self.sums: dict[str, int] = {}

    def add(self, text: str, n: int) -> None:
        self.texts.append(text)
        self.uses.append(n)
        self.size += len(text) + ORDER
        if self.size > 200_000:
            self.flush()

    def flush(self) -> None:
        whole = "".join([f"{BEFORE}{x}\x03" for x in self.texts])
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) + ORDER
        # Those that span two texts count nothing.
        n = np.repeat(np.array(self.uses, np.int64), sizes)
        ends = np.cumsum(sizes)
        for k in range(1, ORDER):
            n[ends - k] = 0
        signs = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        known, signs = np.unique(signs, return_inverse=True)
        last, code = len(whole) - ORDER + 1, signs[: len(whole) - ORDER + 1]
        for k in range(1, ORDER):
            if int(code.max()) + 1 > 2**62 // len(known):
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(known) + signs[k : last + k]
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        for i, x in zip(first.tolist(), np.bincount(which, n[:last]).astype(np.int64).tolist()):
            if x:
                gram = whole[i : i + ORDER]
                self.sums[gram] = self.sums.get(gram, 0) + x
        self.texts, self.uses, self.size = [], [], 0

    def counts(self) -> dict[str, int]:
        if self.texts:
            self.flush()
        return self.sums


class Model:
    """An n-gram model of characters whose orders are mixed by how many different characters each
    context was followed by."""

    def __init__(self, texts, order: int = ORDER) -> None:
        self.order = order
        self.follow: defaultdict[str, Counter[str]] = defaultdict(Counter)
        for text in texts:
            padded = "\x02" * (order - 1) + text + "\x03"
            for i in range(order - 1, len(padded)):
                for k in range(order):
                    self.follow[padded[i - k : i]][padded[i]] += 1
        self.table = {c: (f, sum(f.values()), len(f)) for c, f in self.follow.items()}
        self.memo: dict[str, float] = {}
        del self.follow

    @classmethod
    def counted(cls, rows) -> Model:
        """From (n-gram of any order, its count, that of its context, how many characters followed it)."""
        made = cls(())
        for gram, n, total, different in rows:
            made.table.setdefault(gram[:-1], ({}, total, different))[0][gram[-1]] = n
        return made

    def bits(self, text: str, most: float = math.inf) -> float:
        """Bits of the whole text; infinite if they are more than `most`."""
        memo, out = self.memo, 0.0
        for gram in runs(text, self.order):
            told = memo.get(gram)
            if told is None:
                told = self.last(gram)
                if len(memo) < 200_000:
                    memo[gram] = told
            out += told
            if out > most:
                return math.inf
        return out

    def last(self, gram: str) -> float:
        """Bits of the last character of an n-gram of the longest order."""
        p, c, end = 1 / 256, gram[-1], len(gram) - 1
        for k in range(self.order):
            told = self.table.get(gram[end - k : end])
            if told is None:
                break
            p = (told[0].get(c, 0) + told[2] * p) / (told[1] + told[2])
        return -math.log2(p)


class Classes:
    """Models of one kind of text, one of them for what people write. A text belongs to another
    class only if that needs `least` bits fewer than the hand-written model, per character or in all,
    and few bits by itself: at most MOST per character, and for names, which are too short to be
    alike by chance only, no more than the least probable of the class's own examples."""

    MOST = 4.5

    def __init__(self, seeds: dict[str, tuple[str, ...]], hand: Model, least: float, per_character: bool) -> None:
        self.models = {name: Model(texts) for name, texts in seeds.items() if name != HAND}
        # What the seeds name is no example of what people write, however often a corpus has it.
        self.marks = {t for name, texts in seeds.items() if name != HAND for t in texts}
        self.hands = [hand, *([Model(seeds[HAND])] if seeds.get(HAND) else [])]
        self.least, self.per_character = least, per_character
        self.bounds = {name: max(m.bits(t) for t in seeds[name]) + 0.5 for name, m in self.models.items()}
        self.memo: dict[str, str] = {}
        self.told: dict[str, tuple[float, str]] = {}

    def nearest(self, text: str) -> tuple[float, str]:
        """(bits, class) of the class other than the hand-written one that needs the fewest bits; only
        where these are finite does the hand-written model have a say."""
        got = self.told.get(text)
        if got is None:
            most = self.MOST * (len(text) + 1)
            got = min((m.bits(text, most if self.per_character else min(most, self.bounds[n])), n) for n, m in self.models.items())
            if len(self.told) < 200_000:
                self.told[text] = got
        return got

    def best(self, text: str) -> str:
        got = self.memo.get(text)
        if got is None:
            bits, name = self.nearest(text)
            got = HAND
            if bits < math.inf:
                gain = min(m.bits(text) for m in self.hands) - bits
                if gain > self.least * (len(text) + 1 if self.per_character else 1):
                    got = name
            if len(self.memo) < 200_000:
                self.memo[text] = got
        return got


class Origin:
    """Judges files by their opening comment, folders and name. hand: by kind of text, the rows of the
    model of what people write."""

    def __init__(self, libraries: list[str], hand: dict[str, list[tuple]] | None = None) -> None:
        self.libraries = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(libraries, key=len, reverse=True))) + r")\b") if libraries else None
        told = lambda kind: Model.counted((hand or {}).get(kind, ()))
        self.kinds = {"notes": Classes(NOTES, told("notes"), 0.4, True), "folders": Classes(FOLDERS, told("folders"), 2.0, False), "endings": Classes(ENDINGS, told("endings"), 2.0, False)}

    def folded(self, line: str) -> str:
        text = folded(line)
        return self.libraries.sub("#", text) if self.libraries else text

    def texts(self, path: str, note: list[str]) -> list[tuple[str, str]]:
        """(kind, text) of all that is judged of a file."""
        return [*(("notes", x) for x in map(self.folded, note) if x), *(("folders", x) for x in folders(path)), ("endings", ending(path.rpartition("/")[2]))]

    def examples(self, path: str, comments: list[str]) -> list[tuple[str, str]]:
        """(kind, text) of what a file adds to the models of what people write."""
        told = [*(("notes", self.folded(x)) for x in comments), *(("folders", x) for x in folders(path)), ("endings", ending(path.rpartition("/")[2]))]
        return [(kind, x) for kind, x in told if x not in self.kinds[kind].marks]

    def classes(self, path: str, note: list[str]) -> set[str]:
        """The classes of a file's opening comment, folders and ending, without the hand-written one."""
        return {self.kinds[kind].best(x) for kind, x in self.texts(path, note)} - {HAND}
