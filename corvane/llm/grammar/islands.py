"""Functions of source files, broken ones included, as derivations of the grammars.

A file is read as levels: the top, and the content of every bracket and indented block. Where its
brackets don't fit, levels are closed where the layout shows that they ended: at a line that is
indented no deeper than the line that opened them, and at a closing bracket further out. Such a level
holds an error token, which no rule of a language matches.

On every level the recogniser then tries a function at each place where a declaration can begin, in
four steps (marks, head, name, tail), so that what surrounds a function needn't be valid. The end of
the tail is the function's end. A function whose head is whole but whose body isn't is found by a
tail that takes any body, and told apart.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

from .gll import BASE, BRACE, INDENT
from .languages import CLOSES, CLOSING, LINE_END, OPENING, OPENS, OVER, PY_LINES, Invalid, Language, columns

#: Words that begin a line of their own inside of a block without being indented deeper.
LABELS = frozenset(["case", "default", "public", "private", "protected"])
STARTS = re.compile(r"(?:async[ ]+def|def|class|return|if|elif|else|for|while|try|except|finally|with|import|from|raise|pass|break|continue)\b|@\w")


@dataclass(slots=True)
class Level:
    """A sequence of tokens with the numbers of their lexemes (that of the opening bracket for a
    group, -1 - number of the one before for a token without text); below has the levels of groups,
    where a text is sound only of such that are blocks or hold one."""

    reader: Reader
    bracket: int
    opened: int
    indent: int = -1
    row: int = -1
    tokens: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    below: dict[int, Level] = field(default_factory=dict)
    number: int = -1

    def start(self, i: int) -> int:
        k = self.at[i]
        return self.reader.starts[k] if k >= 0 else self.reader.stops[-1 - k]

    def end(self, i: int) -> int:
        k = self.at[i]
        if k < 0:
            return self.reader.stops[-1 - k]
        k = self.reader.closes.get(k, k)
        return self.reader.stops[k] if k >= 0 else 0

    def before(self, i: int) -> int:
        """The end of what stands before a token."""
        return self.end(i - 1) if i else self.reader.stops[self.opened] if self.opened >= 0 else 0


class Reader:
    """Reads the levels of one text. starts and stops are the places of its lexemes; closes has, by
    the lexeme that opens a group, the one that ends it."""

    def __init__(self, spoken: Language, text: str) -> None:
        self.spoken, self.text = spoken, text
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.closes: dict[int, int] = {}

    @cached_property
    def rows(self) -> list[int]:
        """Where the text's lines begin."""
        return list(accumulate([len(x) + 1 for x in self.text.split("\n")[:-1]], initial=0))

    def row(self, place: int) -> int:
        return bisect_right(self.rows, place) - 1

    def margin(self, place: int) -> tuple[int, bool]:
        """(indentation of the line, whether the place is the first of its line)."""
        start = self.rows[self.row(place)]
        lead = re.compile(r"[ \t\f]*").match(self.text, start)
        return columns("\n" + lead.group(0)), lead.end() >= place

    def levels(self) -> tuple[Level, bool]:
        """(top level, whether brackets and lexemes were all right)."""
        python = self.spoken.mode == "py"
        try:
            return (self._sound_python if python else self._sound_braces)(), True
        except Invalid:
            return (self._python if python else self._braces)(), False

    def _lexemes(self, mend: bool, at: int = 0) -> list[str]:
        """The text's lexemes; their places go to starts and stops."""
        spoken, text = self.spoken, self.text
        self.closes = {}
        try:
            if spoken.careful(text):
                told = list(spoken.scan(text))
                self.starts, self.stops = [x[1] for x in told], [x[2] for x in told]
                return [x[0] for x in told]
        except Invalid:
            if not mend:
                raise
        found, self.starts, self.stops = spoken.placed(text, at)
        return found

    def _marks(self, lexemes: list[str]) -> tuple[list[int], list[int]]:
        """(the lexemes' marks, the numbers of those that aren't plain tokens)."""
        spoken = self.spoken
        marks = list(map(spoken.marks.get, lexemes))
        if None in marks:
            marks = [spoken.mark(x) if k is None else k for k, x in zip(marks, lexemes)]
        return marks, [i for i, k in enumerate(marks) if k < 0]

    def _sound_braces(self) -> Level:
        """The levels of a text whose brackets fit. What stands between two brackets or line ends is
        taken at once, and brackets without blocks get no level."""
        spoken, go, js = self.spoken, self.spoken.mode == "go", self.spoken.mode == "js"
        enders, semi, ends_before = spoken.enders, spoken.semi, spoken.ends_before
        group = spoken.recogniser.group
        lexemes = self._lexemes(False)
        closes = self.closes
        marks, places = self._marks(lexemes)
        places.append(len(lexemes))
        marks.append(OVER)
        stack: list[tuple] = []
        tokens: list[int] = []
        at: list[int] = []
        below: dict[int, Level] = {}
        bracket = opened = last = -1
        waiting, done = False, 0
        for i in places:
            if i > done:
                if waiting:
                    waiting = False
                    if ends_before(tokens, marks[done], lexemes[done]):
                        tokens.append(semi)
                        at.append(-1 - last)
                tokens += marks[done:i]
                at += range(done, i)
                last = i - 1
            done = i + 1
            k = marks[i]
            if k == LINE_END:
                if js:
                    waiting = True
                elif go and tokens and (tokens[-1] in enders or tokens[-1] >= BASE):
                    tokens.append(semi)
                    at.append(-1 - last)
            elif k <= CLOSES:
                if bracket != CLOSES - k:
                    raise Invalid("unmatched bracket")
                waiting = False
                number = group(bracket, tuple(tokens))
                level = Level(self, bracket, opened, -1, -1, tokens, at, below, number) if bracket == BRACE or below else None
                closes[opened] = last = i
                start = opened
                tokens, at, below, bracket, opened = stack.pop()
                if level:
                    below[len(tokens)] = level
                tokens.append(number)
                at.append(start)
            elif k <= OPENS:
                if waiting:
                    waiting = False
                    if ends_before(tokens, OPENS - k, lexemes[i]):
                        tokens.append(semi)
                        at.append(-1 - last)
                stack.append((tokens, at, below, bracket, opened))
                tokens, at, below, bracket, opened, last = [], [], {}, OPENS - k, i, i
            elif k == -1:
                raise Invalid("unexpected lexeme")
        if stack:
            raise Invalid("unclosed bracket")
        if go and tokens and (tokens[-1] in enders or tokens[-1] >= BASE):
            tokens.append(semi)
            at.append(-1 - last)
        return Level(self, -1, -1, -1, -1, tokens, at, below)

    def _sound_python(self) -> Level:
        """The same for Python."""
        spoken, nl, groups = self.spoken, self.spoken.nl, self.spoken.recogniser.kinds
        group = spoken.recogniser.group
        lead = PY_LINES.match(self.text)
        lexemes = self._lexemes(False, lead.end() if lead else 0)
        closes = self.closes
        marks, places = self._marks(lexemes)
        places.append(len(lexemes))
        marks.append(OVER)
        stack: list[tuple] = []
        tokens: list[int] = []
        at: list[int] = []
        below: dict[int, Level] = {}
        bracket = opened = last = -1
        indents, done = [0], 0
        for i in places:
            if i > done:
                tokens += marks[done:i]
                at += range(done, i)
                last = i - 1
            done = i + 1
            k = marks[i]
            if k == LINE_END or k == OVER:
                if bracket not in (-1, INDENT):
                    if k == OVER:
                        raise Invalid("unclosed bracket")
                    continue
                # A line ends here, unless one just did.
                if tokens and tokens[-1] != nl and not (tokens[-1] >= BASE and groups[tokens[-1] - BASE] == INDENT):
                    tokens.append(nl)
                    at.append(-1 - last)
                width = columns(lexemes[i]) if k == LINE_END else 0
                if width > indents[-1]:
                    indents.append(width)
                    stack.append((tokens, at, below, bracket, opened))
                    tokens, at, below, bracket, opened = [], [], {}, INDENT, i
                    continue
                while width < indents[-1]:
                    indents.pop()
                    number = group(INDENT, tuple(tokens))
                    level, start = Level(self, INDENT, opened, -1, -1, tokens, at, below, number), opened
                    closes[opened] = last
                    tokens, at, below, bracket, opened = stack.pop()
                    below[len(tokens)] = level
                    tokens.append(number)
                    at.append(start)
                if width != indents[-1]:
                    raise Invalid("unindent")
            elif k <= CLOSES:
                if bracket != CLOSES - k:
                    raise Invalid("unmatched bracket")
                number = group(bracket, tuple(tokens))
                level = Level(self, bracket, opened, -1, -1, tokens, at, below, number) if bracket == BRACE or below else None
                closes[opened] = last = i
                start = opened
                tokens, at, below, bracket, opened = stack.pop()
                if level:
                    below[len(tokens)] = level
                tokens.append(number)
                at.append(start)
            elif k <= OPENS:
                stack.append((tokens, at, below, bracket, opened))
                tokens, at, below, bracket, opened, last = [], [], {}, OPENS - k, i, i
            elif k == -1:
                raise Invalid("unexpected lexeme")
        return Level(self, -1, -1, -1, -1, tokens, at, below)

    def _open(self, bracket: int, number: int) -> Level:
        place = self.starts[number]
        return Level(self, bracket, number, self.margin(place)[0], self.row(place))

    def _close(self, stack: list[Level], last: int, broken: bool = False) -> None:
        """Ends the innermost level with the lexeme `last`."""
        done = stack.pop()
        if broken:
            done.tokens.append(self.spoken.err)
            done.at.append(-1 - last)
        done.number = self.spoken.recogniser.group(done.bracket, tuple(done.tokens))
        self.closes[done.opened] = last
        outer = stack[-1]
        outer.below[len(outer.tokens)] = done
        outer.tokens.append(done.number)
        outer.at.append(done.opened)

    def _braces(self) -> Level:
        """The levels of a text in which something doesn't fit."""
        spoken, go, js = self.spoken, self.spoken.mode == "go", self.spoken.mode == "js"
        kinds, enders, semi = spoken.kinds, spoken.enders, spoken.semi
        lexemes = self._lexemes(True)
        here = Level(self, -1, -1)
        stack = [here]
        waiting, last = False, -1

        for number, x in enumerate(lexemes):
            k = kinds.get(x)
            if k is None:
                k = spoken._new_kind(x)
            if k == -2:
                if go:
                    if here.tokens and (here.tokens[-1] in enders or here.tokens[-1] >= BASE):
                        here.tokens.append(semi)
                        here.at.append(-1 - last)
                else:
                    waiting = True
                continue
            if k == -3:
                continue
            if k == -1:
                k = spoken.err
            if len(stack) > 1:
                place = self.starts[number]
                width, leads = self.margin(place)
                if leads and x not in CLOSING:
                    while len(stack) > 1 and width <= stack[-1].indent and self.row(place) > stack[-1].row and not (width == stack[-1].indent and x in LABELS):
                        self._close(stack, last, True)
                elif leads and x == "}":
                    # A brace closes the level that its own line's indentation opened.
                    while len(stack) > 2 and width < stack[-1].indent and any(v.bracket == BRACE and v.indent <= width for v in stack[1:-1]):
                        self._close(stack, last, True)
                here = stack[-1]
            if waiting:
                waiting = False
                if js and spoken.ends_before(here.tokens, k, x):
                    here.tokens.append(semi)
                    here.at.append(-1 - last)
            if x in OPENING:
                here = self._open(OPENING[x], number)
                stack.append(here)
            elif x in CLOSING:
                if len(stack) < 2 or here.bracket != CLOSING[x]:
                    if not any(v.bracket == CLOSING[x] for v in stack[1:]):
                        here.tokens.append(spoken.err)
                        here.at.append(number)
                        last = number
                        continue
                    while stack[-1].bracket != CLOSING[x]:
                        self._close(stack, last, True)
                self._close(stack, number)
                here = stack[-1]
            else:
                here.tokens.append(k)
                here.at.append(number)
            last = number
        while len(stack) > 1:
            self._close(stack, last, True)
        top = stack[0]
        if go and top.tokens and (top.tokens[-1] in enders or top.tokens[-1] >= BASE):
            top.tokens.append(semi)
            top.at.append(-1 - last)
        return top

    def _python(self) -> Level:
        spoken, nl = self.spoken, self.spoken.nl
        kinds, groups = spoken.kinds, spoken.recogniser.kinds
        lead = PY_LINES.match(self.text)
        lexemes = self._lexemes(True, lead.end() if lead else 0)
        stack = [Level(self, -1, -1)]
        indents, last = [0], -1

        def line_end() -> None:
            """A line ends here, unless one just did."""
            tokens = stack[-1].tokens
            if tokens and tokens[-1] != nl and not (tokens[-1] >= BASE and groups[tokens[-1] - BASE] == INDENT):
                tokens.append(nl)
                stack[-1].at.append(-1 - last)

        for number, x in enumerate(lexemes):
            if x[0] == "\n":
                width = columns(x)
                if stack[-1].bracket not in (-1, INDENT):
                    if width > stack[-1].indent or not STARTS.match(self.text, self.stops[number]):
                        continue
                    while stack[-1].bracket not in (-1, INDENT):
                        self._close(stack, last, True)
                line_end()
                if width > indents[-1]:
                    indents.append(width)
                    stack.append(Level(self, INDENT, number))
                    continue
                while width < indents[-1]:
                    indents.pop()
                    self._close(stack, last)
                continue
            k = kinds.get(x)
            if k is None:
                k = spoken._new_kind(x)
            if k < -1:
                continue
            if k == -1:
                k = spoken.err
            if x in OPENING:
                stack.append(self._open(OPENING[x], number))
            elif x in CLOSING:
                if stack[-1].bracket != CLOSING[x]:
                    inner = []
                    for v in reversed(stack):
                        if v.bracket in (-1, INDENT):
                            break
                        inner.append(v.bracket)
                    if CLOSING[x] not in inner:
                        stack[-1].tokens.append(spoken.err)
                        stack[-1].at.append(number)
                        last = number
                        continue
                    while stack[-1].bracket != CLOSING[x]:
                        self._close(stack, last, True)
                self._close(stack, number)
            else:
                stack[-1].tokens.append(k)
                stack[-1].at.append(number)
            last = number
        while len(stack) > 1:
            if stack[-1].bracket != INDENT:
                self._close(stack, last, True)
            else:
                line_end()
                self._close(stack, last)
        line_end()
        return stack[0]


@dataclass
class Function:
    """A function's derivation: its level, the tokens where its marks, its signature and its name are
    and where it ends, and whether its body is valid too."""

    level: Level
    first: int
    signature: int
    name: int
    end: int
    valid: bool


def walk(top: Level) -> Iterator[Level]:
    todo = [top]
    while todo:
        level = todo.pop()
        yield level
        todo += level.below.values()


#: Words of which every function outside of a class has one on its own level; elsewhere, a
#: parenthesis tells.
WORDS = {"py": ("def",), "go": ("func",), "rs": ("fn",), "js": ("function", "=>"), "ts": ("function", "=>"), "jsx": ("function", "=>"), "tsx": ("function", "=>")}


def functions(spoken: Language, text: str, reader: Reader | None = None) -> list[Function]:
    """Every function that a derivation of the language's function rules covers, in no order."""
    spoken.rest()
    top, sound = (reader or Reader(spoken, text)).levels()
    grammar, recogniser, number = spoken.grammar, spoken.recogniser, spoken.terms.number
    names, kinds = grammar.names, recogniser.kinds
    sets = [tuple(names[p + part] for part in ("Marks", "Head", "Name", "Tail", "Loose", "")) + (p == "Method",) for p in ("Function", "Method") if f"{p}Marks" in names]
    before = {number[x] for x in (";", "nl") if x in number} | {spoken.err} | ({number[":"]} if spoken.name in ("cpp", "c", "h") else set())
    statements, members = names.get("Stmts", -1), names.get("Members", -1)
    words = [number[w] for w in WORDS.get(spoken.name, ())]
    out: list[Function] = []
    for level in walk(top):
        if level.bracket not in (-1, BRACE, INDENT) or not level.tokens:
            continue
        accepted = recogniser.accepted[level.number - BASE] if level.number >= BASE else frozenset()
        plain = statements in accepted and members not in accepted or level.bracket == -1 and sound and spoken.mode == "js"
        tried = [x for x in sets if not (plain if x[-1] else words and not any(w in level.tokens for w in words))]
        if not tried:
            continue
        tokens = level.tokens
        shapes = [t if t < BASE else kinds[t - BASE] for t in tokens]
        begins = {x for *_, whole, _ in tried for x in grammar.predict[whole]}
        places = [i for i, shape in enumerate(shapes) if shape in begins and (not i or tokens[i - 1] in before or shapes[i - 1] in (BRACE, INDENT))]
        if not places:
            continue
        line = recogniser.line(tuple(tokens))
        seen: set[int] = set()
        for i in places:
            for *parts, whole, _ in tried:
                if shapes[i] not in grammar.predict[whole]:
                    continue
                got = _derived(recogniser, line, i, parts)
                if got and got[1] not in seen:
                    seen.add(got[1])
                    out.append(Function(level, i, *got))
    return out


def _derived(recogniser, line, i: int, parts: list[int]) -> tuple[int, int, int, bool] | None:
    """(signature, end of the name, end, valid) of the function that begins at token i; where several
    derivations do, the one with most marks, the shortest head and the longest tail."""
    marks, head, name, tail, loose = parts
    for last, valid in ((tail, True), (loose, False)):
        for m in sorted(recogniser.ends_from(marks, line, i), reverse=True):
            for h in sorted(recogniser.ends_from(head, line, m)):
                for e in sorted(recogniser.ends_from(name, line, h)):
                    ends = recogniser.ends_from(last, line, e)
                    if ends:
                        return m, e, max(ends), valid
    return None
