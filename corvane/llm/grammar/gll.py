"""A generalised LL recogniser over a graph-structured stack, and a notation for grammars.

Tokens are integers. A pair of brackets with all that it holds is one token: contents that match the
same symbols get the same number, so that each shape is parsed once however often it occurs. A
grammar refers to such a token together with the symbol its content must match.

Notation, one rule per `Name = ...`: 'x' a terminal, Name a symbol, @word any word, @any any token,
@flat any token but a line end, a semicolon and a block, (| X |) [| X |] {| X |} a bracketed group
with content X, <| X |> an indented block, $ the end of the sequence, ( ) ? * + | as usual, and
X % ',' for a list with a separator.

What a symbol can match from a place on depends on no more tokens than the parse has looked at. So the
ends of list items are remembered together with exactly these tokens, whatever follows them.
"""

from __future__ import annotations

import re

LEX = re.compile(r"\s*(?:(?P<t>'[^']+')|(?P<n>[A-Z]\w*)|(?P<c>@\w+)|(?P<o>\(\||\[\||\{\||<\|)|(?P<e>\|\)|\|\]|\|\}|\|>)|(?P<p>[()|?*+%$]))")
RULE = re.compile(r"^([A-Z]\w*)\s*(\+?=)(?!=)", re.M)
PAREN, BRACKET, BRACE, INDENT = 0, 1, 2, 3
#: Numbers below are brackets themselves; groups are numbered from BASE.
FIRST_KIND, BASE = 4, 1 << 20
#: What stands behind the last token of every sequence.
END = -1
#: Kinds of grammar symbols.
TOKENS, SYMBOL, GROUP, LOOP, LAST, RUN = range(6)


class Terms:
    """Numbers of token kinds, shared by the lexer and the grammar of a language."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words: set[int] = set()

    def __call__(self, name: str) -> int:
        got = self.number.get(name)
        if got is None:
            got = self.number[name] = FIRST_KIND + len(self.number)
            if re.fullmatch(r"[A-Za-z_]\w*", name) and name not in ("num", "str", "tmpl", "regex", "err", "pp", "life"):
                self.words.add(got)
        return got


class Grammar:
    """Rules compiled to alternatives of (TOKENS, kinds), (SYMBOL, symbol), (GROUP, bracket, symbol)
    (LAST,), the end, (LOOP, symbol), which is the symbol any number of times, and (RUN, kinds),
    tokens of these kinds any number of times."""

    def __init__(self, text: str, terms: Terms, items: tuple[str, ...] = ()) -> None:
        self.terms, self.names, self.alts, self.separated = terms, {}, [], []
        self.made: dict[tuple, int] = {}
        spans = list(RULE.finditer(text))
        for m, nxt in zip(spans, [*spans[1:], None]):
            self._named(m.group(1))
        for m, nxt in zip(spans, [*spans[1:], None]):
            body = text[m.end() : nxt.start() if nxt else len(text)]
            self.tokens, self.at = self._lex(body), 0
            alternatives = self._alternatives()
            if self.at < len(self.tokens):
                raise ValueError(f"rule {m.group(1)}: unread {self.tokens[self.at :]}")
            self.alts[self.names[m.group(1)]] += alternatives
        for name, k in self.names.items():
            if not self.alts[k]:
                raise ValueError(f"no rule for {name}")
        #: By bracket, the symbols that rules put inside of it.
        self.inside: list[list[int]] = [sorted({s[2] for x in self.alts for a in x for s in a if s[0] == GROUP and s[1] == b}) for b in range(FIRST_KIND)]
        #: Symbols whose ends are remembered: items of comma lists, and those that a language names.
        self.items = {*self.separated, *(self.names[x] for x in items)}
        #: Symbols whose rules are those of another symbol but for alternatives that begin with a
        #: token: symbol -> (other symbol, token).
        self.stricter: dict[int, tuple[int, int]] = {}
        #: Symbols that match all that another symbol does, and more only where one of some tokens is:
        #: symbol -> (other symbol, tokens), in an order in which the other symbols come first.
        self.wider: dict[int, tuple[int, frozenset[int]]] = {}
        #: Symbols that have a token only behind one of some others: (symbols, token, others).
        self.barred: tuple[frozenset[int], int, frozenset[int]] = frozenset(), -9, frozenset()
        self._prepare()

    def _named(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.alts)
            self.alts.append([])
        return self.names[name]

    def _fresh(self, alternatives: list) -> tuple:
        """A symbol without a name; equal ones are one."""
        if len(alternatives) == 1 and len(alternatives[0]) == 1 and alternatives[0][0][0] == SYMBOL:
            return alternatives[0][0]
        key = tuple(map(tuple, alternatives))
        if key not in self.made:
            self.made[key] = len(self.alts)
            self.alts.append(alternatives)
        return (SYMBOL, self.made[key])

    @staticmethod
    def _lex(body: str) -> list[tuple[str, str]]:
        out, at = [], 0
        body = body.rstrip()
        while at < len(body):
            m = LEX.match(body, at)
            if not m or m.end() == at:
                raise ValueError(f"bad grammar near {body[at : at + 30]!r}")
            out.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        return out

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def _alternatives(self) -> list[list[tuple]]:
        out = [self._sequence()]
        while self._peek() == ("p", "|"):
            self.at += 1
            out.append(self._sequence())
        return out

    def _sequence(self) -> list[tuple]:
        out: list[tuple] = []
        while True:
            kind, text = self._peek()
            if kind in ("", "e") or (kind, text) in (("p", "|"), ("p", ")")):
                return out
            self.at += 1
            if kind == "t":
                symbol: tuple = (TOKENS, frozenset([self.terms(text[1:-1])]))
            elif kind == "n":
                symbol = (SYMBOL, self._named(text))
            elif kind == "c":
                symbol = ("c", text)
            elif kind == "o":
                inner = self._fresh(self._alternatives())
                self.at += 1
                symbol = (GROUP, {"(|": PAREN, "[|": BRACKET, "{|": BRACE, "<|": INDENT}[text], inner[1])
            elif text == "(":
                inner = self._alternatives()
                self.at += 1
                symbol = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._fresh(inner)
            elif text == "$":
                symbol = (LAST,)
            else:
                raise ValueError(f"unexpected {text}")
            while self._peek()[1] in ("?", "*", "+", "%") and self._peek()[0] == "p":
                op = self._peek()[1]
                self.at += 1
                if op == "?":
                    symbol = self._fresh([[symbol], []])
                elif op == "%":
                    separator = (TOKENS, frozenset([self.terms(self._peek()[1][1:-1])]))
                    self.at += 1
                    step = self._fresh([[separator, symbol]])
                    self.separated.append(step[1])
                    symbol = self._fresh([[symbol, (LOOP, step[1])]])
                else:
                    step = symbol if symbol[0] == SYMBOL else self._fresh([[symbol]])
                    symbol = (LOOP, step[1]) if op == "*" else self._fresh([[step, (LOOP, step[1])]])
            out.append(symbol)

    def _prepare(self) -> None:
        """First sets, and for every symbol the alternatives that a token can begin."""
        every = frozenset([*range(FIRST_KIND), *self.terms.number.values()])
        words = frozenset(self.terms.words)
        blocks = frozenset([BRACE, INDENT, *(self.terms.number[x] for x in (";", "nl") if x in self.terms.number)])
        classes = {"@word": (TOKENS, words), "@any": (TOKENS, every), "@flat": (TOKENS, every - blocks)}
        for alternatives in self.alts:
            for k, alternative in enumerate(alternatives):
                alternatives[k] = tuple(classes[s[1]] if s[0] == "c" else s for s in alternative)
        self._flatten()
        n = len(self.alts)
        first: list[set[int]] = [set() for _ in range(n)]
        empty = [False] * n

        def of(alternative: tuple) -> tuple[set[int], bool]:
            out: set[int] = set()
            for s in alternative:
                if s[0] == TOKENS:
                    return out | s[1], False
                if s[0] == RUN:
                    out |= s[1]
                    continue
                if s[0] == GROUP:
                    return out | {s[1]}, False
                if s[0] == LAST:
                    return out | {END}, False
                out |= first[s[1]]
                if s[0] == SYMBOL and not empty[s[1]]:
                    return out, False
            return out, True

        changed = True
        while changed:
            changed = False
            for k in range(n):
                for alternative in self.alts[k]:
                    f, e = of(alternative)
                    if not f <= first[k] or e and not empty[k]:
                        first[k] |= f
                        empty[k] |= e
                        changed = True
        self.predict: list[dict[int, list]] = []
        number = 0
        for k in range(n):
            table: dict[int, list] = {}
            for alternative in self.alts[k]:
                f, e = of(alternative)
                entry = (number, alternative, len(alternative))
                number += len(alternative) + 1
                for token in (*every, END) if e else f:
                    table.setdefault(token, []).append(entry)
            self.predict.append(table)


    def _flatten(self) -> None:
        """Puts symbols that are one of several tokens, and such that have one alternative only, in the
        place of their names: a parse then needs no stack node for them."""
        changed = True
        while changed:
            changed = False
            for k, alternatives in enumerate(self.alts):
                for j, alternative in enumerate(alternatives):
                    out: list[tuple] = []
                    for s in alternative:
                        below = self.alts[s[1]] if s[0] in (SYMBOL, LOOP) else []
                        if s[0] in (SYMBOL, LOOP) and below and all(len(a) == 1 and a[0][0] == TOKENS for a in below):
                            out.append((TOKENS if s[0] == SYMBOL else RUN, frozenset().union(*(a[0][1] for a in below))))
                        elif s[0] == SYMBOL and s[1] not in self.items and s[1] != k and len(below) == 1 and len(below[0]) + len(alternative) <= 16 and not any(x[0] == SYMBOL and x[1] in (k, s[1]) for x in below[0]):
                            out += below[0]
                        else:
                            out.append(s)
                    if tuple(out) != alternative:
                        alternatives[j] = tuple(out)
                        changed = True


class Line:
    """A sequence of tokens on which parses run."""

    __slots__ = ("tokens", "shapes", "n", "cuts")

    def __init__(self, tokens: tuple, kinds: list[int], cutting: frozenset[int], remembered: bool) -> None:
        self.n = len(tokens)
        self.tokens = tokens + (END,)
        self.shapes = [t if t < BASE else kinds[t - BASE] for t in self.tokens]
        #: Where the memory of item ends looks first; empty where a parse does without.
        self.cuts: list[int] = []
        if remembered:
            cuts, last = [self.n] * (self.n + 1), self.n
            for i in range(self.n - 1, -1, -1):
                if self.shapes[i] in cutting:
                    last = i + 1
                cuts[i] = last
            self.cuts = cuts


#: Sequences up to this length are parsed without remembering the ends of their items.
SHORT = 8
#: Parses of items run inside of each other to this depth; deeper ones share one stack.
DEEP = 24
#: Beginnings of up to so many tokens that a symbol can't have are remembered.
PREFIX = 8
MORE = ((), -1)


class Recogniser:
    """Recognises sequences of tokens whose groups are interned here."""

    #: Beyond so many groups all memory of earlier files is dropped, between two files.
    KEPT = 400_000

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        number = grammar.terms.number
        #: Tokens behind which an item may end; they only decide how far the memory looks at first.
        self.cutting = frozenset([BRACE, INDENT, *(number[x] for x in (";", ",", "nl") if x in number)])
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.kinds: list[int] = []
        self.accepted: list[frozenset[int]] = []
        self.known: dict[tuple, bool] = {}
        #: By symbol and length, beginnings of which the symbol has no sequence.
        self.refused: dict[int, dict[int, set[tuple]]] = {}
        self.ends: dict[tuple, tuple] = {}
        self.classes: dict[tuple, int] = {}

    def size(self) -> int:
        return len(self.numbers) + len(self.known) + len(self.ends)

    def group(self, bracket: int, content: tuple) -> int:
        """The number of a group. Contents that match the same symbols of the grammar can't be told
        apart by any rule, so that they share one number."""
        key = (bracket, content)
        got = self.numbers.get(key)
        if got is None:
            accepted = self._accepted(bracket, content)
            got = self.classes.get((bracket, accepted))
            if got is None:
                got = self.classes[bracket, accepted] = BASE + len(self.kinds)
                self.kinds.append(bracket)
                self.accepted.append(accepted)
            self.numbers[key] = got
        return got

    def _accepted(self, bracket: int, content: tuple) -> frozenset[int]:
        strict, wider, inside = self.grammar.stricter, self.grammar.wider, self.grammar.inside[bracket]
        out = {s for s in inside if s not in strict and s not in wider and self.matches(s, content)}
        barred, token, others = self.grammar.barred
        if token not in content or all(t != token or b in others for b, t in zip((-9, *content), content)):
            barred = frozenset()
        for s in inside:
            if s in strict and s not in barred and (other := strict[s][0]) in out:
                # Where neither the token nor a group that differs occurs, both are the same.
                below = [self.accepted[t - BASE] for t in content if t >= BASE]
                same = strict[s][1] not in content and not any(o in a and x not in a for a in below for x, (o, _) in strict.items())
                if same or self.matches(s, content):
                    out.add(s)
        for s, (other, tokens) in wider.items():
            if s in inside and s not in barred and (other in out or (other not in inside or not tokens.isdisjoint(content)) and self.matches(s, content)):
                out.add(s)
        return frozenset(out)

    def line(self, tokens: tuple, remembered: bool = True) -> Line:
        return Line(tokens, self.kinds, self.cutting, remembered)

    def matches(self, symbol: int, tokens: tuple) -> bool:
        """Whether a whole sequence is one of the symbol."""
        head = END if not tokens else tokens[0] if tokens[0] < BASE else self.kinds[tokens[0] - BASE]
        if head not in self.grammar.predict[symbol]:
            return False
        ended = tokens[:PREFIX] + (END,)
        refused = self.refused.setdefault(symbol, {})
        for n, beginnings in refused.items():
            if ended[:n] in beginnings:
                return False
        key = (symbol, tokens)
        got = self.known.get(key)
        if got is None:
            line = self.line(tokens, len(tokens) > SHORT)
            ends, looked = self._run(symbol, line, 0, 0, line.n)
            got = self.known[key] = line.n in ends
            if not got and (n := max(looked, *ends, 0) + 1) <= PREFIX:
                # Whatever begins so is none of the symbol: no token behind was looked at, and none of
                # the ends is the end of the sequence.
                refused.setdefault(n, set()).add(ended[:n])
        return got

    def ends_from(self, symbol: int, line: Line, start: int) -> tuple[int, ...]:
        """Every place where a sequence of the symbol that begins at `start` can end."""
        return tuple(start + e for e in self._item(symbol, line, start, 0)[0])

    def _item(self, symbol: int, line: Line, start: int, depth: int) -> tuple[tuple[int, ...], int]:
        """(lengths, number of tokens looked at) of the symbol from a place on, from memory where the
        tokens looked at are known."""
        tokens, n, known = line.tokens, line.n, self.ends
        cut, stop, turn = line.cuts[start], line.cuts[start], 0
        asked = None
        while True:
            if cut >= n:
                stop = n + 1
            key = (symbol, tokens[start:stop])
            got = known.get(key) if asked is None else None
            if got is None:
                if asked is None:
                    ends, looked = self._run(symbol, line, start, depth)
                    asked = tuple([e - start for e in ends]), looked - start
                if asked[1] < stop - start:
                    known[key] = asked
                    return asked
                known[key] = MORE
            elif got is not MORE:
                return got
            # First one token more, then twice as many.
            turn += 1
            if turn == 1:
                stop = cut + 1
            else:
                cut = line.cuts[min(n, start + 2 * (cut - start))]
                stop = cut + 1

    def _run(self, symbol: int, line: Line, start: int, depth: int, goal: int = -1) -> tuple[set[int], int]:
        """(ends, last place looked at). Descriptors are (alternative, place in it, position, stack
        node). A stack node is a symbol at a position: (ends, returns, numbers of its descriptors that
        were taken up); a return continues an alternative of a calling node. With a goal, the parse
        stops where it is reached."""
        predict, items, accepted = self.grammar.predict, self.grammar.items, self.accepted
        tokens, shapes = line.tokens, line.shapes
        remember = bool(line.cuts) and depth < DEEP
        root: tuple[set, list, set] = (set(), [], set())
        nodes = {(symbol, start): root}
        width = line.n + 2
        looked = start
        todo = [(a, 0, start, root) for a in predict[symbol].get(shapes[start], ())]
        while todo:
            alternative, k, i, node = todo.pop()
            number, body, size = alternative
            # Every place in an alternative has a number of its own.
            mark = (number + k) * width + i
            if mark in node[2]:
                continue
            node[2].add(mark)
            while k < size:
                if i > looked:
                    looked = i
                s = body[k]
                kind = s[0]
                if kind == TOKENS:
                    if shapes[i] not in s[1]:
                        break
                    i += 1
                elif kind == GROUP:
                    if shapes[i] != s[1] or tokens[i] < BASE or s[2] not in accepted[tokens[i] - BASE]:
                        break
                    i += 1
                elif kind == LAST:
                    if shapes[i] != END:
                        break
                elif kind == RUN:
                    if shapes[i] in s[1]:
                        todo.append((alternative, k, i + 1, node))
                else:
                    below = s[1]
                    options = predict[below].get(shapes[i])
                    after = k if kind == LOOP else k + 1
                    if options:
                        if remember and below in items and (below, i) not in nodes:
                            lengths, seen = self._item(below, line, i, depth + 1)
                            if i + seen > looked:
                                looked = i + seen
                            for e in lengths:
                                todo.append((alternative, after, i + e, node))
                        else:
                            child = nodes.get((below, i))
                            if child is None:
                                child = nodes[below, i] = (set(), [], set())
                                for a in options:
                                    todo.append((a, 0, i, child))
                            else:
                                for e in child[0]:
                                    todo.append((alternative, after, e, node))
                            child[1].append((alternative, after, node))
                    if kind == SYMBOL:
                        break
                k += 1
            else:
                if i not in node[0]:
                    node[0].add(i)
                    if i == goal and node is root:
                        return node[0], looked
                    for a, place, parent in node[1]:
                        # A token that must come next is tried before the alternative is taken up.
                        if place < a[2] and (s := a[1][place])[0] == TOKENS and shapes[i] not in s[1]:
                            if i > looked:
                                looked = i
                            continue
                        todo.append((a, place, i, parent))
        return root[0], looked
