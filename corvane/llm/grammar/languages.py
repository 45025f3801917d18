"""Lexers of the supported languages, and whole-file recognition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from . import rules
from .gll import BASE, BRACE, BRACKET, INDENT, PAREN, Grammar, Recogniser, Terms

OPENING, CLOSING = {"(": PAREN, "[": BRACKET, "{": BRACE}, {")": PAREN, "]": BRACKET, "}": BRACE}
C_COMMENT = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
DQ, SQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
ID = r"[^\W\d][\w]*"
NUMBER = r"(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*)?\.\d[\d_']*(?:[eE][-+]?\d[\d_]*)?|\d[\d_']*\.(?![\w.])|\d[\d_']*\.(?=[eE]\d)(?:[eE][-+]?\d+)|\d[\d_']*(?:[eE][-+]?\d[\d_]*)?)"


#: Marks of lexemes that aren't plain tokens: OPENS - bracket, CLOSES - bracket, the end of a line
#: where that counts, and the end of a text. Those of other lexemes are their kinds.
LINE_END, OVER, OPENS, CLOSES = -2, -4, -10, -20


class Invalid(Exception):
    """The text can't be read as tokens in balanced brackets."""


class Language:
    """Terms, grammar and token pattern of one language.

    items names the symbols that lists are made of, whose ends are worth remembering. top is what a
    file is: one symbol, whose alternatives are the dialects. mode: how line ends count ("", "go",
    "js" or "py").
    """

    def __init__(self, name, text, tokens, blank, keywords, items, top="Unit", mode="", suffix="", operators=()):
        self.name, self.mode, self.markup = name, mode, name in ("jsx", "tsx")
        self.terms = Terms()
        for word in keywords:
            self.terms(word)
        self.id, self.num, self.str, self.tmpl = (self.terms(x) for x in ("id", "num", "str", "tmpl"))
        self.regex, self.life = self.terms("regex"), self.terms("life")
        self.semi, self.nl, self.err = self.terms(";"), self.terms("nl"), self.terms("err")
        self.private = self.terms("#private")
        for word in ("<markup", "markup>"):
            self.terms(word)
        self.grammar = Grammar(text, self.terms, items)
        names = self.grammar.names
        self.top = names[top]
        for name in names:
            if f"{name}0" in names and "return" in keywords:
                self.grammar.stricter[names[f"{name}0"]] = names[name], self.terms("return")
        # What may stand in a namespace is what may stand outside of functions, imports and exports, and
        # what in an ambient one that and declarations without values.
        if "Ambient" in names:
            for name, other, begins in (("Tops", "Stmts0", ("import", "export")), ("Ambient", "Tops", ("var", "let", "const"))):
                self.grammar.wider[names[name]] = names[other], frozenset(map(self.terms, begins))
            # None of them has a return statement, and as a word `return` only follows these.
            self.grammar.barred = frozenset(names[x] for x in ("Stmts0", "Tops", "Ambient")), self.terms("return"), frozenset(map(self.terms, (".", "?.", "as")))
        self.recogniser = Recogniser(self.grammar)
        self.keywords = frozenset(keywords)
        signs = {x for x in self.terms.number if not re.match(r"\w", x)} | {";"} | set(operators)
        operator = "|".join(re.escape(x) for x in sorted(signs, key=len, reverse=True))
        number = NUMBER + f"(?:{suffix})?(?!\\w)" if suffix else NUMBER + r"(?!\w)"
        lexeme = rf"{tokens}|{number}|{ID}|{operator}|[()\[\]{{}}]|\n|/\*|[^\s]"
        self.pattern = re.compile(rf"(?:{blank})*({lexeme})", re.M)
        #: The same with what stands before each lexeme, from which places are counted, and the end of
        #: the text. Common lexemes come first, where none of the others can begin with them.
        word = r"[A-Za-z_][\w$]*+" if mode == "js" else r"[A-Za-z_]\w*+(?![\"'#])"
        longer = {c: "".join(sorted({re.escape(x[1]) for x in signs if len(x) > 1 and x[0] == c})) for c in "=:<>+-*&|!?@~^%" if c in signs}
        common = "|".join([word, r"[()\[\]{},;]", r"\.(?=[A-Za-z_])", *(re.escape(c) + (f"(?![{after}])" if after else "") for c, after in longer.items()), r"\d++(?![\w.'])"])
        self.spaced = re.compile(rf"([ \t]*+(?:(?:{blank}|[^\S\n])++)?+)({common}|{lexeme}|\Z)", re.M)
        t = self.terms.number
        self.enders = {self.id, self.num, self.str, self.tmpl, self.regex, self.life, self.private} | {t[x] for x in ENDERS if x in t}
        if mode == "js":
            self.enders |= {t[x] for x in t if x in WORDS_AS_NAMES}
        self.otherwise = t.get("else", -9)
        self.heads = {t[x] for x in ("if", "for", "while", "with") if x in t}
        self.going_on = {t[x] for x in GOING_ON if x in t}
        self.kinds: dict[str, int] = {}
        self.marks: dict[str, int] = {}

    # -- tokens ------------------------------------------------------------------------------

    def kind(self, lexeme: str) -> int:
        """The number of a lexeme; -1 for what is no token."""
        got = self.terms.number.get(lexeme)
        c = lexeme[0]
        if got is not None and lexeme not in ("id", "num", "str", "tmpl", "regex", "life", "#private", "nl", "err", "pp") or lexeme in self.keywords:
            return self.terms.number[lexeme]
        if len(lexeme) > 1 and lexeme[-1] in "\"'`#" and (c in "\"'`" or re.match(r"[A-Za-z]{1,3}\d?#*[\"']", lexeme)):
            return self.tmpl if c == "`" and self.mode == "js" else self.str
        if c.isdigit() or c == "." and len(lexeme) > 1 and lexeme[1].isdigit():
            return self.num
        if c == "'" and self.name == "rs" and len(lexeme) > 1:
            return self.life
        if c == "#" and len(lexeme) > 1 and self.mode == "js":
            return self.private
        if c.isalpha() or c == "_" or c == "$" or lexeme.startswith("r#"):
            return self.id
        return -1

    def lexemes(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def tokens(self, text: str) -> tuple:
        """The top-level sequence, with bracketed groups interned in the recogniser."""
        if "\0" in text:
            raise Invalid("null byte")
        text = text.replace("\r\n", "\n")
        if text.startswith("﻿"):
            text = text[1:]
        if (self.mode in ("js", "py") or self.name == "rs") and text.startswith("#!") and not text.startswith("#!["):
            text = text[text.find("\n") :] if "\n" in text else ""
        if self.mode == "py":
            return self._python(text)
        lexemes = (x for x, _, _ in self._careful(text)) if self.careful(text) else self.lexemes(text)
        kinds, kind, group = self.kinds, self.kind, self.recogniser.group
        go, semi, enders = self.mode == "go", self.semi, self.enders
        stack: list[tuple[int, list[int]]] = []
        current: list[int] = []
        waiting = False
        for x in lexemes:
            k = kinds.get(x)
            if k is None:
                k = self._new_kind(x)
            if k == -2:  # a line end
                if go:
                    if current and (current[-1] in enders or current[-1] >= BASE):
                        current.append(semi)
                else:
                    waiting = True
                continue
            if k < 0:
                if k == -1:
                    raise Invalid(f"unexpected {x[:20]!r}")
                continue
            if waiting:
                waiting = False
                if self.ends_before(current, k, x):
                    current.append(semi)
            if x in OPENING:
                stack.append((OPENING[x], current))
                current = []
            elif x in CLOSING:
                if not stack or stack[-1][0] != CLOSING[x]:
                    raise Invalid(f"unmatched {x}")
                bracket, outer = stack.pop()
                outer.append(group(bracket, tuple(current)))
                current = outer
            else:
                current.append(k)
        if stack:
            raise Invalid("unclosed bracket")
        if go and current and (current[-1] in enders or current[-1] >= BASE):
            current.append(semi)
        return tuple(current)

    def ends_before(self, current: list[int], k: int, x: str) -> bool:
        """Whether a line end before token k (lexeme x) of a script closes a statement."""
        if not current:
            return False
        last, kinds = current[-1], self.recogniser.kinds
        headed = len(current) > 1 and last >= BASE and current[-2] in self.heads
        before_else = k == self.otherwise and (last < BASE or kinds[last - BASE] != BRACE)
        return not headed and (last in self.enders or last >= BASE) and (k not in self.going_on or before_else) and x not in ")]}" and (x not in "([{" or x == "{" and last < BASE)

    def _lexeme_kind(self, x: str) -> int:
        if x == "\n":
            return -2 if self.mode in ("go", "js") else -3
        if x[0] == "#" and self.name in ("cpp", "c", "h"):
            return -3 if DIRECTIVE.fullmatch(x) else -1
        if x in OPENING or x in CLOSING:
            return OPENING.get(x, CLOSING.get(x, 0))
        return self.kind(x)

    def _new_kind(self, x: str) -> int:
        k = self._lexeme_kind(x)
        if len(self.kinds) > 150_000:
            self.kinds.clear()
        self.kinds[x] = k
        return k

    def mark(self, x: str) -> int:
        """The mark of a lexeme."""
        if x[0] == "\n" and len(x) > 80:
            return LINE_END
        if x.isidentifier() and x not in self.terms.number:
            k = self.id
        else:
            k = OPENS - OPENING[x] if x in OPENING else CLOSES - CLOSING[x] if x in CLOSING else LINE_END if x[0] == "\n" and self.mode else self._lexeme_kind(x)
        if len(self.marks) > 150_000:
            self.marks.clear()
        self.marks[x] = k
        return k

    def placed(self, text: str, at: int = 0) -> tuple[list[str], list[int], list[int]]:
        """The lexemes from a place on, where they start and where they end."""
        parts = self.spaced.split(text[at:] if at else text)
        # Nothing, blanks and a lexeme by turns.
        places = list(accumulate(map(len, parts), initial=at))
        found, starts, stops = parts[2::3], places[2::3], places[3::3]
        while found and not found[-1]:
            found.pop()
        return found, starts[: len(found)], stops[: len(found)]

    def careful(self, text: str) -> bool:
        """Whether lexemes depend on what stands before them."""
        return self.mode == "js" and (self.markup or REGEXISH.search(text) is not None)

    def scan(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(lexeme, start, end) of every lexeme."""
        if self.careful(text):
            yield from self._careful(text)
        else:
            for m in self.pattern.finditer(text):
                yield m.group(1), m.start(1), m.end(1)

    def _careful(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Lexemes of scripts where a slash can begin a pattern, templates can nest and, where the
        language has it, a `<` can begin markup."""
        self.kinds["/regex/"] = self.marks["/regex/"] = self.regex
        match, last, at = self.pattern.match, "", 0
        #: What encloses the place: "" for plain brackets, else the names of open tags.
        holders: list[list[str] | None] = []
        depth: list[int] = []
        while m := match(text, at):
            x, start = m.group(1), m.start(1)
            begins = not last or last in BEFORE_PATTERN or (last[-1] in "=(,:;!&|?{}[+-*%<>~^" and last not in ("++", "--") and last[0] not in "\"'`")
            if x[0] == "/" and x != "/*" and begins and (r := PATTERN.match(text, start)):
                yield "/regex/", start, r.end()
                last, at = ")", r.end()
                continue
            if x[0] == "`":
                at = self._template(text, start)
                yield "``", start, at
                last = ")"
                continue
            if self.markup and x == "<" and (begins or last == "=>") and (t := TAG.match(text, start)) and not (self.name == "tsx" and GENERIC.match(text, start)):
                holders.append([])
                depth.append(0)
                at = yield from self._markup(text, start, holders[-1])
                last = ")" if not holders[-1] else "{"
                if not holders[-1]:
                    holders.pop()
                    depth.pop()
                continue
            yield x, start, m.end()
            at = m.end()
            if x != "\n":
                last = x
            if holders and x in "{}":
                depth[-1] += 1 if x == "{" else -1
                if depth[-1] == -1:  # back in the markup
                    depth[-1] = 0
                    at = yield from self._markup(text, at, holders[-1])
                    last = ")" if not holders[-1] else "{"
                    if not holders[-1]:
                        holders.pop()
                        depth.pop()

    def _markup(self, text: str, at: int, tags: list[str]) -> Iterator[tuple[str, int, int]]:
        """Reads markup up to the brace of an expression, which is handed on as a lexeme, or to its
        end. tags: the open elements, a last "<" where a tag itself is open. Returns the place."""
        while True:
            if tags and tags[-1] == "<":
                m = INSIDE_TAG.match(text, at)
                at = m.end()
                if text.startswith("{", at):
                    yield "{", at, at + 1
                    return at + 1
                tags.pop()
                if text.startswith("/>", at):
                    tags.pop()
                    yield "markup>", at, at + 2
                    at += 2
                elif text.startswith(">", at):
                    at += 1
                else:
                    raise Invalid("unfinished tag")
            else:
                if tags:
                    m = CONTENT.match(text, at)
                    at = m.end()
                    if text.startswith("{", at):
                        yield "{", at, at + 1
                        return at + 1
                if c := CLOSING_TAG.match(text, at):
                    if not tags or tags[-1] != c.group(1):
                        raise Invalid("unmatched tag")
                    tags.pop()
                    yield "markup>", at, c.end()
                    at = c.end()
                elif t := TAG.match(text, at):
                    yield "<markup", at, t.end()
                    tags += [t.group(1), "<"]
                    at = t.end()
                else:
                    raise Invalid("unclosed tag")
            if not tags:
                return at

    def _template(self, text: str, start: int) -> int:
        """The end of a template literal; literals inside of its expressions may hold templates too."""
        open_: list[int] = [-1]  # -1 for a template, else the depth of braces in an expression
        at = start + 1
        while at < len(text):
            c = text[at]
            if open_[-1] < 0:
                if c == "\\":
                    at += 1
                elif c == "`":
                    open_.pop()
                    if not open_:
                        return at + 1
                elif c == "$" and text.startswith("{", at + 1):
                    open_.append(1)
                    at += 1
            elif c == "`":
                open_.append(-1)
            elif c in "\"'":
                m = (DOUBLE if c == '"' else SINGLE).match(text, at)
                at = m.end() - 1 if m else at
            elif c in "{}":
                open_[-1] += 1 if c == "{" else -1
                if not open_[-1]:
                    open_.pop()
            at += 1
        raise Invalid("unclosed template")

    def _python(self, text: str) -> tuple:
        kinds, group, nl = self.kinds, self.recogniser.group, self.nl
        stack: list[tuple[int, list[int]]] = []
        current: list[int] = []
        indents = [0]
        text = text.replace("\r", "\n")
        lead = PY_LINES.match(text)
        if lead and columns(lead.group(0)):
            if lead.end() < len(text):
                raise Invalid("unexpected indent")
        blocks = 0
        for x in self.lexemes(text[lead.end() :] if lead else text):
            if x[0] == "\n":
                if stack and stack[-1][0] != INDENT:
                    continue
                if current and not (current[-1] == nl or blocks and current[-1] >= BASE and self.recogniser.kinds[current[-1] - BASE] == INDENT):
                    current.append(nl)
                width = columns(x)
                if width > indents[-1]:
                    indents.append(width)
                    stack.append((INDENT, current))
                    current, blocks = [], blocks + 1
                else:
                    while width < indents[-1]:
                        indents.pop()
                        if not stack or stack[-1][0] != INDENT:
                            raise Invalid("unmatched indent")
                        _, outer = stack.pop()
                        outer.append(group(INDENT, tuple(current)))
                        current = outer
                    if width != indents[-1]:
                        raise Invalid("unindent")
                continue
            k = kinds.get(x)
            if k is None:
                k = self._new_kind(x)
            if k == -1:
                raise Invalid(f"unexpected {x[:20]!r}")
            if k < -1:
                continue
            if x in OPENING:
                stack.append((OPENING[x], current))
                current = []
            elif x in CLOSING:
                if not stack or stack[-1][0] != CLOSING[x]:
                    raise Invalid(f"unmatched {x}")
                bracket, outer = stack.pop()
                outer.append(group(bracket, tuple(current)))
                current = outer
            else:
                current.append(k)
        while stack:
            bracket, outer = stack.pop()
            if bracket != INDENT:
                raise Invalid("unclosed bracket")
            if not current:  # only white space
                current = outer
                continue
            if current and current[-1] != nl and not (current[-1] >= BASE and self.recogniser.kinds[current[-1] - BASE] == INDENT):
                current.append(nl)
            outer.append(group(INDENT, tuple(current)))
            current = outer
        if current and current[-1] != nl and not (current[-1] >= BASE and self.recogniser.kinds[current[-1] - BASE] == INDENT):
            current.append(nl)
        return tuple(current)

    # -- recognition -------------------------------------------------------------------------

    def rest(self) -> None:
        """Between two files: drops what is remembered once it is much."""
        if self.recogniser.size() > self.recogniser.KEPT:
            self.recogniser.forget()

    def accepts(self, text: str) -> bool:
        """Whether some dialect accepts the whole text; all of them share one stack."""
        self.rest()
        try:
            return self.recogniser.matches(self.top, self.tokens(text))
        except Invalid:
            return False


def columns(run: str) -> int:
    """Width of the indentation behind the last line end of a run of blank and comment lines."""
    last = run[run.rfind("\n") + 1 :]
    width = 0
    for c in last:
        if c == " ":
            width += 1
        elif c == "\t":
            width += 8 - width % 8
        elif c == "\f":
            width = 0
        else:
            break
    return width


PY_LINES = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*(?:#[^\n]*)?(?=\S|\Z|\n)")
DIRECTIVE = re.compile(r"#\s*(?:include(?:_next)?\s*(?:<[^>\n]+>|\"[^\"\n]+\"|\w+)\s*(?://.*|/\*.*)?|import\s+\S+.*|define\s+\w[\s\S]*|(?:undef|ifdef|ifndef|elifdef|elifndef)\s+\w+.*|(?:if|elif)\b\s*[\s\S]+|(?:else|endif)\b.*|pragma\b[\s\S]*|(?:error|warning|line)\b[\s\S]*)?\s*")
DOUBLE, SINGLE = re.compile(DQ), re.compile(SQ)
# Markup: the start of a tag, what it holds up to its end or a brace, its content, and its end.
TAG = re.compile(r"<\s*((?:[A-Za-z_$][\w$.:-]*)?)(?=[\s/>{]|$)")
CLOSING_TAG = re.compile(r"<\s*/\s*((?:[A-Za-z_$][\w$.:-]*)?)\s*>")
INSIDE_TAG = re.compile(r"(?:\s+|[A-Za-z_$][\w$:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=\{)))?)*")
CONTENT = re.compile(r"[^<>{}]*")
GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
PATTERN = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
REGEXISH = re.compile(r"[=(,:;!&|?{}\[+\n]\s*/(?![/*])|\breturn\s*/(?![/*])|`[^`]*\$\{|=>\s*/(?![/*])")
BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())
# Tokens after which a line end closes a statement, and such that continue one.
ENDERS = ("++", "--", "break", "continue", "fallthrough", "return", "this", "super", "true", "false", "null", ")", "]", "}", "!")
WORDS_AS_NAMES = frozenset("as from of get set async let static type target meta accessor declare abstract readonly namespace module is asserts infer keyof unique satisfies assert any unknown never override global out string number boolean symbol object bigint undefined void debugger yield private".split())
GOING_ON = (".", "?.", ",", ";", "=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??=", "||", "&&", "??", "|", "^", "&", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "<<", "+", "-", "*", "/", "%", "**", "in", "instanceof", "?", ":", "=>", "else", "catch", "finally", "tmpl", "as", "satisfies", "implements", "extends", "from")


def words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _python() -> Language:
    string = r"(?:[rRbBuUfFtT]{0,2})(?:\"\"\"[^\"\\]*+(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*+)*+\"\"\"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''|(?!\"\"\"|''')(?:" + DQ + "|" + SQ + "))"
    return Language(
        "py", rules.PYTHON, rf"{string}|(?:\n[ \t\f]*(?:#[^\n]*)?)+|\.\.\.", r"[ \t\f]+|\\\n|#[^\n]*", words("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False match case type"),
        ("Stmt", "Small"), mode="py", suffix="[jJ]", operators=("!",),
    )


def _go() -> Language:
    return Language(
        "go", rules.GO, rf"{DQ}|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]*)'", rf"[ \t\r\f]+|{C_COMMENT}", words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
        ("Top", "Stmt", "Case"), mode="go", suffix="i",
    )


def _java() -> Language:
    return Language(
        "java", rules.JAVA, r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' + rf"|(?!\"\"\"){DQ}|'(?:[^'\\\n]|\\[^\n][^'\n]*)'", rf"\s+|{C_COMMENT}",
        words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits yield var open module non when"),
        ("Import", "TypeDecl", "Member", "Stmt"), suffix="[lLfFdD]",
    )


def _rust() -> Language:
    string = r'b?r"[^"]*"|b?r#"(?:[^"]|"(?!#))*"#|b?r##"(?:[^"]|"(?!##))*"##|[bc]?"(?:[^"\\]|\\[\s\S])*"' + r"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[^\nxu]))'|'[A-Za-z_]\w*|r#[A-Za-z_]\w*"
    comment = r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/"
    return Language(
        "rs", rules.RUST, string, rf"\s+|{comment}", words("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub raw ref return self Self static struct super trait true type unsafe use where while yield union auto default _"),
        ("Item", "Stmt", "Assoc", "Arm"), suffix="(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))",
    )


def _cpp(name: str = "cpp", text: str = rules.CPP, top: str = "Unit", items: tuple[str, ...] = ("Decl", "Member", "Stmt")) -> Language:
    string = r'(?:u8|[uUL])?R"\((?:[^)]|\)(?!"))*\)"|(?:u8|[uUL])?R"(?:[^()\\\s"]{1,16})\([\s\S]*?\)[^()\\\s"]{1,16}"|(?:u8|[uUL])?' + DQ + r"|(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n][^'\n]*)'|^[ \t]*\#[^\n\\]*(?:\\[\s\S][^\n\\]*)*"
    return Language(
        name, text, string.replace(r"^[ \t]*\#", r"\#"), rf"\s+|\\\n|{C_COMMENT}",
        words("alignas alignof and asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class compl concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit extern false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or private protected public register reinterpret_cast requires restrict return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor __attribute__"),
        items, top, suffix="(?:[uUlLzZ]{1,3}|[fFlL]|_\\w+|(?:h|min|s|ms|us|ns|sv|i|il|if))",
    )


JS_WORDS = words("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield await enum null true false let static async of get set as from target meta accessor using implements interface package protected public assert require")
TS_WORDS = words("type declare abstract readonly namespace module is asserts infer keyof unique satisfies any unknown never override global out string number boolean symbol object bigint undefined")


def _script(name: str, text: str, more: tuple[str, ...]) -> Language:
    return Language(
        name, text, rf"{DQ}|{SQ}|`(?:[^`\\]|\\[\s\S])*`|\#?[^\W\d][\w$]*|\#?\$[\w$]*", rf"[ \t\r\f\v   ]+|{C_COMMENT}", JS_WORDS + more,
        ("Top", "Stmt", "Stmt0", "Member", "Case", "Element"), mode="js", suffix="n", operators=(">>>=", ">>="),
    )


MAKERS = {
    "py": _python, "go": _go, "java": _java, "rs": _rust, "cpp": _cpp,
    "c": lambda: _cpp("c", rules.C, "CUnit", ("CDecl", "CItem", "CField")),
    # A header may be of either language: both grammars run on one stack.
    "h": lambda: _cpp("h", rules.CPP + rules.C + "Header = Unit | CUnit\n", "Header", ("Decl", "Member", "Stmt", "CDecl", "CItem", "CField")),
    "js": lambda: _script("js", rules.JS, ()), "jsx": lambda: _script("jsx", rules.JSX, ()),
    "ts": lambda: _script("ts", rules.TS, TS_WORDS + ("private",)), "tsx": lambda: _script("tsx", rules.TSX, TS_WORDS + ("private",)),
}
ALIASES = {"pyi": "py", "mjs": "js", "cjs": "js", "mts": "ts", "cts": "ts", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp"}


@lru_cache(maxsize=None)
def language(extension: str) -> Language | None:
    """The language of a file extension, or None."""
    maker = MAKERS.get(ALIASES.get(extension, extension))
    return maker() if maker else None
