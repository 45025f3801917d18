"""Grammars: valid and broken texts of every language."""

import ast
import random
import warnings

import pytest

from corvane.llm.grammar.gll import Grammar, Recogniser, Terms
from corvane.llm.grammar.languages import language

GOOD = {
    "py": [
        "", "# only a comment\n", "x = 1", "def f(a, *, b: int = 2, **k) -> dict[str, int]:\n    '''doc'''\n    return {**k, 'a': [x async for x in a if x]}\n", "class A(B, metaclass=M):\n\n    @property\n    def x(self): return self._x\n",
        "match p:\n    case [1, *rest] if rest:\n        pass\n    case {'k': v, **o} | None:\n        pass\n    case P(x=0):\n        pass\n", "try:\n    pass\nexcept* E as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n",
        "with (open(a) as b, c):\n\tif x:\n\t\tpass\n", "s = '''\n<<<<<<< HEAD\n'''\nt = 'a' \\\n  'b'\n", "lambda *a, k=1: (yield)\nprint(f'{x!r:>{w}}', end='')\nx: int = 3; y = z = 4\nasync def g():\n    await h(); return\n", "a[1:2, ::3, ...] = b if c else d\nif (n := len(a)) > 1: pass\n", "if a:\n  b\n\n  # odd\n c\n".replace(" c\n", ""), "x = [\n  1,\n# c\n 2]\n",
    ],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable] struct {\n\tA, b int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K]) F(a ...string) (n int, err error) {\n\tfor i, v := range a {\n\t\tif x, ok := m[v]; ok && !t.z {\n\t\t\tgo func() { ch <- x }()\n\t\t} else if v == \"q\" {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch y := v.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t\tdefer f(y)\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\treturn map[string][]int{\"a\": {1, 2}, \"b\": nil}[k], nil\n}\n", "package p\nvar a = `x\ny`\nconst (\n\tA = iota\n\tB\n)\n"],
    "java": ["package a.b;\n\nimport static x.Y.*;\n\n@Ann(value = {1, 2}, k = \"v\")\npublic final class A<T extends B & C> extends D<T[]> implements E {\n    private static final Map<String, List<int[]>> M = new HashMap<>() {{ put(\"a\", null); }};\n    static { run(); }\n    A(int... x) throws IOException { this(x, 1); }\n    public <R> R f(final @N T t, Function<? super T, ? extends R> g) {\n        for (int i = 0, j = 1; i < 3; i++, j--) { if (t instanceof String s && s.length() >> 2 > 1) continue; }\n        var y = switch (k) { case A, B -> 1; case C -> { yield 2; } default -> throw new X(); };\n        try (var r = open(); s) { return g.apply((T) t); } catch (A | B e) { } finally { x[0] += y > 1 ? 2 : a -> b; }\n        label: while (true) break label;\n        return A::new;\n    }\n    enum Z { P(1) { void q() {} }, Q; int n; }\n    record R(int a, String... b) { }\n    @interface I { int v() default 3; }\n}\n"],
    "rs": ["#![allow(x)]\nuse a::{b, c::*, self as d};\n\n/// doc\n#[derive(Debug)]\npub struct S<'a, T: X + 'a = u8> where T: Y { pub(crate) f: &'a mut [T; 3], }\nimpl<'a, T> Tr<T> for S<'a, T> {\n    const N: usize = 1;\n    async fn f(&mut self, (a, _): (u8, i64)) -> Result<Vec<Option<T>>, Box<dyn E + Send>> {\n        let Some(x) = y.z::<u8>()? else { return Err(e.into()) };\n        match x { 1 | 2 => {} 'a'..='z' if q => f(), S { f, .. } => (), ref r @ 3.. => break 'l 1, _ => panic!(\"{}\", x) }\n        for i in (0..n).rev() { v.push(|a: u8| -> u8 { a + 1 }); }\n        'l: loop { if let Some(_) = a && b { continue 'l } else { break } }\n        if a < b as usize { x } else { *y += &z[1..]; 0 };\n        vec![1, 2; 3];\n        Ok(S { f: 1, ..d })\n    }\n}\nmacro_rules! m { ($a:expr) => { $a }; }\n"],
    "cpp": ["#include <a>\n#include \"b.h\"\n#define X(a) \\\n  a\nnamespace n::m {\ntemplate <typename T, int N = 3> class A final : public B<T>, private virtual C {\n public:\n  explicit A(int x) : B<T>{x}, y_(x) {}\n  virtual ~A() = default;\n  A& operator=(const A&) = delete;\n  bool operator<(const A& o) const noexcept override { return y_ < o.y_; }\n  static constexpr int k = N << 2;\n private:\n  std::map<std::string, std::vector<int>> m_;\n  int y_ : 3;\n};\nenum class E : int { a = 1, b };\n}\nint main(int argc, char** argv) {\n  for (const auto& [k, v] : m) std::cout << k << \"x\" \"y\" << std::endl;\n  auto f = [&, x = 1](auto a) mutable -> int { return a + x; };\n  switch (a) { case 1: case 2: break; default: ; }\n  try { throw E(1); } catch (const std::exception& e) { } catch (...) { }\n  int* p = new int[3]{1, 2}; delete[] p; unsigned long long z = sizeof(int) * (long)q;\n  do { i++; } while (i < static_cast<int>(3));\n  return a ? b : c->d.e[1](2);\n}\n"],
    "js": ["#!/usr/bin/env node\nimport a, { b as c } from 'd';\nimport * as q from \"r\"\nexport default class A extends (B) {\n  static #p = 1\n  get x() { return this.#p }\n  async *gen(a = 1, { b, ...c } = {}, [d, , e]) { yield* a; for await (const x of y) {} }\n}\nexport const f = async (x) => ({ ...x, [k]: 1, m() {}, 'a-b': 2 })\nlet r = a / b / c, s = /[/\\]]+/g.test(x) ? `t${`u${v}`}` : a?.b?.[c] ?? d\nlabel: for (let i = 0, n = 1; i < n; i++) { if (a) continue label; else b() }\nswitch (x) { case 1: { } default: y }\ntry { a() } catch { } finally { }\n!function(e){\"use strict\";e.a={b:5,c:!0}}(this);var z=[1,2].map(function(r){return r+1})\nexport { f as default, a }\n", "do x++; while (x < 5)\nif (a)\n  b\nelse\n  c\nreturn_ = function () { return\n}\n".replace("return_", "q")],
    "ts": ["import type { A } from './a';\nexport interface I<T = {}> extends J<T>, K { readonly a?: string; [k: string]: unknown; m<U>(x: U): void; new (x: number): I }\nexport type M<T> = { readonly [K in keyof T]?: T[K] } | ((a: number, ...b: string[]) => void) | 'x' | [a: string, b?: number];\nenum E { A = 1, B = 'x' }\nabstract class C<T> extends D<T> implements I<T> {\n  private readonly x: Map<string, number[]> = new Map<string, number[]>();\n  constructor(public a: string, protected b?: number) { super(); }\n  abstract f(): void;\n  @dec() g<T extends object>(this: C<T>, x: T): x is T { return (x as any)!.y satisfies Z; }\n}\nfunction h(x: string): void;\nfunction h(x: any) { const y = <T,>(a: T) => a; let z: typeof x[number] | undefined = x!; }\ndeclare module 'm' { export const a: number }\nnamespace N.O { export let b = 1 }\n"],
}
BAD = {
    "py": ["def f(:\n    pass\n", "x = 'a\n", "if a:\nb\n", "print 'x'\n", "exec 'x'\n", "raise V, 'x'\n", "a = (1\n", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "  x = 1\n", "if a:\n    b\n   c\n", "package a;\n", "def f():\n    ", "x = 1\0\n", "a b\n", "x = 08\n".replace("08", "0b")],
    "go": ["func main() {\n}\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nvar x = \"a\n", "package a\nfunc f() {\n", "package a\nfunc f() {\n\ta b\n}\n", "package a\n<<<<<<< HEAD\nvar a = 1\n=======\n"],
    "java": ["class A { void f( { } }", "class A { int x = 1 }", "class A { void f() { a( } }", "class A { String s = \"x; }", "def f(): pass", "class A {", "class A { >>>>>>> theirs\n }"],
    "rs": ["fn f( { }", "fn f() { let x = ; }", "fn f() {", "fn f() { a b }", "class A {}", "fn f() { \"x }", "||||||| 6d6c6ba\nfn f() {}"],
    "cpp": ["int f( { }", "int f() { return 1 }", "int f() {", "#include \"a\nint x;", "int f() { a b c; }", "<html>", "int x = \"a;\n"],
    "js": ["function f( { }", "let x = ;", "a b", "const s = 'a\n", "class A { x( { } }", "function f(a: string) {}", "{", "# Notes\n", "if (a) {\n<<<<<<< ours\n}"],
    "ts": ["function f(a: ) {}", "interface I { a: }", "let x: = 1", "const a = [1, 2", "package a\n", "fn f() -> i64 { }", "type = 3 4"],
}


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_accepts(ext):
    for text in GOOD[ext]:
        assert language(ext).accepts(text), text
        assert language(ext).accepts(text.replace("\n", "\r\n")), text


@pytest.mark.parametrize("ext", sorted(BAD))
def test_rejects(ext):
    for text in BAD[ext]:
        assert not language(ext).accepts(text), text


def test_python_agrees_with_its_own_parser():
    """Valid programs with one token deleted, doubled or swapped."""
    warnings.simplefilter("ignore")
    rng = random.Random(3)
    spoken, differ = language("py"), []
    sources = [g for g in GOOD["py"] if len(g) > 20]
    for _ in range(400):
        text = rng.choice(sources)
        parts = spoken.pattern.findall(text)
        places = [m.span(1) for m in spoken.pattern.finditer(text)]
        k = rng.randrange(len(parts))
        a, b = places[k]
        text = text[:a] + rng.choice(["", parts[k] + " " + parts[k], parts[rng.randrange(len(parts))]]) + text[b:]
        try:
            compile(text, "x", "exec", ast.PyCF_ONLY_AST)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        if spoken.accepts(text) != valid:
            differ.append(text)
    assert not [t for t in differ if not spoken.accepts(t)], differ
    # What is left over: names of keyword arguments that come twice and the like.
    assert len(differ) <= 4, differ


def test_ambiguous_and_left_recursive_rules():
    terms = Terms()
    g = Grammar("S = S S | 'a' | \nE = E '+' E | 'a'\nN = (| N |) N | \n", terms)
    r, a, plus = Recogniser(g), terms("a"), terms("+")
    assert r.matches(g.names["S"], (a,) * 9) and r.matches(g.names["S"], ())
    assert r.matches(g.names["E"], (a, plus, a, plus, a)) and not r.matches(g.names["E"], (a, plus))
    inner = r.group(0, ())
    assert r.matches(g.names["N"], (r.group(0, (inner, inner)), inner)) and not r.matches(g.names["N"], (a,))


def test_deep_nesting():
    assert language("py").accepts("x = " + "(" * 50 + "1" + ")" * 50 + "\n")
    assert language("js").accepts("x = " + "[" * 3000 + "]" * 3000) and not language("js").accepts("x = " + "[" * 3000 + "]" * 2999)
    assert language("js").accepts("if (a) b(); " + "else if (a) b(); " * 2000 + "else c();")


def test_long_lists_are_parsed_whole():
    for n in (9, 50, 5000):
        assert language("js").accepts("x = [" + "1, " * n + "2]") and not language("js").accepts("x = [" + "1, " * n + "2 3, " + "1, " * n + "]")
        assert language("py").accepts("f(" + "a, " * n + "b=1)\n") and not language("py").accepts("f(" + "a, " * n + "b=1, c)\n")
        body = "x = 1;\n" * n
        assert language("java").accepts("class A { void f() {" + body + "} }") and not language("java").accepts("class A { void f() {" + body + "x + 1;" + body + "} }")


def test_ends_do_not_depend_on_what_was_seen_before():
    texts = [f"f({'a, ' * i}b{'.c' * j});" + "g();" * k for i in range(3) for j in range(3) for k in range(6)] + ["if (a) b(); else c(); d(); e(); f(); g();", "if (a) b(); c(); d(); e(); f(); g(); h();", "if (a) { b(); } c(); else d(); e(); f(); g();"]
    spoken = language("js")
    alone = []
    for t in texts:
        spoken.recogniser.forget()
        alone.append(spoken.accepts(t))
    rng = random.Random(1)
    spoken.recogniser.forget()
    for k in rng.sample(range(len(texts)), len(texts)):
        assert spoken.accepts(texts[k]) == alone[k], texts[k]
    assert not alone[-1] and all(alone[:-1])


INVALID = {
    "java": ["class A {}\nimport x.Y;", "import a.B;\npackage p;\nclass A {}", "class A { void f() { x + 1; } }", "class A { void f() { 1 = x; } }"], "go": ['package p\nfunc f() {}\nimport "x"\n'],
    "py": ["1 = x\n", "f() = 3\n", "f(a=1, 2)\n", "def f(a=1, b): pass\n", "def f(*): pass\n", "f(**k, *a)\n", "x + 1 = 2\n", "for f() in x: pass\n", "del f()\n", "lambda a=1, b: 0\n", "a += b += c\n", "(a, b) += 1\n", "f(x for x in y, 1)\n"],
    "js": ["1 = x;", "const a;", "return 1;", "f() = 3;", "if (x) { return; }", "a + b = c;", "let {a};"], "ts": ["1 = x;", "return 1;", "const a: number;"], "c": ["int f( { }", "x = = 3;", "int new = ;"], "tsx": ["const a = <div><b></div>;", "const a = <div>{x +}</div>;"], "jsx": ["const a = <div"],
}
VALID = {
    "java": ["package p;\nimport a.B;\nimport static c.D.*;\nclass A {}", "module m { requires x; }", "class A { void f() { x++; new B(); a.b(c).d(); x[1] += 2; this.y = 3; for (i = 0, j = 1; i < 3; i++, f()) {} a.new B(); } }"],
    "py": ["x = y = 1\na, *b = c\n(a, b) = 1, 2\n[a, [b]] = c\na.b[0] += 2\nx: int = 3\nx.y: int\ndef f(a, /, b, c=1, *d, e, f=2, **g): pass\nf(a, *b, c=1, *d, **e, f=2)\nf(x for x in y)\nlambda a, b=1, *c, d, **e: 0\nfor a.b, (c, d) in e: pass\ndel a, b[0], (c.d)\n() = x\nclass A(B, *c, m=D, **k): pass\n"],
    "js": ["function f() { if (x) { return 1; } return; }", "a.b = c[d] = 1; [a, b] = [b, a]; ({a, b: c.d} = e); let x, y = 1; for (const x of y) {}", "class A { m() { return 1; } static { x(); } }"],
    "ts": ["declare const a: number;\nlet x!: string; (a as B).c = 1; a! = 2;\nnamespace N { function f(): void { return; } }"],
    "c": ["int new = 3; int f(int class) { return class + new; }\nstruct a { int b; struct { int c; } d[3]; };\ntypedef unsigned long (*fn)(void *, ...);\nstatic const char *names[] = { \"a\", [2] = \"b\" };\n"],
    "h": ["int new = 3;\n", "class A { public: A(); };\n"],
    "tsx": ["const a = <div className=\"x\" {...p}>it's {x ? <b>y</b> : null} &amp; <C.D on={() => { f(); }} /></div>;\nconst f = <T,>(x: T) => x;\nconst e = <></>;"], "jsx": ["export default function A() { return (<ul>{xs.map(x => <li key={x}>{x} don't</li>)}</ul>); }\nif (a < b && c > d) { f(); }"],
}


@pytest.mark.parametrize(("ext", "text", "valid"), [(e, t, v) for v, table in ((False, INVALID), (True, VALID)) for e, ts in table.items() for t in ts])
def test_order_targets_and_dialects(ext, text, valid):
    assert language(ext).accepts(text) is valid


def test_one_stack_for_both_languages_of_a_header():
    assert not language("cpp").accepts("int new = 3;\n") and not language("c").accepts("class A { public: A(); };\n") and not language("h").accepts("int new = ;\n")


def test_bodies_with_return_are_not_parsed_as_namespaces():
    """What may stand in a namespace or an ambient module is told from one parse where it can be."""
    spoken = language("ts")
    names, ran = spoken.grammar.names, []
    run = spoken.recogniser._run
    spoken.recogniser._run = lambda symbol, *rest: ran.append(symbol) or run(symbol, *rest)
    try:
        spoken.recogniser.forget()
        assert spoken.accepts("function f(a: number) {\n  const b = a + 1;\n  let c = [b];\n  return c;\n}\nif (x) {\n  const d = 1;\n  g(d);\n}\n")
    finally:
        del spoken.recogniser._run
    assert names["Stmts"] in ran and not {names["Tops"], names["Ambient"]} & set(ran[:-1])
    for text, valid in [
        ("declare module 'm' { const a: number; let b: string; import x from 'y'; export const c: T; }", True), ("declare global { f.return; let {a}: T; }", True), ("namespace N { import a = b.c; export let d = 1; x.return(); }", True),
        ("namespace N { const a: number; }", False), ("namespace N { return 1; }", False), ("declare module 'm' { const a: number; return 1; }", False), ("declare module 'm' { if (a) return; }", False), ("namespace N { if (a) { return; } }", False),
    ]:
        assert spoken.accepts(text) is valid, text
