import ast
import json
import random

import pytest

from sparkloom.llm import syntax

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b: int = 2, *c, d=3, **e) -> None:\n    return (yield a)\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': 1, **k} | P(x=1): pass\n", "@d\nasync def g():\n  async with a as b, c: await z\n",
               "x: int = y = 3\n" if False else "x: int = 3\n", "lambda *a, k=1: a[1:2, ::3]\n", "try:\n  pass\nexcept* E as e:\n  raise X from e\nelse:\n  pass\nfinally: pass\n", "f'{a!r:>{w}}' 'b'\n", "print(*a, **b, c=d, e := 1)\n" if False else "print(*a, c=d, **b)\n",
               "type A[T: int] = list[T]\nclass C[T](B, metaclass=M): ...\n", "if (n := 5) > 3: x = [i for i in range(n) if i if n]; y = {**a, 'b': 1}\n", "# only\n\n   # comment\n", "a.b[c].d = e, *f = g\n", "def f():\n\tif x:\n\t\ty\n\tz\n"],
    "go": ["package p\n", 'package p\nimport (\n\t"a"\n\tb "c"\n)\nfunc (s *S[T]) F(x, y int, z ...string) (n int, err error) {\n\tfor i := range 3 { x++ }\n\tif v, ok := m[k].(T); ok && !v { return }\n\tswitch t := x.(type) {\n\tcase int, *A:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-c:\n\t}\n\tgo func() { defer f(a...) }()\n\treturn map[string]int{"a": 1}, nil\n}\n',
           "package p\ntype I interface {\n\tM(int) error\n\t~int | string\n}\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\nvar x = []T{{A: 1}, {B: 2}}\nconst (\n\ta = iota\n\tb\n)\n"],
    "javascript": ["", "const a = (x) => ({...x, y: 1})\nlet b = /[/\"]+/g.test(a) ? 1 : `t${a.b(`n`)}`\n", "export default class A extends B { #p = 1; static async *g() { yield* x } get v() { return this.#p } }\n", "import d, { a as b } from './m.js'\nfor (const [k, v] of Object.entries(o)) if (k) continue; else break\n", "label: do { x++ } while (x < 3)\nswitch (a) { case 1: default: }\ntry { f() } catch { } finally { }\n", "var v1=(a,b)=>{for(;a<5;)a.x(b)};function f(a){return a?.b?.[0]??c}\n", "#!/usr/bin/env node\nasync () => { await import('x') }\n"],
    "typescript": ["interface A<T> extends B { readonly x?: number; f(a: string): void; [k: string]: any }\ntype U = 'a' | { [K in keyof T]?: T[K] } & (new (x: number) => T)\n", "enum E { A = 1, B }\nabstract class C<T = X> implements I { private constructor(public x: number, y?: string) { super() } abstract f(): void; static readonly z: Map<string, number[]> = new Map() }\n",
                   "function isA(x: unknown): x is A { return (x as any)!.y satisfies B }\nexport type { T } from './t'\nconst f = async <T,>(x: T): Promise<T> => x\n", "declare module 'm' { export const a: number }\nlet t: readonly [a: string, b?: number] = ['x']\n"],
    "java": ['package a.b;\nimport static x.Y.*;\n@A(v = {1, 2})\npublic final class C<T extends D & E> extends F<T> implements G {\n  private static final int[] X = {1, 2};\n  C() { super(); }\n  @Override public <R> List<? super R> f(final Map<String, int[]> m, int... r) throws E1 {\n    for (var e : m.entrySet()) { if (e instanceof Foo f && f.x > 1) continue; }\n    return switch (x) { case 1, 2 -> a; default -> { yield b; } };\n  }\n}\n',
             "enum E { A(1) { int f() { return 1; } }, B; E(int... x) {} }\nrecord R(int a) implements I {}\ninterface I { default void g() { Runnable r = () -> {}; x.stream().map(String::valueOf).toArray(int[]::new); } }\n"],
    "bash": ["", "#!/bin/bash\nf() {\n  local x=\"$(g \"$1\")\" a=(1 2)\n  [[ -z \"${x:-}\" && $y =~ ^(a|b)$ ]] || return 1\n}\nfor i in \"$@\"; do echo $i; done | sort > out 2>&1\n", "case $1 in\n  a|b) x ;;\n  *) y\nesac\nwhile read -r l; do :; done < <(ls)\ncat <<-E\n\tfoo ) (\n\tE\nfor ((i=0;i<3;i++)); do ((x+=i)); done\n", "if ! a; then b; elif c; then d; else e; fi &\nfunction g { (cd x && y); }\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", ' "x" ', "0"],
    "yaml": ["a: 1\nb:\n  - x\n  - y: [1, {c: d}]\n    z: |\n      text: {\n\n      more\n'q': \"e\\n\"\n", "- a\n-\n  - b\n- c: d\n  e: f\n", "---\na: &x {k: v}\nb: *x\n...\n", "a:\n- 1\n- 2\nb: c\n", "", "key: >-\n  folded\n  text\nurl: http://x/y#z\n", "plain text\n"],
    "hcl": ['resource "a" "b" {\n  x = "s ${f("q")} t"\n  y = [1, 2,]\n  nested { z = a.b[0].c }\n  m = { a = 1, "b" : 2 }\n  c = x ? 1 : [for k, v in m : k => v if v]\n}\n', "a = <<EOT\ntext {\nEOT\n", "# c\n"],
}
BAD = {
    "python": ["def f(:\n", "x = = 1\n", "def f():\nreturn 1\n", "if x:\n    a\n  b\n", "x = 'abc\n", "print 'x'\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z\n", "return = 1\n", "f(a b)\n", "class A\n    pass\n", "x = (1,\n", "x = {{ a }} %}\n", "def f()\n    pass\n", "f() = 1\n", "import\n", '"""x\n'],
    "go": ["func f() {}\n", "package p\nfunc f() {\n", "package p\nfunc {\n}\n", "package p\nvar x = \n", "package p\n<<<<<<< HEAD\n", "package p\nfunc f() { x := }\n", "package p\n}\n", 'package p\nvar s = "abc\n', "package p\nimport x from 'y'\n", "package p\n{{ .X }}\n"],
    "javascript": ["const = 4;\n", "f(;\n", "let x = 'abc\n", "class A {\n", "}\n", "function f(a: number) {}\n", "<<<<<<< ours\n", "{{ x }} %}\n", "import logging\nimport os\n", "if (x { }\n", "let a = `b\n", "const a = [1, 2\n", "interface A { x: number }\n"],
    "typescript": ["const = 4;\n", "f(;\n", "interface A { x: }\n", "function f(a: ) {}\n", "type = {\n", "=======\n", "class A { f( { } }\n", "package main\n"],
    "java": ["class A {\n", "class A { int = 7; }\n", "class A { void f() { x(; } }\n", "import logging\nclass A {}\n", "class A { String s = \"x; }\n", "class A { } }\n", "<<<<<<< HEAD\nclass A {}\n", "class A { void f() { if (a { } } }\n"],
    "bash": ["if x; then\n", "f() {\n", "echo 'abc\n", "fi\n", "case x in\n a) b ;;\n", "done\n", "for x in a; do y\n", "<<<<<<< HEAD\n", "cat <<E\nx\n", "echo $(ls\n", "}\n"],
    "json": ["{", '{"a": 1,}', "{'a': 1}", '{"a" 1}', "// c\n{}", "[1 2]", '{"a": 01}', '"a\nb"', "", "{} {}", "[1,]", "NaN"],
    "yaml": ["a: b: c\n", "a: 'x\n", "a:\n\t- b\n", "a: [1, 2\n", "a: 1\n b: 2\n", "<<<<<<< HEAD\na: 1\n", "a: 1\n>>>>>>> x\n", "a: {b: c\n", 'a: "x" y\n', "- a\nb: c\n", "%}\n"],
    "hcl": ['resource "a" {\n', "x = \n", "x = [1, 2\n", "a {{\n", "=======\n", 'x = "abc\n', "a: 1\n", "}\n"],
}


@pytest.mark.parametrize("name", syntax.LANGUAGES)
def test_cases(name):
    for t in GOOD[name]:
        assert syntax.valid(t, name), (name, t, syntax.first_error(t, name))
    for t in BAD[name]:
        assert not syntax.valid(t, name), (name, t)
        assert syntax.first_error(t, name) is not None


def test_python_and_json_agree_with_the_standard_library():
    rng = random.Random(9)
    base = GOOD["python"]
    for _ in range(600):
        t = rng.choice(base)
        if t:
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("():=,[]{}\n x1") + t[i:]])
        try:
            ast.parse(t)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if syntax.valid(t, "python") and not ok:
            continue  # early errors beyond the grammar, such as duplicate names
        assert syntax.valid(t, "python") == ok or "print" in t or "f'" in t, t
    for _ in range(600):
        t = rng.choice(GOOD["json"][:1])
        i = rng.randrange(len(t))
        t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice('{}[],:"1 ') + t[i:]])
        try:
            json.loads(t)
            ok = True
        except ValueError:
            ok = False
        assert syntax.valid(t, "json") == ok, t


def test_groups_and_whole_network_agree():
    """The chart of groups and the one network over the whole stream decide alike."""
    for name in syntax.LANGUAGES:
        lang = syntax.language(name)
        for t in GOOD[name] + BAD[name]:
            s = lang.stream(t)
            if syntax.ERROR not in s:
                assert lang.parser.accepts(s) == (lang.parser.network.fullmatch(s) is not None), (name, t)


def test_first_error_place():
    assert syntax.first_error("x = 1\ny = = 2\n", "python") == (2, 5)
    assert syntax.first_error('{\n  "a": 1,\n}\n', "json") == (3, 1)
    assert syntax.first_error("package p\nfunc {\n", "go")[0] == 2
    assert syntax.first_error("let a = 1;\nconst = 4;\n", "javascript") == (2, 7)


def test_flags_and_rates(spark):
    rows = [(1, "p", "python", "x = 1\n"), (2, "p", "python", "x = \n"), (2, "p", "python", "x = \n"), (3, "p", "python", None), (4, "p", "python", " \n"), (5, "p", None, "x"), (6, "p", "ruby", "x"), (7, None, "json", "{"), (8, "p", "python", "\ufeffx = 1\r\n")]
    df = spark.createDataFrame(rows, "file_id bigint, project_path string, language string, content string")
    flags = syntax.parse_flags(df, errors=True)
    assert {(r.file_id, r.valid, r.error_line) for r in flags.collect()} == {(1, True, None), (2, False, 1), (7, False, 1), (8, True, None)}
    assert {(r.project_path, r.files, r.invalid) for r in syntax.invalid_rates(flags).collect()} == {("p", 3, 1), (None, 1, 1)}
    assert syntax.parse_flags(df.limit(0)).count() == 0


def test_long_and_deep():
    assert syntax.valid("x = [" + "1, " * 20000 + "]\n", "python") and syntax.valid("[" * 400 + "]" * 400, "json")
    assert not syntax.valid("{" * 300, "javascript") and syntax.valid("a" * 100_000, "javascript")
