"""Declarations by language: a golden table, written by hand from what each language's grammar says of the text."""

import time

import pytest

from sparkloom.operators import structure

CASES = {
    'go': (
        'package p\n\ntype ID int\n\ntype R struct {\n\tA int\n}\n\ntype (\n\tX interface {\n\t\tF()\n\t}\n\tY string\n)\n\nfunc F() {}\n\nfunc (r *R) Get(a int) error {\n\treturn nil\n}\n',
        [('type', 3, 3, 'ID', None), ('type', 5, 7, 'R', None), ('type', 10, 12, 'X', None), ('type', 13, 13, 'Y', None), ('function', 16, 16, 'F', None), ('method', 18, 20, 'Get', None)],
    ),
    'typescript': (
        "export interface A { f(): void }\nexport type B = string | number;\ntype C = {\n  a: number;\n};\nexport async function f(x: string): Promise<void> {\n  run(() => {\n    go();\n  });\n}\nclass D extends E {\n  private x = 1;\n  constructor(a: number) {\n    super();\n  }\n  get(k: string): string {\n    if (k) {\n      return k;\n    }\n    return '';\n  }\n}\nconst g = (a: number) => a + 1;\nconst h = x => ({ a: x });\n",
        [('type', 1, 1, 'A', None), ('type', 2, 2, 'B', None), ('type', 3, 5, 'C', None), ('function', 6, 10, 'f', None), ('function', 7, 9, None, None), ('class', 11, 22, 'D', None), ('method', 13, 15, 'constructor', 'D'), ('method', 16, 21, 'get', 'D'), ('function', 23, 23, 'g', None), ('function', 24, 24, 'h', None)],
    ),
    'java': (
        'public class A extends B {\n    private int x = f(1);\n    public A(int x) {\n        this.x = x;\n    }\n    @Override\n    public List<String> get(int a) throws E {\n        return new C(a) ;\n    }\n    abstract void g();\n}\ninterface I {\n    void h();\n}\n',
        [('class', 1, 11, 'A', None), ('method', 7, 9, 'get', 'A'), ('method', 10, 10, 'g', 'A'), ('type', 12, 14, 'I', None), ('function', 13, 13, 'h', None)],
    ),
    'rust': (
        "pub struct A;\npub struct B {\n  x: i32,\n}\nenum C { X }\ntrait T {\n  fn sig(&self);\n}\nimpl B {\n  pub fn new<'a>(x: &'a str) -> B {\n    B { x: 1 }\n  }\n}\nfn main() {}\n",
        [('class', 1, 1, 'A', None), ('class', 2, 4, 'B', None), ('class', 5, 5, 'C', None), ('type', 6, 8, 'T', None), ('function', 10, 12, 'new', None), ('function', 14, 14, 'main', None)],
    ),
    'c': (
        'typedef struct { int a; } P;\nstruct Q {\n int b;\n};\nenum E { A };\nint f(void) { return 0; }\nstatic char *g(int a)\n{\n  if (a) {\n  }\n  return 0;\n}\n',
        [('type', 1, 1, 'P', None), ('class', 2, 4, 'Q', None), ('type', 5, 5, 'E', None), ('function', 6, 6, 'f', None), ('function', 7, 12, 'g', None)],
    ),
    'cpp': (
        'namespace n {\nclass C : public D {\n public:\n  int f() const { return 1; }\n};\n}\nint n::C::g(int a) { return a; }\n',
        [('type', 1, 6, 'n', None), ('class', 2, 5, 'C', None), ('method', 4, 4, 'f', 'C'), ('function', 7, 7, 'n::C::g', None)],
    ),
    'ruby': (
        'class C\n  def m; end\n  def self.n(a)\n    if a\n      1\n    end\n    x = y if z\n    list.each do |q|\n      q\n    end\n  end\nend\nmodule M\nend\n',
        [('class', 1, 12, 'C', None), ('method', 2, 2, 'm', 'C'), ('method', 3, 6, 'n', 'C'), ('class', 13, 14, 'M', None)],
    ),
    'c_sharp': (
        'class C { void M() {} }\ninterface I { int N(int a); }\nrecord R(int A);\n',
        [('class', 1, 1, 'C', None), ('method', 1, 1, 'M', 'C'), ('type', 2, 2, 'I', None), ('method', 2, 2, 'N', None), ('type', 3, 3, 'R', None)],
    ),
    'php': (
        '<?php function f() {}\nclass C {\n  public function g($a) { return 1; }\n}\ninterface I {}\n?>\n',
        [('function', 1, 1, 'f', None), ('class', 2, 4, 'C', None), ('method', 3, 3, 'g', 'C'), ('type', 5, 5, 'I', None)],
    ),
    'swift': (
        'func f() {}\nclass C {\n func g() -> Int { 1 }\n}\nprotocol P {}\n',
        [('function', 1, 1, 'f', None), ('class', 2, 4, 'C', None), ('method', 3, 3, 'g', 'C'), ('type', 5, 5, 'P', None)],
    ),
    'kotlin': (
        'fun f() {}\nclass A(val x: Int)\nobject O {\n  fun g(a: Int): Int = a + 1\n}\n',
        [('function', 1, 1, 'f', None), ('class', 2, 2, 'A', None), ('class', 3, 5, 'O', None), ('method', 4, 4, 'g', 'O')],
    ),
    'scala': (
        'object O { def f() = 1 }\ntrait T\nclass C(a: Int) extends D {\n  def g(b: Int): Int = {\n    b\n  }\n}\n',
        [('class', 1, 1, 'O', None), ('method', 1, 1, 'f', 'O'), ('type', 2, 2, 'T', None), ('class', 3, 7, 'C', None), ('method', 4, 4, 'g', 'C')],
    ),
    'lua': (
        'function f() end\nlocal function g(a)\n  if a then\n  end\nend\nx = function() return 1 end\n',
        [('function', 1, 1, 'f', None), ('function', 2, 5, 'g', None), ('function', 6, 6, None, None)],
    ),
    'dart': (
        'void f() {}\nclass C {\n  int g(int a) {\n    return a;\n  }\n}\n',
        [('function', 1, 1, 'f', None), ('class', 2, 6, 'C', None), ('method', 3, 3, 'g', 'C')],
    ),
    'r': (
        'f <- function() 1\ng <- function(a) {\n  a\n}\n',
        [('function', 1, 1, None, None), ('function', 2, 4, None, None)],
    ),
    'objc': (
        '@interface C\n- (void)x;\n@end\n@implementation C\n- (void)x {\n}\n@end\n',
        [('class', 1, 3, 'C', None), ('class', 4, 7, 'C', None), ('method', 5, 6, 'x', 'C')],
    ),
    'html': (
        '<!DOCTYPE html><html></html>\n',
        [('type', 1, 1, None, None)],
    ),
    'css': (
        '.x { color: red; }\n@media a {\n .y, .z {\n  a: b;\n }\n}\n',
        [('class', 1, 1, None, None), ('class', 3, 5, None, None)],
    ),
    'scss': (
        '.x { color: red; }\n@mixin m($a) { b: c; }\n',
        [('class', 1, 1, None, None), ('function', 2, 2, 'm', None)],
    ),
    'sql': (
        "CREATE TABLE t (id INT);\nCREATE FUNCTION f() RETURNS INT AS 'x';\n",
        [('type', 1, 1, 't', None), ('function', 2, 2, 'f', None)],
    ),
    'zig': (
        'fn f() void {}\nconst S = struct { a: u8 };\n',
        [('function', 1, 1, 'f', None), ('class', 2, 2, 'S', None)],
    ),
    'julia': (
        'function f() end\nfunction g(a)\n  for i in a\n  end\nend\n',
        [('function', 1, 1, 'f', None), ('function', 2, 5, 'g', None)],
    ),
    'fortran': (
        'module m\ncontains\nsubroutine s(a)\n  if (a) then\n  end if\nend subroutine\ninteger function f(x)\nend function f\nend module\n',
        [('class', 1, 9, 'm', None), ('method', 3, 6, 's', 'm'), ('method', 7, 8, 'f', 'm')],
    ),
    'haskell': (
        'module M where\n\nf :: Int -> Int\nf x = x\n\ndata D = A\n  | B\n',
        [('function', 3, 3, 'f', None), ('function', 4, 4, 'f', None), ('type', 6, 7, 'D', None)],
    ),
    'ocaml': (
        'let f x = x\nmodule M = struct\n  let g = 1\nend\ntype t = int\n',
        [('function', 1, 1, 'f', None), ('class', 2, 3, 'M', None), ('method', 3, 3, 'g', 'M'), ('type', 5, 5, 't', None)],
    ),
}


@pytest.mark.parametrize("language", CASES)
def test_declarations(language):
    text, want = CASES[language]
    assert structure.pieces(text.split("\n"), language) == want


def test_literals_and_comments_hide_declarations():
    assert structure.pieces(["// func F() {", 'x := "func G() {"', "/* type T struct {", "} */"], "go") is None
    assert structure.pieces(["f(x, '{');", "// class A {"], "javascript") is None and structure.pieces([""], "java") is None


def test_regular_expressions_hide_brackets():
    text = "const a = /[{(]x\\/+/g.test(b);\nfunction f() {\n  return /}/.exec(c) / 2;\n}\n"
    assert structure.pieces(text.split("\n"), "javascript") == [("function", 2, 4, "f", None)]


def test_python_that_does_not_parse():
    text = "x = = 1\nclass A(B):\n    def f(\n        self,\n    ) -> int:\n        return 1\n\n    async def g(self): pass\nclass C:\n    pass\ndef h(:\n"
    assert structure.pieces(text.split("\n"), "python") == [("class", 2, 8, "A", None), ("method", 3, 6, "f", "A"), ("method", 8, 8, "g", "A"), ("class", 9, 10, "C", None)]


@pytest.mark.parametrize("language", CASES)
def test_any_cut_of_a_file_is_read(language):
    text = CASES[language][0]
    for n in range(len(text)):
        for p in structure.pieces(text[:n].split("\n"), language) or ():
            assert 1 <= p[1] <= p[2] <= text[:n].count("\n") + 1


def test_long_files_take_linear_time():
    t = time.perf_counter()
    one = "export const f = (a) => {\n  g(() => a);\n};\nclass A {\n  m(x) {\n    if (x) {\n    }\n  }\n}\n"
    assert len(structure.pieces((one * 2000).split("\n"), "typescript")) == 8000
    assert structure.pieces(("(" * 20_000).split("\n"), "java") is None and structure.pieces(["{" * 20_000], "c") is None
    assert time.perf_counter() - t < 20
