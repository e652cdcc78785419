import pytest

from sparkloom.llm import docpairs as D

TRIVIAL = ["", "---", "####", "tbd", "TODO", "TODO(x): describe the parameters and the return value before 2.3 ships", "noqa: C901", "pylint: disable=x", "eslint-disable-next-line no-shadow", "type: ignore", "@param a\n@returns", "{@inheritDoc}", "Auto-generated method stub", "Description goes here.", "docs pending",
           "XXX write docs", "n/a", "...", "load file", "The load file function.", "loadFile", "LOAD FILE", "return f(x, 1)", "x = f(y, retries=3)", "if a: b(c)", "load_file()", ":param x:\n:rtype: int", "Args:\n    x:\nReturns:", "noinspection unused", "@ts-ignore", "go:generate x", "!!!"]
REAL = ["Never blocks.", "Nil means no row.", "Costs O(n) per file.", "空なら null を返す。", "Renvoie -1 si vide.", "@param a the file to load", "TODO(x): revisit.\nReturns the file of a project.", "nolint:x\nReads it twice.", "Returns the shared archive for the given set, or nothing.", ":returns: the open handle", "453 is the upper bound.", "If `x` is missing, falls back.", "Nobody has touched the shard since.", "Args:\n    x: the path"]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert not D.meaningful(doc, "loadFile") and not D.meaningful(doc, "load_file")


@pytest.mark.parametrize("doc", REAL)
def test_real(doc):
    assert D.meaningful(doc, "loadFile")


def doc(text, line, language, name="f"):
    lines = text.split("\n")
    starts, n = [], 0
    for x in lines:
        starts.append(n)
        n += len(x) + 1
    return D.documentation(lines, text, starts, line, language, name)


def test_places():
    assert doc('def f(a, b=")"):\n    """Reads it."""\n', 1, "python") == "Reads it."
    assert doc("async def f(\n    a: dict[str, int],\n) -> int:  # c\n    # x\n\n    'Reads it.'\n", 1, "python") == "Reads it."
    assert doc("# Reads it.\n@d\n@e(\n    1\n)\ndef f():\n    pass\n", 6, "python") == "Reads it."
    assert doc("# Reads it.\n\ndef f():\n    pass\n", 3, "python") == ""
    assert doc('def f():\n    x = 1\n    """no"""\n', 1, "python") == ""
    assert doc('def f():\n    f"""no {x}"""\n', 1, "python") == ""
    assert doc("/**\n * Reads it.\n *\n * @param x\n */\n@Override\npublic void f() {\n", 7, "java") == "Reads it.\n\n@param x"
    assert doc("// Reads it.\n// Twice.\nfunc f() {\n", 3, "go") == "Reads it.\nTwice."
    assert doc("/*\nReads it.\n*/\nfunc f() {\n", 4, "go") == "Reads it."
    assert doc("x() /* Reads it. */\nfunction f() {\n", 2, "javascript") == ""
    assert doc("# Reads it.\r\nf() {\r\n", 2, "bash") == "Reads it."
    assert doc("#!/bin/bash\nf() {\n", 2, "bash") == ""
    assert doc("x", 5, "go") == "" and doc("x", 0, "go") == "" and doc("", 1, None) == ""


def test_long_decorators_and_signatures():
    java = "/** Reads it. */\n@ApiResponses(value = {\n" + '    @ApiResponse(code = 200, description = "a :( b"),\n\n' * 20 + "}) // end\n@Override\npublic void f() {\n"
    assert doc(java, java.count("\n"), "java") == "Reads it."
    python = "# Reads it.\n@d(\n" + "    1,  # (\n" * 30 + "\n)  # noqa\ndef f():\n    pass\n"
    assert doc(python, 35, "python") == "Reads it."
    ts = "// Reads it.\n@D({\n" + "  a: b(1),\n" * 30 + "})\nf() {\n"
    assert doc(ts, 34, "typescript") == "Reads it."
    assert doc("// Reads it.\nd(\n" + "  1,\n" * 30 + ")\nf() {\n", 34, "typescript") == ""
    assert doc("// Reads it.\n\n@D(\n" + "  1,\n" * 30 + ")\nf() {\n", 35, "typescript") == ""
    assert doc("def f(\n" + "".join(f"    argument_{i}: int = {i},\n" for i in range(2_000)) + "):\n    'Reads it.'\n", 1, "python") == "Reads it."


SYM = "symbol_id string, file_id bigint, project_path string, name string, kind string, file_path string, line int, end_line int, language string, signature string, parent_name string"


def test_pairs_and_inheritance(spark):
    java = "class A {\n    /** Reads the file. */\n    void f() {}\n}\nclass B extends A {\n    void f() {}\n    void g() {}\n}\nclass C extends B implements I<X> {\n    /** {@inheritDoc} */\n    void f() {}\n}\n"
    files = spark.createDataFrame([(1, "p", java), (1, "p", java), (2, "p", None), (3, "p", "")], "file_id bigint, project_path string, content string")
    rows = [("a", 1, "p", "A", "class", "x", 1, 4, "java", None, None), ("b", 1, "p", "B", "class", "x", 5, 8, "java", None, None), ("c", 1, "p", "C", "class", "x", 9, 12, "java", None, None),
            ("af", 1, "p", "f", "method", "x", 3, 3, "java", None, "A"), ("bf", 1, "p", "f", "method", "x", 6, 6, "java", None, "B"), ("bg", 1, "p", "g", "method", "x", 7, 7, "java", None, "B"), ("cf", 1, "p", "f", "method", "x", 11, None, "java", None, "C"),
            ("n", 1, "p", None, "function", "x", None, None, None, None, None), ("o", 2, "p", "q", "function", "x", 3, 3, "go", None, None), ("z", 9, "p", "q", "function", "x", 3, 3, "go", None, None)]
    symbols = spark.createDataFrame(rows, SYM)
    found = D.read(symbols, files).dropDuplicates(["file_id", "line"]).cache()
    pairs = D.pairs_of(found)
    assert {(r.symbol_id, r.documentation) for r in pairs.collect()} == {("af", "Reads the file."), ("bf", None), ("bg", None), ("cf", None)}
    bases = D.hierarchy(found)
    assert {tuple(r) for r in bases.collect()} == {(1, "B", 1, "A"), (1, "C", 1, "B")}
    got = {r.symbol_id: (r.documentation, r.documented_in, r.level) for r in D.inherit(pairs, bases).collect()}
    assert got == {"af": ("Reads the file.", "A", 0), "bf": ("Reads the file.", "A", 1), "cf": ("Reads the file.", "A", 2)}
    assert got == {r.symbol_id: (r.documentation, r.documented_in, r.level) for r in D.documented(symbols, files, code=False).collect()}
    assert D.documented(symbols.limit(0), files).count() == 0
    cyclic = spark.createDataFrame([(1, "B", 1, "C"), (1, "C", 1, "B")], bases.schema)
    assert {r.symbol_id for r in D.inherit(pairs, cyclic).collect()} == {"af"}


def test_deep_hierarchies_and_classes_of_one_name(spark):
    n = 24  # a chain of classes, only the first of which documents its method
    text = "".join(f"class C{i}{f'(C{i - 1})' if i else ''}:\n    def run(self):\n        {repr('Reads the file.') if not i else 'pass'}\n" for i in range(n))
    other = "class C0:\n    def run(self):\n        'Writes it.'\nclass D(C0):\n    def run(self):\n        pass\n"
    away = "class E(C5, metaclass=M):\n    def run(self):\n        pass\nclass F(pkg.C0):\n    def run(self):\n        pass\n"
    files = spark.createDataFrame([(1, "p", text), (2, "p", other), (3, "p", away)], "file_id bigint, project_path string, content string")
    rows = []
    for fid, names in ((1, [f"C{i}" for i in range(n)]), (2, ["C0", "D"]), (3, ["E", "F"])):
        for k, c in enumerate(names):
            rows += [(f"{fid}{c}", fid, "p", c, "class", f"/p/d{fid}/x.py", 3 * k + 1, 3 * k + 3, "python", None, None), (f"{fid}{c}.run", fid, "p", "run", "method", f"/p/d{fid}/x.py", 3 * k + 2, 3 * k + 3, "python", None, c)]
    got = {r.symbol_id: (r.documentation, r.level) for r in D.documented(spark.createDataFrame(rows, SYM), files).collect()}
    want = {f"1C{i}.run": ("Reads the file.", i) for i in range(n)} | {"2C0.run": ("Writes it.", 0), "2D.run": ("Writes it.", 1), "3E.run": ("Reads the file.", 6)}
    assert got == want  # F's base is one of two classes of that name in other places: unresolved


def test_bases():
    assert D.bases_of("public class A<T extends X> extends b.B<T, C<D>> implements E,\n    F {\n", 0, "A") == ["B", "E", "F"]
    assert D.bases_of("@d\nclass A(m.B, Generic[T], metaclass=M):\n", 0, "A") == ["B"]
    assert D.bases_of("export class A extends B {", 0, "A") == ["B"] and D.bases_of("class A {\n  x extends B {", 0, "A") == [] and D.bases_of("class A:", 0, "B") == []
