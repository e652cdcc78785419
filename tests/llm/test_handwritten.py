import random

import pytest

from sparkloom.llm import handwritten as H

BODY = "def f(a):\n    return a + 1\n\n\ndef g(b):\n    return b\n" * 3
CASES = [
    ("a/x.py", "# Code generated by x. DO NOT EDIT.\n" + BODY, "generated"), ("a/x.py", "#!/usr/bin/env python\n# Copyright\n#\n# @generated\n" + BODY, "generated"), ("a/x.go", "/*\n * Automatisch erzeugt von x, nicht bearbeiten.\n */\npackage p\n", "generated"), ("a/x.py", "# AUTOGENERATED by x -- do not modify\n" + BODY, "generated"),
    ("a/x.py", "# Originally generated by x, maintained by hand since 2021.\n" + BODY, None), ("a/x.py", "# Writes the files that x users must not edit, rev 1.\n" + BODY, None), ("a/x.py", "# Unlike the x output this file is edited by hand.\n" + BODY, None), ("a/x.py", BODY + 'T = "# @generated, do not edit"\n', None), ("a/x.py", '"""Auto-generated function stub"""\n' + BODY, None),
    ("a/x.js", BODY + "// Copyright\n\n/*\n * AUTOGENERATED by x -- do not modify\n */\n", "generated"), ("a/x.py", BODY + "# Unlike the x output this file is edited by hand.\n", None),
    ("a/x.js", "// Licensed under the x Public Terms, version 4.\n" + BODY, None), ("a/package-lock.json", "{}", "lock"), ("a/b.json", '{\n  "lockfileVersion": 3\n}', "lock"), ("a/block.json", '{"a": 1}', None), ("a/vendor/x.py", BODY, None), ("a/lib/foo-2.1.0/x.py", BODY, None),
    ("a/x.py", "# Bundled copy of the x library 6.6.1. See LICENSE.x\n" + BODY, "upstream"), ("a/x.js", "var a=(b)=>{for(;b<5;)b.c(d)};" * 60, "minified"), ("a/x.js", 'const Q = "' + "select a, b, c " * 300 + '";\n' + BODY, None), ("a/t.py", "X = [\n" + "    1, 2, 3, 4, 5, 6,\n" * 40 + "]\n", "data"),
    ("a/t.go", "package p\n\nvar x = []string{\n" + '\t"zj2VSKYtNMP322TXwcgoEH6bjNEkcHIzp74GifIep3sKWL8woVtiuui5",\n' * 30 + "}\n", "data"), ("a/x.json", '{"a": [' + "1, " * 500 + "1]}", None), ("a/x.pb.go", "package p\n" + "".join(f"func get_field_{i:03d}() {{\n}}\n" for i in range(6)), "generated"), ("a/x.md", "Code generated by x. DO NOT EDIT.\n", None),
]


@pytest.mark.parametrize(("path", "text", "why"), CASES)
def test_reason(path, text, why):
    assert H.reason(path, text) == why


HEAD = "".join(f"// Line {i} of a licence.\n" for i in range(60))
LONG = [
    ("a/x.js", HEAD + "// Code generated by x. DO NOT EDIT.\n" + BODY, "generated"), ("a/x.js", "/*\n" + " * text\n" * 60 + " * Bundled copy of the x library.\n */\n" + BODY, "upstream"),
    ("a/x.js", BODY + "// Code generated by x. DO NOT EDIT.\n" + HEAD, "generated"), ("a/x.js", BODY + "/*\n * Code generated by x. DO NOT EDIT.\n" + " * text\n" * 60 + " */\n", "generated"), ("a/x.js", HEAD + BODY + HEAD, None),
    ("a/x.js", 'var s = "code generated by x";\n' + BODY + "f(); /* done */\n", None), ("a/x.js", 'var s = "code generated by x";\n' + BODY + "f(); /* done\n here */\n", None), ("a/deps.txt", "name: x\n" * 1_000 + "lockfileVersion: 9\n", "lock"),
]


@pytest.mark.parametrize(("path", "text", "why"), LONG)
def test_marks_beyond_long_heads_and_tails(path, text, why):
    assert H.reason(path, text) == why


_RNG = random.Random(2)
BLOB = "".join(_RNG.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(50_000))
WRAPPED = "\n".join(BLOB[i : i + 64] for i in range(0, len(BLOB), 64))
SHORT = [
    ("a/x.js", f'const DATA = "{BLOB}";\n', "data"), ("a/x.js", HEAD + f'export const DATA = "{BLOB}";\n', "data"), ("a/x.py", "T = [" + ", ".join(str(_RNG.randint(0, 99)) for _ in range(2_000)) + "]\n", "data"), ("a/x.go", "package p\n\nvar t = []int{\n" + ("\t" + "12, 34, -56, " * 200 + "\n") * 3 + "}\n", "data"),
    ("a/x.py", "T = [" + ", ".join(f'"New {i} Street"' for i in range(300)) + "]\n", "data"), ("a/x.py", 'Q = "' + "select a, b from t where c " * 300 + '"\n', None), ("a/x.py", "T = [1, 2, 3]\n", None), ("a/x.py", BODY * 10, None),
    ("a/x.py", "\n".join(f'NAME_OF_A_{i} = call_{i}("v{i}", {i})' for i in range(9)) + "\n" + HEAD.replace("//", "#"), None), ("a/x.py", HEAD.replace("//", "#") + "X = 1\n", None),
    ("a/x.sh", "cat > c.pem <<'END'\n-----BEGIN CERTIFICATE-----\n" + WRAPPED[:1_300] + "\n-----END CERTIFICATE-----\nEND\n" + "chmod 6 c d e f\n" * 24, None), ("a/x.sh", "base64 -d > c.bin <<'END'\n" + WRAPPED + "\nEND\n", "data"),
]


@pytest.mark.parametrize(("path", "text", "why"), SHORT)
def test_data_on_few_lines(path, text, why):
    assert H.reason(path, text) == why


def test_fingerprints():
    codes = H._Codes()
    a = H.fingerprints(BODY, codes)
    assert set(a) == set(H.fingerprints("# other comment\n" + BODY.replace("    ", "\t"), codes))
    assert len(H.fingerprints("", codes)) == 0 and len(H.fingerprints("x " * (H.K - 1), codes)) == 0 and len(H.fingerprints("x " * H.K, codes)) == 1
    long = " ".join(f"t{i}" for i in range(500))
    b = H.fingerprints(long, codes)
    assert len(set(b) & set(H.fingerprints("zzz " + long + " yyy", codes))) >= len(b) - 2
    # the guarantee of winnowing: any k + window - 1 common tokens share a fingerprint
    part = " ".join(f"t{i}" for i in range(100, 100 + H.K + H.WINDOW - 1))
    assert set(b) & set(H.fingerprints(part, codes))


SCHEMA = "file_id bigint, project_path string, path string, content string"


def _unique(rng, s):
    return "\n".join(f"v{s}_{i} = call_{rng.randint(0, 9999)}(x{i}, {i})" for i in range(60))


def test_recurring_copies(spark):
    rng = random.Random(1)
    copied = _unique(rng, "lib")
    rows = [(i, f"p{i}", f"/p{i}/src/a.py", copied + f"\n# {i}\nextra_{i} = 1\n") for i in range(3)]  # neutral paths
    rows += [(10, "p0", "/p0/b.py", _unique(rng, "own")), (11, "p1", "/p1/c.py", copied[:300] + _unique(rng, "most")), (12, "p2", "/p2/d.py", None), (13, "p3", "/p3/e.py", "  \n"), (14, None, None, "x = 1\n")]
    two = _unique(rng, "two")
    rows += [(20, "p5", "/p5/x.py", two), (21, "p6", "/p6/x.py", two), (22, "p6", "/p6/y.py", two), (0, "p0", "/p0/src/a.py", rows[0][3])]
    once = _unique(rng, "once")
    rows += [(30, "p7", "/p7/x.py", once), (31, "p7", "/p7/y.py", once), (32, "p8", "/p8/x.py", "import a\n"), (33, "p9", "/p9/x.py", "import a\n")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lambda **kw: {tuple(r) for r in H.not_handwritten(df, **kw).collect()}
    assert got() == {(i, "copy") for i in (0, 1, 2, 20, 21, 22)}  # copies within one project and tiny texts are none
    assert got(projects=3) == {(i, "copy") for i in range(3)}
    assert H.not_handwritten(df.limit(0)).count() == 0


def test_directories_learn_from_copies(spark):
    rng = random.Random(3)
    libs = [_unique(rng, f"lib{i}") for i in range(30)]
    # a name no convention knows, full of copies; and a conventional one that holds a project's own work
    rows = [(100 * p + i, f"/r/p{p}", f"/r/p{p}/src/upstreams/f{i}.py", t) for p in range(2) for i, t in enumerate(libs)]
    rows += [(900, "/r/p3", "/r/p3/src/upstreams/only_here.py", _unique(rng, "only"))] + [(3000 + i, "/r/p3", f"/r/p3/src/own{i}.py", _unique(rng, f"mine{i}")) for i in range(100)]
    rows += [(1000 + i, "/r/p4", f"/r/p4/external/f{i}.py", _unique(rng, f"own{i}")) for i in range(40)]
    rows += [(2000, "/r/p5", "/r/p5/node_modules/a/x.js", _unique(rng, "n")), (2001, "/r/node_modules", "/r/node_modules/x.js", _unique(rng, "m"))]
    got = {tuple(r) for r in H.not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(r, why) for r, why in got if r >= 900} == {(900, "directory"), (2000, "directory")}
    assert {r for r, why in got if why == "copy"} == {100 * p + i for p in range(2) for i in range(30)}
