import random

from sparkloom.operators import chunking


def windows(text, size=4000, overlap=500):
    b, out, p = text.encode(), [], 0
    while b:
        w = b[p : p + size]
        s = 1 + b.count(b"\n", 0, p)
        out.append((bytes(w), s, s + w.count(b"\n")))
        if p + size >= len(b):
            break
        p += size - overlap
    return out


def test_windows_match_loop(spark):
    rng = random.Random(2)
    texts = ["", None, "x" * 8100, "é\n" * 3000, "a" * 4000, "a" * 4001, *("".join(rng.choice("ab\né") for _ in range(rng.randint(1, 12000))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in chunking.sliding_windows(df, ["i"], "t").orderBy("i", "idx").collect():
        got.setdefault(r.i, []).append((bytes(r.content), r.start_line, r.end_line))
    for i, t in enumerate(texts):
        assert got.get(i, []) == (windows(t) if t else [])


def pack(content, start, end, limit):
    lines = content.split("\n")
    out, cur, size, first = [], [], 0, 0
    for i, x in enumerate(lines):
        n = len(x.encode())
        joined = size + (1 if cur else 0) + n
        if cur and joined >= limit:
            out.append((first, len(cur)))
            cur, size, first = [x], n, i
        else:
            cur.append(x)
            size = joined
    out.append((first, len(cur)))
    return [("\n".join(lines[a : a + n]), start + a, end if k + 1 == len(out) else start + a + n - 1) for k, (a, n) in enumerate(out)]


def test_pack_matches_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        c = "\n".join("w" * rng.randint(0, 60) for _ in range(rng.randint(1, 60)))
        rows.append((i, c, 10, 10 + c.count("\n"), "function", "f", "def f", "P"))
    rows.append((99, "x" * 900, 1, 1, "function", "f", "s", None))
    df = spark.createDataFrame(rows, "chunk_id int, content string, start_line int, end_line int, chunk_type string, symbol_name string, signature string, parent_name string")
    got = {}
    for r in chunking.pack_lines(df, 300).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append(r)
    for r in rows:
        want = pack(r[1], r[2], r[3], 300) if len(r[1]) > 300 else [(r[1], r[2], r[3])]
        assert [(x.content, x.start_line, x.end_line) for x in got[r[0]]] == want
        assert [x.chunk_type for x in got[r[0]]] == ["function"] + ["block"] * (len(want) - 1)
        assert all(x.parent_name == r[7] for x in got[r[0]])


def test_gaps(spark):
    ranges = spark.createDataFrame([("a", 2, 5), ("a", 10, 12), ("a", 3, 4), ("a", 9, 7), ("a", None, 3)], "f string, start_line int, end_line int")
    totals = spark.createDataFrame([("a", 15), ("b", 3), ("c", 0)], "f string, lines int")
    got = sorted(map(tuple, chunking.line_gaps(ranges, totals, ["f"]).collect()))
    assert got == [("a", 1, 1), ("a", 6, 9), ("a", 13, 15), ("b", 1, 3)]


def test_token_windows_and_pool(spark):
    df = spark.createDataFrame([(1, [101, *range(10), 102]), (2, [101, 5, 102]), (3, None)], "d int, ids array<int>")
    got = [(r.d, r.window_no, r.tokens) for r in chunking.token_windows(df, ["d"], "ids", 6, 101, 102).orderBy("d", "window_no").collect()]
    assert got == [(1, 0, [101, 0, 1, 2, 3, 102]), (1, 1, [101, 4, 5, 6, 7, 102]), (1, 2, [101, 8, 9, 102]), (2, 0, [101, 5, 102])]
    v = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("a", None)], "k string, v array<float>")
    assert chunking.mean_pool(v, "k", "v").first().vector == [2.0, 4.0]


PY = "import os\n\n@deco\ndef hello():\n    return 1\n\nclass Greeter:\n    x = 1\n    def greet(self):\n        return 2\n"


def test_structural_chunkers():
    c = {(x["chunk_type"], x["symbol_name"]): x for x in chunking.chunk_file(PY, "python")}
    assert c[("method", "greet")]["parent_name"] == "Greeter" and c[("function", "hello")]["start_line"] == 4 and ("module", None) in c
    go = "package p\n\nfunc Add(a int) int {\n\treturn a // }\n}\n\ntype T struct {\n\tX int\n}\n"
    assert {(x["chunk_type"], x["symbol_name"]) for x in chunking.chunk_file(go, "go")} == {("function", "Add"), ("type", "T"), ("module", None)}
    java = "public class A {\n    private int f(int x) {\n        if (x > 1) {\n            return 1;\n        }\n        return 2;\n    }\n}\n"
    assert {(x["chunk_type"], x["symbol_name"], x["start_line"], x["end_line"]) for x in chunking.chunk_file(java, "java")} == {("class", "A", 1, 8), ("method", "f", 2, 7)}
    sh = "#!/bin/bash\nf() {\n  cat <<E\n}\nE\n  echo '}' # }\n}\nfunction g {\n  :\n}\nbroken() {\n  x\n"
    assert [(x["symbol_name"], x["start_line"], x["end_line"]) for x in chunking.chunk_file(sh, "bash") if x["chunk_type"] == "function"] == [("f", 2, 7), ("g", 8, 10)]
    md = "# A\ntext\n## B\n```\n# no\n```\n# C\n"
    assert [(x["chunk_type"], x["start_line"], x["end_line"]) for x in chunking.chunk_file(md, "markdown") if x["chunk_type"] != "module"] == [("type", 1, 6), ("type", 3, 6), ("type", 7, 8)]
    assert {x["chunk_type"] for x in chunking.chunk_file("x" * 8100, None)} == {"block"} and len(chunking.chunk_file("x" * 8100, None)) == 3
    assert chunking.chunk_file("def f(:\n", "python")[0]["chunk_type"] == "block"


def test_chunk_files_covers(spark):
    rows = [(1, "python", PY), (2, None, "abc"), (3, "go", None), (4, "go", ""), (5, "python", "def big():\n" + "    x = 1\n" * 2000)]
    out = chunking.chunk_files(spark.createDataFrame(rows, "file_id bigint, language string, content string"))
    got = out.collect()
    assert {r.file_id for r in got} == {1, 2, 5}
    big = [r for r in got if r.file_id == 5]
    assert all(len(r.content) <= 4700 for r in big) and sum(r.symbol_name == "big" for r in big) == 1
