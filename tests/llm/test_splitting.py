import random

import numpy as np

from sparkloom.llm import splitting as S


def test_range_max():
    rng = random.Random(1)
    a = np.array([rng.randint(1, 4) for _ in range(57)])
    t = S.RangeMax(a)
    for _ in range(500):
        i, j = sorted((rng.randint(0, 57), rng.randint(0, 57)))
        want = max(range(i, j), key=lambda x: (a[x], x)) if i < j else -1
        assert t.strongest(i, j) == want


def test_cuts():
    rng = random.Random(2)
    for _ in range(500):
        data = "".join(rng.choice(["a" * rng.randint(1, 80), "\n", "\n\n", "def f():\n", "é" * rng.randint(1, 400), "    x = 1\n", " ", "日"]) for _ in range(rng.randint(1, 200))).encode()
        limit, overlap = rng.choice([(4500, 500), (100, 30), (50, 25)])
        out, done = b"", 0
        for s, e in S.cuts(data, limit, overlap):
            assert e - s <= limit and s <= done and done - s <= overlap
            data[s:e].decode()
            out += data[done:e]
            done = e
        assert out == data


def test_prefers_declarations_and_whole_lines():
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 20 + "\n" for i in range(10))
    data = text.encode()
    for s, e in S.cuts(data, 500, 60)[:-1]:
        assert data[e:].startswith(b"def ") and (s == 0 or data[s - 1 : s] == b"\n")


def test_table(spark):
    long = "".join(f"line {i} é\n" for i in range(1200)).rstrip("\n")
    rows = [(1, long, 10, "a"), (1, long, 10, "a"), (2, "x" * 5000, None, "b"), (3, "short", 1, "c"), (4, None, 1, "d"), (5, "y" * 4500, 1, "e"), (6, "z" * 4499 + "\n" + "w", 1, "f"), (7, "z" * 4500 + "\nw", 1, "g")]
    df = spark.createDataFrame(rows, "chunk_id bigint, content string, start_line int, piece_no string")
    got = {}
    for r in S.split_oversized(df, "chunk_id", "content", "start_line").orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {1, 2, 6, 7} and got[2][0].cut_kind == "inside" and got[1][0].cut_kind == "line" and got[6][0].cut_kind == "line" and got[7][0].cut_kind == "inside"
    for key, text, first in ((1, long, 10), (2, "x" * 5000, 1)):
        assert b"".join(r.content.encode()[r.overlap_bytes :] for r in got[key]) == text.encode()
        lines = text.split("\n")
        for r in got[key]:
            assert len(r.content.encode()) <= 4500
            assert r.content.rstrip("\n") in "\n".join(lines[r.start_line - first : r.end_line - first + 1])
        assert got[key][-1].end_line == first + len(lines) - 1
    assert S.split_oversized(df.limit(0), "chunk_id", "content").count() == 0
