import random

from sparkloom.operators.intervals import cover_and_gaps, ranges_of_hits


def brute(rows):
    out = set()
    for key in {r[0] for r in rows}:
        lines = sorted({n for k, s, e in rows if k == key and s is not None and e is not None and s <= e for n in range(s, e + 1)})
        if not lines:
            continue
        start = prev = lines[0]
        for n in [*lines[1:], None]:
            if n != prev + 1 if n is not None else True:
                out.add((key, "period", start, prev))
                if n is not None:
                    out.add((key, "gap", prev + 1, n - 1))
                    start = n
            prev = n
    return out


def test_matches_brute_force_across_blocks(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        s = rng.randint(-50, 400)
        rows.append((rng.choice(["a", "b", None]), s, s + rng.randint(-3, 12)))
    rows += [("a", None, 4), ("a", 3, None), ("b", 5, 2), *rows[:20]]
    df = spark.createDataFrame(rows, "k string, start_line int, end_line int")
    for block in (1, 7, 1024):
        got = {tuple(r) for r in cover_and_gaps(df, ["k"], block=block).collect()}
        assert got == brute(rows)


def test_touching_nested_and_extra_columns(spark):
    df = spark.createDataFrame([("x", 1, 5, "p"), ("x", 6, 9, "q"), ("x", 2, 3, "r"), ("x", 20, 20, "s")], "b string, start_line int, end_line int, kind string")
    assert sorted(map(tuple, cover_and_gaps(df, ["b"]).collect())) == [("x", "gap", 10, 19), ("x", "period", 1, 9), ("x", "period", 20, 20)]


def test_empty_and_hits(spark):
    schema = "search_id bigint, file_path string, start_line int, end_line int, nested_hits array<struct<start_line:int,end_line:int,symbol_name:string,chunk_type:string,score:double>>"
    assert cover_and_gaps(ranges_of_hits(spark.createDataFrame([], schema), ["search_id", "file_path"]), ["search_id", "file_path"]).count() == 0
    rows = [(1, "f", None, 3, [(5, 6, None, None, 0.1), (9, 8, None, None, 0.1)]), (1, "f", 7, 7, None), (1, "f", 1, 1, [])]
    got = cover_and_gaps(ranges_of_hits(spark.createDataFrame(rows, schema), ["search_id", "file_path"]), ["search_id", "file_path"])
    assert sorted(tuple(r)[2:] for r in got.collect()) == [("gap", 2, 4), ("period", 1, 1), ("period", 5, 7)]
