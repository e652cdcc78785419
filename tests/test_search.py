import math
import random

import pytest

from sparkloom.operators import search

HIT = "file_path string, start_line int, end_line int, score double, symbol_name string, chunk_type string, language string, rank int"


def hits(spark, rows):
    full = [(f, s, e, sc, sym, kind, "go", i) for i, (f, s, e, sc, sym, kind) in enumerate(rows)]
    return spark.createDataFrame(full, HIT)


def merged(spark, rows):
    out = search.merge_overlaps(hits(spark, rows)).orderBy("score", ascending=False)
    return [(r.file_path, r.start_line, r.end_line, r.score, r.symbol_name, len(r.nested_hits)) for r in out.collect()]


def loop(rows):
    """Each parent in order absorbs the later hits that match it."""
    order = sorted(range(len(rows)), key=lambda i: (-(rows[i][2] - rows[i][1]), rows[i][1], -rows[i][3], i))
    left, out = set(order), []
    for a in order:
        if a not in left:
            continue
        left.discard(a)
        p, best, n = rows[a], rows[a][3], 0
        for b in order[order.index(a) + 1 :]:
            c = rows[b]
            if b not in left or c[0] != p[0]:
                continue
            inside = p[1] <= c[1] and p[2] >= c[2] and (p[1], p[2]) != (c[1], c[2])
            touching = (p[4] or c[4]) and (p[2] + 1 == c[1] or c[2] + 1 == p[1])
            if inside or touching:
                left.discard(b)
                best, n = max(best, c[3]), n + 1
        out.append((p[0], p[1], p[2], best, p[4], n))
    return sorted(out)


def test_merge_cases(spark):
    assert merged(spark, [("r", 1, 200, 0.3, "", "block"), ("r", 27, 80, 0.45, "", "block"), ("r", 29, 50, 0.5, "", "block")]) == [("r", 1, 200, 0.5, "", 2)]
    assert merged(spark, [("m", 61, 195, 0.4, "run", "function"), ("m", 196, 198, 0.3, "", "block")]) == [("m", 61, 195, 0.4, "run", 1)]
    assert len(merged(spark, [("x", 1, 50, 0.4, "", "block"), ("x", 51, 100, 0.3, "", "block")])) == 2
    assert len(merged(spark, [("x", 1, 100, 0.3, "Foo", "class"), ("x", 1, 100, 0.4, "Foo", "class")])) == 2
    assert len(merged(spark, [("a", 10, 30, 0.4, "", "b"), ("b", 10, 30, 0.3, "", "b")])) == 2
    assert search.merge_overlaps(hits(spark, [])).count() == 0


def test_merge_matches_loop(spark):
    rng = random.Random(3)
    rows = []
    for f in range(40):
        for _ in range(rng.randint(1, 14)):
            s = rng.randint(1, 40)
            rows.append((f"f{f}", s, s + rng.randint(0, 15), round(rng.random(), 3), rng.choice(["", "", "A"]), "block"))
    assert sorted(merged(spark, rows)) == loop(rows)


def test_group_orders(spark):
    rows = [("doc.md", 1, 5, 0.6, "", "b"), ("main.go", 100, 110, 0.4, "", "b"), ("main.go", 30, 40, 0.8, "", "b"), ("main.go", 200, 201, 0.1, "", "b")]
    g = search.group_by_file(search.merge_overlaps(hits(spark, rows))).collect()
    assert [(r.file_path, r.best_score) for r in g] == [("main.go", 0.8), ("doc.md", 0.6)]
    assert [m.start_line for m in g[0].matches] == [30, 100, 200]


def test_cosine_and_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [3.0, 4.0])], "doc_id bigint, embedding array<float>")
    for arrow in (False, True):
        got = search.top_k(df, [0.6, 0.8], 10, arrow=arrow).collect()
        assert [(r.doc_id, r.score) for r in got] == [(6, 1.0), (2, 0.8), (1, 0.6)]
    assert search.top_k(df, [1.0, 0.0], 0).count() == 3
    r = search.scored(df.where("doc_id = 4"), [1.0, 1.0]).first()
    assert math.isnan(r.score)


def test_batch_top_k_equals_single(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").repartition(5)
    q = df.where("doc_id % 100 = 0").selectExpr("doc_id as query_id", "embedding")
    got = {}
    for r in search.batch_top_k(df, q, 7, block=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    for qid in (0, 100, 200):
        want = [r.doc_id for r in search.top_k(df, list(df.where(f"doc_id = {qid}").first().embedding), 7).collect()]
        assert [d for _, d in sorted(got[qid])] == want


def test_batch_top_k_ties_by_least_id(spark):
    # one batch with far more equal vectors than 4 * k, the least ids last; and a nearer vector behind them
    rows = [(i, [1.0, 1.0]) for i in range(200, 0, -1)] + [(999, [1.0, 0.0]), (0, [0.0, 1.0])]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").coalesce(1)
    got = search.batch_top_k(df, q, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(999, 1.0), (1, 0.7071), (2, 0.7071)]
    named = df.selectExpr("lpad(doc_id, 4, '0') as doc_id", "embedding")
    assert [r.doc_id for r in search.batch_top_k(named, q, 3).orderBy("rank").collect()] == ["0999", "0001", "0002"]


@pytest.mark.parametrize("limit", [3, 10])
@pytest.mark.parametrize("langs", [(), ("go",), ("go", "py"), ("go", "py", "js", "rs", "ts")])
def test_adaptive_window_matches_loop(spark, limit, langs):
    rng = random.Random(limit)
    rows = [(i, f"f{rng.randint(0, 25)}", i * 10, i * 10 + 5, rng.choice(["go", "py", "js", "rs", "ts"]), [rng.random(), rng.random()]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, file_path string, start_line int, end_line int, language string, embedding array<float>")
    q = [1.0, 0.2]
    score = {r.doc_id: r.score for r in search.scored(df, q).collect()}
    ranked = sorted(rows, key=lambda r: (-score[r[0]], r[0]))

    def fetch(n):
        if not langs:
            return ranked[:n]
        if len(langs) == 1:
            return [r for r in ranked if r[4] == langs[0]][:n]
        if len(langs) <= 4:
            return [r for x in langs for r in [r for r in ranked if r[4] == x][:n]]
        return ranked[: n * len(langs)]

    for f in (2, 4, 8, 16):
        raw = fetch(limit * f)
        kept = [r for r in raw if score[r[0]] >= 0.5 and (len(langs) <= 4 or r[4] in langs)]
        if len({r[1] for r in kept}) >= limit or len(raw) < limit * f:
            break
    got = search.adaptive_window(df, q, limit, langs, min_score=0.5)
    assert {r.doc_id for r in got.collect()} == {r[0] for r in kept}


def test_filters(spark):
    paths = ["/proj/server/cmd/main.go", "/proj/bench/fixtures/sample.py", "/proj/legacy/scripts/p.py", "/proj/cli/main.go"]
    df = spark.createDataFrame([(p, s, "go") for p, s in zip(paths, (0.9, 0.85, 0.8, 0.7))] + [(None, 0.9, "go")], "file_path string, score double, language string")
    assert search.passing(df, 0.0, excludes=["/proj/bench", "/proj/legacy"]).count() == 2
    assert search.passing(df, 0.0, paths=["main.go"], excludes=["cli"]).count() == 1
    assert search.passing(df, 0.85).count() == 3
