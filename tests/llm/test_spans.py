import random

import pytest

from sparkloom.llm import spans


def brute(docs, k):
    by = {}
    for i, t in docs:
        if i is not None and t is not None:
            by.setdefault(i, []).append(t)
    owner, shared = {}, set()
    for i, ts in by.items():
        for t in ts:
            for j in range(len(t) - k + 1):
                if owner.setdefault(t[j : j + k], i) != i:
                    shared.add(t[j : j + k])
    out = set()
    for i, ts in by.items():
        cov = sorted({x for t in ts for j in range(len(t) - k + 1) if t[j : j + k] in shared for x in range(j, j + k)})
        start = None
        for x, nxt in zip(cov, [*cov[1:], None]):
            start = x if start is None else start
            if nxt != x + 1:
                out.add((i, start, x + 1))
                start = None
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_matches_brute_force(spark, hot):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha ", "beta ", "γάμμα ", "δ\n", "日本 ", "epsilon, ", "👍 "])
    pool = ["".join(word() for _ in range(rng.randint(4, 20))) for _ in range(12)]
    docs = []
    for i in range(120):
        docs.append((i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(0, 6)))))
    docs += [(200, docs[0][1] + "x"), (201, docs[3][1]), (202, docs[3][1]), (203, None), (204, ""), (205, "a" * 500), (206, "a" * 90), (207, "ab" * 100), (None, docs[1][1]), (5, docs[5][1]), (208, docs[8][1] * 40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, start_char string")
    got = {tuple(r) for r in spans.shared_spans(df, k=40, m=8, hot_rows=hot).collect()}
    assert got == brute(docs, 40)
    assert spans.shared_spans(df.limit(0), k=40, m=8).count() == 0


def test_default_length(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    shared = text(260)
    docs = [(1, text(300) + shared + text(50)), (2, shared + text(199)), (3, text(199)), (4, text(1000))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {tuple(r) for r in spans.shared_spans(df).collect()}
    assert got == brute(docs, 200)
    share = {r.doc_id: (r.shared_chars, r.n_chars) for r in spans.shared_share(df, spans.shared_spans(df)).collect()}
    assert share[2][0] >= 260 and share[3] == (0, 199)


def test_a_minimiser_that_one_text_repeats_is_hot(spark):
    import random

    rng = random.Random(5)
    period = "".join(rng.choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, period * 30 + "x" * 250), (2, period * 31 + "y" * 250), (3, "z" * 400)], "doc_id bigint, text string")
    want = {(1, 0, 9000), (2, 0, 9300)}
    for hot in (10, 100_000):
        assert {tuple(r) for r in spans.shared_spans(df, hot_rows=hot).collect()} == want
