import random

import pytest

from sparkloom.llm import mixing, tokens

TEXTS = [None, "", " ", "Hello world, it's 3.14!", "<|endoftext|> is text", "a\r\n\tb  c \u00a0d\u3000e\x00\x1c f", "日本語 émoji 👩‍👩‍👧 \ud7ff", "x" * 3000, " " * 500 + "y", "don't we'll I've", "\n\n\n", "e\u0301 \u200b \ufeff", "1234567890" * 50]


def reference(texts):
    import base64
    import os

    import tiktoken

    with open(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pat = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("t", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    return [enc.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_encode_and_decode(spark, block):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab '\n\té日1_-👍\u2003s") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    enc = tokens.encode(df, block_bytes=block)
    got = {r.doc_id: list(r.ids) for r in enc.collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    back = {r.doc_id: r.text for r in tokens.decode(enc).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert all(counts[i] == len(got[i]) for i in got)


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokens.encode(df).collect()) == [("1", [64]), ("1", [64]), ("None", [65])]
    assert tokens.encode(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, [99999999])], "doc_id bigint, ids array<int>")
    assert tokens.decode(bad).first().text is None


def test_water_fill():
    take = mixing.water_fill({"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 5})
    total = sum(take.values())
    assert abs(take["a"] / total - 0.5) < 1e-9 and abs(take["c"] / total - 0.2) < 1e-9 and max(take["a"] / 100, take["c"] / 50) == pytest.approx(1)
    take = mixing.water_fill({"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 5}, 600)
    assert take["a"] == 100 and take["c"] == 50 and take["b"] == pytest.approx(450)
    take = mixing.water_fill({"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 1000)
    assert take == {"a": 10.0, "b": 20.0}
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0} and mixing.water_fill({"a": 5}, {"a": 0.0}, {"a": 1}) == {"a": 0.0}


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big"] * 6 + ["mid", "mid", "small"]), rng.randint(0, 50)) for i in range(3000)] + [(5000, None, 9), (5001, "other", 9), (5002, "big", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 2), ("small", 0.25, 3), ("none", 0.0, 2), ("null", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    for buckets in (1, 16, 4096):
        m = mixing.mix(df, t, buckets=buckets)
        rows = m.collect()
        caps = {"big": 1, "mid": 2, "small": 3}
        assert rows and all(1 <= r.repeats <= caps[r.source] for r in rows)
        rep = {r.source: r for r in mixing.report(m, df, mixing.plan(df, t)).collect()}
        for s, w in (("big", 0.4), ("mid", 0.35), ("small", 0.25)):
            assert abs(rep[s].share - w) < 0.01
        assert rep["none"].tokens_used == 0 and rep["null"].tokens_used == 0
    again = {(r.doc_id, r.repeats) for r in mixing.mix(df, t).collect()}
    assert again == {(r.doc_id, r.repeats) for r in mixing.mix(df.repartition(7), t).collect()}
    assert mixing.mix(df.limit(0), t).count() == 0


def test_plan_is_the_fixed_point_of_the_rounds(spark):
    rng = random.Random(9)
    for _ in range(12):
        names = [f"s{i}" for i in range(rng.randint(1, 7))]
        tokens_of = {s: rng.choice([0, 10, 100, 1000, 5000]) for s in names}
        shares = {s: rng.choice([0.0, 0.1, 0.2, 0.3, 0.5]) for s in names}
        caps = {s: rng.choice([0, 1, 1, 2, 5]) for s in names}
        docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(tokens_of.items())], "doc_id bigint, source string, n_tokens bigint")
        targets = spark.createDataFrame([(s, shares[s], caps[s]) for s in names] + [("gone", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
        for total in (None, mixing.CORPUS, 50.0, 1e9):
            live = sum(tokens_of[s] for s in names if shares[s] > 0 and caps[s] > 0)
            want = mixing.water_fill(tokens_of, shares, caps, live if total == mixing.CORPUS else total)
            got = {r.source: r.goal for r in mixing.plan(docs, targets, total=total).collect()}
            assert got.pop("gone") == 0 and got == {s: pytest.approx(v) for s, v in want.items()}


def test_clamped_source_and_redistributed_shares(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 < 8 else "mid" if i % 10 < 9 else "small", 10) for i in range(5000)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.2, 4), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    goals = mixing.plan(docs, t, total=mixing.CORPUS)
    rep = {r.source: r for r in mixing.report(mixing.mix(docs, t, goals=goals), docs, goals).collect()}
    assert rep["small"].clamped and rep["small"].epochs == 2 and rep["small"].share == pytest.approx(0.2, abs=0.002)
    assert not rep["big"].clamped and rep["big"].share == pytest.approx(0.48, abs=0.002) and rep["mid"].share == pytest.approx(0.32, abs=0.002)
    assert rep["big"].share / rep["mid"].share == pytest.approx(1.5, abs=0.02)

