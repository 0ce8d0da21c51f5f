import os
import random

import numpy as np
import pytest

from strandloom.llm.mixture import RUN, TOKENIZER, _encoding, apportion, count_tokens, highest_quotients, reached, select_blocks, shares, token_counts


def divisors(weights, caps, seats):
    quota = dict.fromkeys(weights, 0)
    for _ in range(seats):
        free = [k for k in weights if quota[k] < caps[k] and weights[k] > 0]
        if not free:
            break
        best = max(free, key=lambda k: (weights[k] / (2 * quota[k] + 1), [-ord(c) for c in k]))
        quota[best] += 1
    return quota


def test_highest_quotients(spark):
    weights, caps = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0.0}, {"a": 20, "b": 3, "c": 100, "d": 0, "e": 9}
    df = spark.createDataFrame([(k, weights[k], caps[k], 25, 1) for k in weights], "source string, weight double, cap long, seats long, whole int")
    assert {r["source"]: r["quota"] for r in apportion(df, ["source"], ["whole"], "seats").collect()} == divisors(weights, caps, 25)


def test_highest_quotients_by_bisection():
    rng = random.Random(3)
    for _ in range(200):
        names = [f"s{k:02}" for k in range(rng.randrange(0, 9))]
        weights = {k: rng.choice([0.0, 1.0, 2.0, 3.0, rng.random(), rng.random() * 1000]) for k in names}
        caps, seats = {k: rng.choice([0, 1, 5, 40, 10**9]) for k in names}, rng.choice([0, 1, 7, 60])
        got = highest_quotients(np.array([weights[k] for k in names]), np.array([caps[k] for k in names], np.int64), seats)
        assert dict(zip(names, got.tolist())) == divisors(weights, caps, seats)
    many = highest_quotients(np.array([0.5, 0.3, 0.2]), np.array([10**12, 10**8, 10**12]), 10**9)
    assert many.sum() == 10**9 and many[1] == 10**8 and abs(many[0] / many[2] - 2.5) < 1e-6


def test_shards_smaller_than_a_block_still_fill_the_quota(spark):
    counted = spark.createDataFrame([(i, "big" if i % 4 else "small", 10) for i in range(4000)], "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    plan = shares(counted.select("source", "tokens"), goals, blocks=100)
    quota = {r["source"]: r["quota"] * r["block"] for r in plan.collect()}
    used = {r["source"]: r["t"] for r in select_blocks(counted, plan, shard_rows=10).selectExpr("source", "tokens * times as t").groupBy("source").sum("t").withColumnRenamed("sum(t)", "t").collect()}
    assert set(used) == {"big", "small"} and all(abs(used[k] - quota[k]) <= 0.03 * quota[k] for k in quota)


def test_shares_and_selection(spark):
    rows = [(i, "big", 100) for i in range(600)] + [(1000 + i, "small", 50) for i in range(40)] + [(2000 + i, "other", 10) for i in range(100)] + [(3000, None, 5), (3001, "big", 0)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 2), ("gone", 0.1, 3), ("late", 0.1, None), ("big", 0.6, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = shares(counted.select("source", "tokens"), goals, blocks=500)
    by = {r["source"]: r for r in plan.collect()}
    total = sum(t for _, _, t in rows)
    assert {k: v["short"] for k, v in by.items()} == {"big": False, "small": True, "gone": True, "late": True}
    assert by["small"]["capacity"] == 4000 and by["gone"]["tokens"] == 0 and by["big"]["total"] == total 
    chosen = select_blocks(counted, plan, shard_rows=50).collect()
    used = {}
    for r in chosen:
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"] * r["times"]
    assert set(used) == {"big", "small"} and all(r["times"] <= {"big": 1, "small": 2}[r["source"]] for r in chosen)
    block = by["big"]["block"]
    assert abs(used["big"] - by["big"]["quota"] * block) <= 0.03 * used["big"] and abs(used["small"] - by["small"]["quota"] * block) <= 0.05 * used["small"]
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, select_blocks(counted, plan, shard_rows=50).collect()))
    shared = {r["source"]: r for r in reached(plan, select_blocks(counted, plan, shard_rows=50)).collect()}
    assert {k: r["used"] for k, r in shared.items()} == {**used, "gone": 0, "late": 0} and abs(sum(r["share"] for r in shared.values()) - 1) < 1e-9
    assert used["small"] == 4000  # all it has, as often as it may be used
    empty = shares(counted.limit(0).select("source", "tokens"), goals)
    assert empty.where("quota > 0 or short").collect() == [] and {r["share"] for r in reached(empty, select_blocks(counted.limit(0), empty)).collect()} == {0.0}
    assert shares(counted.select("source", "tokens"), goals.limit(0)).collect() == [] and select_blocks(counted.limit(0), plan).collect() == []


def test_a_source_smaller_than_a_block_gets_its_tokens(spark):
    rows = [(i, "big", 1000) for i in range(9999)] + [(10_000 + i, "tiny", 90) for i in range(10)] + [(20_000, "grain", 1)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("big", 0.9998, 1), ("tiny", 0.0001, 1), ("grain", 0.0001, 1)], "source string, target_share double, max_repeats int")
    plan = shares(counted.select("source", "tokens"), goals)
    got = {r["source"]: r for r in reached(plan, select_blocks(counted, plan)).collect()}
    assert got["tiny"]["used"] == 900 and got["grain"]["used"] == 1 and got["big"]["used"] > 0.99 * 9_999_000
    assert {k for k, r in got.items() if r["short"]} == {"tiny", "grain"} == {k for k, r in got.items() if r["capacity"] < r["target_share"] * r["total"]} - {"big"}


def test_short_sources_are_those_that_quotas_exhaust(spark):
    rng = random.Random(9)
    for _ in range(6):
        names = [f"s{k}" for k in range(rng.randrange(2, 9))]
        share = [rng.random() for _ in names]
        rows = [(k, n, rng.randrange(1, 3000)) for k, n in enumerate(rng.choices(names, k=200))]
        counted = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
        goals = spark.createDataFrame([(n, s / sum(share), rng.choice([1, 2, 4])) for n, s in zip(names, share)], "source string, target_share double, max_repeats int")
        for r in shares(counted.select("source", "tokens"), goals, blocks=rng.choice([50, 10_000])).collect():
            assert r["short"] == (r["capacity"] < r["target_share"] * r["total"]) and (r["exhausted"] or not r["short"])


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_long_texts_count_as_uncut_ones():
    encoding = _encoding(TOKENIZER)
    text = "It's 12 words, isn't it?\n" * 40_000
    assert count_tokens(encoding, text) == len(encoding.encode_ordinary(text))
    for space in (" " * (RUN + 5), "\n" * RUN, " " * (RUN - 1) + "\n"):
        for text in (space, f"ab{space}cd", f"{space}, x{space}", f"a{space}9{space}b c"):
            assert count_tokens(encoding, text) == len(encoding.encode_ordinary(text))


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "y"), (4, "ab " * 200_000, None)], "doc_id long, text string, source string")
    counts = {r["doc_id"]: r["tokens"] for r in token_counts(df, keep=["doc_id", "source"]).collect()}
    assert counts[1] == 2 and counts[2] == 0 and counts[3] == 0 and counts[4] >= 200_000
