import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.llm.frequent import frequent_items


def test_exact_totals_of_all_frequent_items(spark):
    rng = random.Random(2)
    rows = [(f"r{int(rng.paretovariate(0.7)) % 5000}", rng.choice([None, 1, 2, 9]), 7) for _ in range(20_000)] + [(None, 500, 1)] * 3
    df = spark.createDataFrame(rows, "read string, cnt long, total long").repartition(19)  # a clashing extra column
    totals = Counter()
    for read, cnt, _ in rows:
        totals[read] += 1 if cnt is None else cnt
    need = sum(totals.values()) / 100
    want = {k: v for k, v in totals.items() if k is not None and v >= need}
    for capacity in (None, 40):  # too few counters at first: the summary is made again
        got = frequent_items(df, "read", F.col("cnt"), 1 / 100, capacity).collect()
        assert {r["read"]: r["total"] for r in got} == want
        assert all(r["lower"] <= r["total"] <= r["upper"] for r in got)


def test_ties_long_items_and_empty_tables(spark):
    long = "A" * 200_000
    df = spark.createDataFrame([(long,), ("b",), ("b",), (long,), ("c",)], "read string")
    assert {r["read"]: r["total"] for r in frequent_items(df, "read", share=0.4).collect()} == {long: 2, "b": 2}
    assert frequent_items(df.limit(0), "read").collect() == []
    assert frequent_items(df.where("false").selectExpr("read", "1 as cnt"), "read", F.col("cnt")).collect() == []
    assert frequent_items(spark.createDataFrame([(None,)], "read string"), "read").collect() == []
