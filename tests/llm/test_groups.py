import random

from strandloom.llm.groups import link_groups


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def check(spark, links, bound):
    df = spark.createDataFrame(links, "a long, b long").selectExpr("*", "1 as node", "2 as group_id").repartition(6)
    assert {r.node: r.group_id for r in link_groups(df, bound=bound).collect()} == brute(links)


def test_chains_stars_and_bounded_partitions(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1600)]
    star = [(-5, k) for k in range(5000, 5400)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    dirty = [(None, 1), (2, None), (None, None), (8, 8), (9000, 9000), (7, 6), (6, 7), (6, 7)]
    links = chain + star + loose + dirty
    rng.shuffle(links)
    check(spark, links, 1_000_000)
    check(spark, links, 100)


def test_empty(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert link_groups(df).collect() == [] and link_groups(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
