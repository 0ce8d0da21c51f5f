from collections import Counter, defaultdict

import pytest

from strandloom.operators.skew import distinct_sizes, ordered_positions, size_mismatches


def test_heavy_key_is_split_and_stitched(spark):
    rows = [(1, i % 700) for i in range(3000)] + [(k, i) for k in range(2, 40) for i in range(k)] + [(None, 1), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "core_id long, member long").repartition(5)
    true = defaultdict(set)
    for k, m in rows:
        if k is not None and m is not None:
            true[k].add(m)
    assert {r[0]: r[1] for r in distinct_sizes(df, "core_id", "member", 7).collect()} == {k: len(v) for k, v in true.items()}
    placed = ordered_positions(df, "core_id", "member", 7).collect()
    by = defaultdict(list)
    for r in placed:
        by[r["core_id"]].append((r["position"], r["member"]))
    assert {k: len(v) for k, v in by.items()} == Counter(k for k, _ in rows if k is not None)
    for members in by.values():
        members.sort()
        assert [p for p, _ in members] == list(range(1, len(members) + 1))
        values = [-1 if m is None else m for _, m in members]
        assert values == sorted(values)


def test_mismatches(spark):
    recorded = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (1, "b", 1), (2, "a", 5), (3, "a", None), (4, None, 1), (None, "a", 3), (5, "a", 0)], "core_id long, run_id string, sizes int")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (2, 1), (4, 9), (None, 1), (7, 1)], "core_id long, member long").selectExpr("*", "1 as size", "2 as recorded")
    assert [tuple(r) for r in size_mismatches(recorded, members).collect()] == [(2, 5, 1)]
    assert size_mismatches(recorded.limit(0), members).collect() == []
    assert sorted(r[0] for r in size_mismatches(recorded, members.limit(0)).collect()) == [1, 2, 4]


def test_reserved_names(spark):
    with pytest.raises(ValueError):
        ordered_positions(spark.createDataFrame([(1, 2)], "k long, position long"), "k", "position")


def test_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert distinct_sizes(df, "k", "v").collect() == [] and ordered_positions(df, "k", "v").collect() == []
