"""The search by buckets in tasks against the joins that it replaces."""

import random

import numpy as np
import pytest

from strandloom.functions.distance import distances_within
from strandloom.functions.encode import PackedReads, Symbols
from strandloom.operators import absorb, calibrate, candidates
from strandloom.operators.candidates import bucket_pairs, sided_pairs, verified
from strandloom.functions.encode import signed_keys


def _texts(count: int) -> list[str]:
    draw = random.Random(5)
    roots = ["".join(draw.choice("ACGT") for _ in range(draw.randint(60, 120))) for _ in range(12)]
    made = {"", "A", "ACG", "N" * 40, "ACGT" * 200, "ACGT" * 200 + "T", "é" * 30 + roots[0], "acgt" * 9}
    while len(made) < count:
        text = list(draw.choice(roots))
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(["A", "C", "G", "T", "N", ""])
        made.add("".join(text))
    return sorted(made)


@pytest.fixture(scope="module")
def reads(spark):
    rows = spark.createDataFrame([*enumerate(_texts(300)), (10_000, None)], "idx long, read string").repartition(5)
    return rows.localCheckpoint()


def _same(found, expected, some=True):
    one, two = ({tuple(r) for r in df.select("a", "b", "d").collect()} for df in (found, expected))
    assert one == two and (two or not some)


@pytest.mark.parametrize("cap", [4096, 12])
def test_core_edges_without_joins(reads, cap):
    found = candidates.core_edges(reads, cap=cap)
    assert "Join" not in found._jdf.queryExecution().toString()
    _same(found, verified(bucket_pairs(signed_keys(reads, 64, 4), cap, 60), reads, reads, 8))


@pytest.mark.parametrize(("limit", "cap"), [(54, 4096), (20, 30), (0, 4096)])
def test_filtered_pairs_without_joins(reads, limit, cap):
    found = calibrate.filtered_pairs(reads, limit, cap=cap)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.count() == found.distinct().count()
    _same(found, verified(bucket_pairs(signed_keys(reads, 96, 1), cap, 96), reads, reads, limit), limit > 0)


@pytest.mark.parametrize("gather", [True, False])
def test_sides(reads, gather):
    left, right = reads.where("idx % 3 > 0"), reads.where("idx % 3 = 0")
    found = candidates.near_pairs(left, right, 16, 96, 96, 4, 300, gather)
    _same(found, verified(sided_pairs(signed_keys(left, 96, 4), signed_keys(right, 96, 4), 300, 96), left, right, 16))
    assert "Join" not in absorb.absorb_filtered(left, right, 16)._jdf.queryExecution().toString()


def test_near_pairs_of_nothing(reads):
    none = reads.limit(0)
    assert candidates.core_edges(none).count() == calibrate.filtered_pairs(none, 4).count() == absorb.absorb_filtered(none, reads, 16).count() == absorb.absorb_filtered(reads, none, 16).count() == 0


def test_packed_reads():
    texts = _texts(200)
    every = np.arange(len(texts))
    lengths, grid, odd = PackedReads.of(texts).pick(every)
    packed = PackedReads.joined([lengths.tobytes()] * 2, [grid] * 2, [odd] * 2)
    assert packed.texts(every + len(texts)) == texts
    assert (packed.signatures()[:, : len(texts)] == Symbols(texts).words()[0].view(np.uint64).T).all()
    a, b = (np.random.default_rng(k).integers(0, len(texts), 2000) for k in (1, 2))
    for limit in (0, 8, 54):
        expected = distances_within([texts[k] for k in a], [texts[k] for k in b], limit)
        assert (np.minimum(packed.distances(a, b, limit), limit + 1) == expected).all()
