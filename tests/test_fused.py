"""The fused search of pairs against the distances of single pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strandloom import queries_reads
from strandloom.functions.distance import distances
from strandloom.functions.fused import met_pairs
from strandloom.operators import absorb, calibrate
from strandloom.session import cut_lineage


def mutated(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = [rng.choice("ACGTNé😀")] * rng.randrange(2)
    return "".join(out)


def families(rng, count):
    """Texts of several lengths, some with common ends, the empty one too."""
    origins = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (3, 30, 64, 110, 110, 140)]
    origins.append(origins[3][:40] + origins[4][40:])
    return [mutated(rng, rng.choice(origins), rng.randrange(30)) for _ in range(count)] + ["", "A"]


@pytest.mark.parametrize("limit, keep", [(0, 0), (16, 16), (20, 7), (55, 0)])
@pytest.mark.parametrize("halves", [True, False])
def test_met_pairs_are_all_pairs(spark, limit, keep, halves):
    rng = random.Random(limit)
    left, right = families(rng, 300), families(rng, 259)  # more than one tile, the last one partly filled
    rows = [(k, t, 0, 0, 0) for k, t in enumerate(left)] + [(1000 + k, t, 1, 0, 0) for k, t in enumerate(right) if not halves]
    made = met_pairs(spark.createDataFrame(rows, "idx int, read string, side int, p int, q int"), limit, keep, halves).collect()
    i, j = np.triu_indices(len(left), 1) if halves else (c.ravel() for c in np.indices((len(left), len(right))))
    d = distances([left[k] for k in i], [(left if halves else right)[k] for k in j])
    near, far = d <= keep, np.bincount(d[(d > keep) & (d <= limit)], minlength=limit + 1)
    assert sorted((r.a, r.b, r.d) for r in made if r.a is not None) == sorted(zip(i[near].tolist(), (j[near] + (0 if halves else 1000)).tolist(), d[near].tolist()))
    assert {r.d: r.n for r in made if r.a is None} == {k: n for k, n in enumerate(far.tolist()) if n}


def test_strings_without_text_are_near_none(spark):
    strings = spark.createDataFrame([(0, "ACGT"), (1, None), (2, "ACGA"), (3, "")], "idx long, read string")
    assert sorted(map(tuple, calibrate.all_pairs(strings, 4).collect())) == [(0, 2, 1, 1), (0, 3, 4, 1), (2, 3, 4, 1)]
    assert sorted(map(tuple, absorb.near_strings(strings.where("idx = 2"), strings, 1).collect())) == [(2, 0, 1), (2, 2, 0)]
    assert calibrate.all_pairs(strings.where("idx > 5"), 4).count() == 0


def test_c_post_searches_only_as_far_as_needed(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(110))
    for apart, asked in ((21, [21]), (30, [21, 41]), (60, [21, 41])):
        other = "N" * apart + base[apart:]
        strings = cut_lineage(spark.createDataFrame([(0, base), (1, base[:-1] + "R"), (2, other)], "idx long, read string"))
        limits, every = [], queries_reads._every_pair
        monkeypatch.setattr(queries_reads, "_heads", lambda *_: (strings, None, strings))
        monkeypatch.setattr(queries_reads, "_every_pair", lambda s, limit: limits.append(limit) or every(s, limit))
        found = queries_reads.QUERIES["c_post"](spark, "").first()
        monkeypatch.undo()
        edges = calibrate.all_pairs(strings, 41)
        assert limits == asked and found == absorb.closest_apart(absorb.merge_components(strings, edges, 20), edges, 41).first()
