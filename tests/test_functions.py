import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import distance, encode
from strandloom.functions.distance import align, block_distances, distances, distances_within, edit_distance, exact_distance, pigeonhole_pass
from strandloom.operators.calibrate import ceiling_below_peak, safe_tau

WORD = st.text("ACGTNa", max_size=30)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORD, WORD), min_size=1, max_size=8))
def test_distances_are_exact(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert distances(left, right).tolist() == [lev(a, b) for a, b in pairs]
    for cutoff in (0, 2, 8):
        assert distances_within(left, right, cutoff).tolist() == [min(lev(a, b), cutoff + 1) for a, b in pairs]
    i, j, d = block_distances(left, right, 5, False)
    assert dict(zip(zip(i.tolist(), j.tolist()), d.tolist())) == {(x, y): v for x, a in enumerate(left) for y, b in enumerate(right) if (v := lev(a, b)) <= 5}


def test_whole_blocks_of_long_strings():
    rng = random.Random(4)
    for lengths in ((0, 1, 63), (60, 64, 65), (127, 128, 129), (300, 2)):
        left, right = (["".join(rng.choice("ACGTNx") for _ in range(rng.choice(lengths))) for _ in range(40)] for _ in range(2))
        i, j, d = block_distances(left, right, 1000, False)
        assert len(i) == 1600 and d.tolist() == distances([left[k] for k in i], [right[k] for k in j]).tolist()


@settings(max_examples=60, deadline=None)
@given(WORD, WORD)
def test_alignment_costs_the_distance_and_rebuilds(a, b):
    ops = align(a, b)
    assert sum(t != "EQ" for t, _, _ in ops) == lev(a, b)
    assert "".join(c for t, _, c in ops if t != "DEL") == b
    assert [p for t, p, _ in ops if t != "INS"] == list(range(len(a)))


def test_alignment_ties():
    assert [o for o in align("XAAAAY", "XAAAY") if o[0] != "EQ"] == [("DEL", 4, None)]
    assert [o for o in align("XAAAY", "XAAAAY") if o[0] != "EQ"] == [("INS", 1, "A")]


def test_long_strings():
    rng = random.Random(1)
    a = "".join(rng.choice("ACGT") for _ in range(3000))
    b = a[:1000] + "T" + a[1000:2000] + a[2001:]
    assert distances([a, "A"], [b, "C"]).tolist() == [2, 1]


def test_column_distances(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), ("AAAA", "TTTT"), (None, "A"), ("", "AC")], "a string, b string")
    rows = df.select(edit_distance("a", "b", 2).alias("x"), exact_distance("a", "b").alias("y"), pigeonhole_pass("a", "b", 1).alias("p")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, True), (3, 4, False), (None, None, None), (2, 2, True)]


def test_schedule_and_keys(spark):
    schedule = encode.anchor_schedule()
    assert schedule[:8] == [108, 219, 126, 197, 96, 63, 146, 201] and sorted(schedule) == list(range(256))
    reads = spark.createDataFrame([(0, "ACGTACGTAC"), (1, "ACG"), (2, ""), (3, "ACGTNacgtA")], "idx long, read string")
    keys = {(r.idx, r.it, r.pos): r.key for r in encode.anchor_keys(reads, 256, 4).collect()}
    it = schedule.index(27)  # ACGT
    fold = lambda s: sum(v * 5 ** (5 - k) for k, v in enumerate(s))
    assert keys[(0, it, 0)] == fold([0, 1, 2, 3, 0, 1]) and keys[(0, it, 4)] == fold([0, 1, 4, 4, 4, 4]) and keys[(3, it, 0)] == fold([255, 255, 255, 255, 255, 0])
    assert {k[0] for k in keys} == {0, 3}
    first = {(r.idx, r.it): r.pos for r in encode.anchor_keys(reads, 256, 1).collect()}
    assert first[(0, it)] == 0 and len(first) == len({(i, t) for i, t, _ in keys})


def test_signatures(spark):
    reads = spark.createDataFrame([(0, "TTT" + "A" * 30), (1, "AC")], "idx long, read string")
    row = encode.signatures(reads).collect()
    assert len(row) == 1 and row[0].s0 == np.array([(1 << 63) | (1 << 60) | (1 << 48) | 1], np.uint64).view(np.int64)[0] and row[0].s1 == 1 and row[0].s2 == 0
    pair = spark.createDataFrame([(1, None, 0, 0, 0, 0, 3, 0, 0, 0, 0, -1)], ", ".join(f"{p}{b} long" for p in "xy" for b in range(6)))
    assert pair.select(encode.hamming()).first()[0] == 1 + 64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=30))
def test_ceiling(counts):
    found = ceiling_below_peak(counts)
    if not any(counts[1:]):
        assert found.kind == 0
        return
    peak = max(range(1, len(counts)), key=lambda d: (counts[d], -d))
    run, expected = 0, None
    for d in range(peak - 1, 0, -1):
        if counts[d]:
            if run >= 2:
                expected = (1, d + run + 1)
                break
            run = 0
        else:
            run += 1
    assert (found.kind, found.ceiling) == (expected or (2, min(d for d in range(1, len(counts)) if counts[d])))


def test_safe_tau():
    assert safe_tau(1, 0.25, True) == 2 and safe_tau(1, 0.25, False) == 0 and safe_tau(22, 0.25, True) == 15


def test_base_rows(spark):
    df = spark.createDataFrame([(0, "AcT"), (1, None), (2, "")], "idx long, read string").withColumn("code", F.lit(9))
    assert sorted(map(tuple, encode.base_rows(df).collect())) == [(0, 0, 0), (0, 1, -1), (0, 2, 3)]


def test_parts_of_short_grams_lose_no_pair():
    from strandloom.functions import distance

    draw, texts = random.Random(7), []
    ends = "ATGATTCTTTAACGGCGA", "TTCAGTGGATATCAAT"
    roots = [ends[0] + "".join(draw.choice("ACGT") for _ in range(draw.randint(65, 85))) + ends[1] for _ in range(400)]
    for root in roots:
        text = list(root)
        for _ in range(draw.randint(6, 18)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(["A", "C", "G", "T", "N", ""])
        texts.append("".join(text))
    alphabet = distance._alphabet(texts, roots)
    a, b = distance.Texts(texts, alphabet), distance.Texts(roots, alphabet)
    q, telling = distance._telling(a, b, 16)
    assert q == 4 and telling.mean() > 0.5
    met = sum(len(i) for i, _ in distance._sharing_parts(a, np.flatnonzero(telling), b, 16, q, False))
    assert met < 2 * len(roots)  # common ends alone do not make a pair worth comparing
    for left, right in ((texts, roots), (roots, texts)):
        i, j, d = distance.block_distances(left, right, 16, False)
        every = distance.distances_within([x for x in left for _ in right], right * len(left), 16).reshape(len(left), -1)
        assert sorted(zip(i, j, d)) == [(x, y, every[x, y]) for x, y in np.argwhere(every <= 16)]


def test_blocks_with_themselves_lose_no_pair():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(18, 30))) for _ in range(700)]  # more than one tile, of all lengths
    i, j, d = block_distances(texts, texts, 13, True)
    a, b, e = block_distances(texts, texts, 13, False)
    assert (i < j).all() and len(i) > 500
    assert sorted(zip(i.tolist(), j.tolist(), d.tolist())) == sorted(x for x in zip(a.tolist(), b.tolist(), e.tolist()) if x[0] < x[1])


def test_middle_parts_lose_no_pair():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = []
    for length in [110] * 12 + [20, 60, 95, 130]:
        head = letters(length)
        other = list(head)
        for _ in range(rng.randrange(1, 30)):
            at, how = rng.randrange(len(other)), rng.randrange(3)
            other[at] = ["", rng.choice("ACGTN"), other[at] + rng.choice("ACGT")][how]
        gap = rng.randrange(22)
        texts += [head, "".join(other), letters(gap) + head, head[gap:], head + letters(gap), letters(8) + head[8:-8] + letters(8)]
    one, two = np.triu_indices(len(texts), 1)
    exact = distances([texts[i] for i in one], [texts[j] for j in two])
    alphabet = distance._alphabet(texts)
    assert distance._middles(*[distance.Texts(texts, alphabet)] * 2, 21)
    for limit in (5, 16, 21, 41):
        near = exact <= limit
        assert sorted(zip(one[near], two[near], exact[near])) == sorted(zip(*block_distances(texts, texts, limit, True)))


def test_signatures_of_odd_reads_are_made_in_pieces(monkeypatch):
    rng = random.Random(2)
    reads = ["".join(rng.choice("ACGTN") for _ in range(40)) for _ in range(50)]
    packed, whole, sizes = encode.PackedReads.of(reads), encode.Symbols(reads).words()[0].view(np.uint64).T, []
    monkeypatch.setattr(encode, "ODD_READS", 7, raising=False)
    made = encode.Symbols
    monkeypatch.setattr(encode, "Symbols", lambda texts: sizes.append(len(texts)) or made(texts))
    assert (packed.signatures() == whole).all() and max(sizes) <= 7
