import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import near
from strandloom.llm.hashing import pack_texts, unpack_texts
from strandloom.llm.near import BINS_BITS, SHORT, _emit, _packed, bins_for, grams, hot_bins, large_signatures, near_pairs, part_enum, text_classes


def lev(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def brute(rows, most=8):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None):
        first.setdefault(t, i)
    known = sorted((i, t) for t, i in first.items())
    return {(i, j): d for k, (i, a) in enumerate(known) for j, b in known[k + 1 :] if (d := lev(a, b, most)) <= most}


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s))
        s[at : at + 1] = [[], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]][rng.randrange(3)]
    return "".join(s)


def found(df, **options):
    return {(r["a"], r["b"]): r["d"] for r in near_pairs(df, "read_id", "read", **options).collect()}


def test_reads_of_one_length_band_and_across_bands(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        origin = "".join(rng.choice("ACGT") for _ in range(rng.choice([70, 92, 96, 110, 142, 150])))
        rows += [(5 * k + m, edited(rng, origin, rng.randrange(6))) for m in range(5)]
    df = spark.createDataFrame(rows, "read_id long, read string").selectExpr("*", "1 as id", "'x' as text")
    want, got = brute(rows), found(df)
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.99 * len(want) > 100


def test_short_empty_null_and_equal_texts(spark):
    rows = [(1, ""), (2, "ACGT"), (3, "ACGTACGTAC"), (4, "ACGT"), (5, None), (None, "ACGT"), (6, "x" * SHORT), (7, "x" * (SHORT - 4)), (8, "y" * 30), (2, "ACGT"), (9, "a" * 40), (10, "A" * 40), (11, "ab" * 20)]
    df = spark.createDataFrame(rows, "read_id long, read string")
    assert found(df) == brute(rows)
    assert {tuple(r) for r in text_classes(df, "read_id", "read").where("id in (2, 4)").collect()} == {(2, 2), (4, 2)}
    assert found(df.limit(0)) == {}


def test_short_texts_lose_no_pair(spark):
    rng = random.Random(21)
    rows = []
    for k in range(40):
        origin = "".join(rng.choice("ACGT") for _ in range(rng.choice([7, 9, 12, 25, 40, 58, 63, 64, 66])))
        rows += [(4 * k + m, edited(rng, origin, rng.choice([0, 3, 8, 9]))) for m in range(4)]
    want = brute(rows)
    got = found(spark.createDataFrame(rows, "read_id long, read string"))
    texts = dict(rows)
    short = {p: d for p, d in want.items() if min(len(texts[p[0]]), len(texts[p[1]])) < SHORT}
    assert set(got.items()) <= set(want.items()) and set(short.items()) <= set(got.items()) and len(short) > 100


def test_long_texts(spark):
    rng = random.Random(5)
    words = [f"wörd{k}" for k in range(500)]
    a = " ".join(rng.choice(words) for _ in range(2000))
    b = a[:3000] + "XY" + a[3000:9000] + a[9003:]
    rows = [(1, a), (2, b), (3, a.upper()), (4, a[:5000] + "?" * 9 + a[5000:])]
    assert found(spark.createDataFrame(rows, "read_id long, read string")) == {(1, 2): 5}


def test_family_that_holds_most_texts(spark):
    rng = random.Random(8)
    origin = "".join(rng.choice("ACGT") for _ in range(110))
    family = {edited(rng, origin, 2) for _ in range(80)}
    rows = list(enumerate(sorted(family))) + [(1000 + k, "".join(rng.choice("ACGT") for _ in range(110))) for k in range(60)]
    want, got = brute(rows), found(spark.createDataFrame(rows, "read_id long, read string"), hot_share=0.1, hot_least=1)
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.99 * len(want)


def replaced(rng, s, edits):
    s = list(s)
    for at in rng.sample(range(len(s)), edits):
        s[at] = rng.choice([c for c in "ACGT" if c != s[at]])
    return "".join(s)


def test_eight_edits_in_64_to_95_letters_lose_no_pair(spark):
    rng = random.Random(31)
    rows = []
    for k in range(100):
        origin = "".join(rng.choice("ACGT") for _ in range(64 + k % 32))
        rows += [(2 * k, origin), (2 * k + 1, replaced(rng, origin, 8))]
    got = found(spark.createDataFrame(rows, "read_id long, read string"))
    assert len(got) >= 100 and got == brute(rows)


def test_texts_with_a_large_hot_part_share_signatures():
    rng = random.Random(32)
    for hot_letters, length, most in ((0, 96, 4), (0, 110, 2), (40, 110, 5), (50, 110, 8)):
        head = "".join(rng.choice("ACGT") for _ in range(hot_letters))
        hot = np.zeros(1 << BINS_BITS, bool)
        hot[(grams([head], 8)[0] >> np.uint64(64 - BINS_BITS)).astype(np.int64)] = True
        texts = [head + "".join(rng.choice("ACGT") for _ in range(length - hot_letters)) for _ in range(500)]
        sigs, text, _ = part_enum(texts + [replaced(rng, t, 8) for t in texts], hot, 8, 8)
        own = [set() for _ in range(1000)]
        for s, t in zip(sigs.tolist(), text.tolist()):
            own[t].add(s)
        assert sum(own[i].isdisjoint(own[500 + i]) for i in range(500)) <= most, (hot_letters, length)


def mixed(rng, s, edits):
    """Exactly ``edits`` operations at different places: replaced, deleted or inserted letters."""
    s, kinds = list(s), [rng.choice("rdi") for _ in range(edits)]
    for at, kind in zip(sorted(rng.sample(range(len(s)), edits), reverse=True), kinds):
        s[at : at + 1] = {"r": [rng.choice([c for c in "ACGT" if c != s[at]])], "d": [], "i": [rng.choice("ACGT"), s[at]]}[kind]
    return "".join(s)


@pytest.mark.parametrize("change", [replaced, mixed])
def test_pairs_of_exactly_eight_edits_at_every_length(spark, change):
    rng, rows, lengths = random.Random(51), [], {}
    for length in (64, 72, 80, 84, 96, 110, 150):
        for _ in range(200):
            origin, k = "".join(rng.choice("ACGT") for _ in range(length)), len(rows)
            rows += [(k, origin), (k + 1, change(rng, origin, 8))]
            lengths[k] = length
    got = found(spark.createDataFrame(rows, "read_id long, read string"))
    for length in sorted(set(lengths.values())):
        own = [k for k, n in lengths.items() if n == length]
        recall = sum((k, k + 1) in got for k in own) / len(own)
        print(change.__name__, length, recall)
        assert recall >= 0.99, (length, recall)


def test_corpus_of_long_texts_keeps_its_pairs(spark):
    assert bins_for(110) == BINS_BITS < bins_for(3000)
    rng = random.Random(52)
    rows = [(k, "".join(rng.choice("ACGT") for _ in range(3000))) for k in range(300)]
    rows += [(1000 + k, mixed(rng, t, 8)) for k, t in rows[:100]]
    got = found(spark.createDataFrame(rows, "read_id long, read string"), hot_least=1)
    assert {p for p in got if p[0] < 100} == {(k, 1000 + k) for k in range(100)} == set(got)


def test_texts_are_packed_without_loss():
    rng = random.Random(53)
    texts = ["", "A", "ACG", "ACGT", "n", "é", "\0", "x" * 1000, "ACGTN"] + ["".join(rng.choice("ACGT") for _ in range(rng.randrange(140))) for _ in range(500)]
    column = pa.array(texts)
    assert unpack_texts(pack_texts(column)).to_pylist() == texts
    assert unpack_texts(pack_texts(column.slice(3, 50))).to_pylist() == texts[3:53]
    assert len(unpack_texts(pack_texts(column.slice(0, 0)))) == 0 and len(set(pack_texts(column).to_pylist())) == len(set(texts))


def test_large_signatures_are_cut_into_slices(spark):
    rng = random.Random(41)
    origin = "".join(rng.choice("ACGT") for _ in range(110))
    family = sorted({edited(rng, origin, 4) for _ in range(300)})
    df = spark.createDataFrame(list(enumerate(family)), "read_id long, read string")
    options = {"hot_share": 0.1, "hot_least": 1}
    whole, cut = found(df, size=1000, **options), found(df, size=20, **options)
    assert whole == cut and len(cut) > 1000
    texts = df.selectExpr("read_id as id", "read as text", "length(read) as n").mapInArrow(_packed, "id long, text binary, n int")
    hot = hot_bins(texts, 8, 0.1 * len(family), BINS_BITS, len(family))
    large = large_signatures(texts, hot, 8, 8, 1, len(family), size=20)
    rows = _emit(texts, hot, 8, 8, 1, large).selectExpr("bucket", "length(ids) div 8 as n").groupBy("bucket").sum("n").collect()
    sliced = [r[1] for r in rows if r[0] > 0]
    assert max(large.slices) > 5 and len(sliced) > 15 and max(sliced) <= 80


def test_only_grams_that_share_a_group_are_sorted(monkeypatch):
    draw = random.Random(21)
    lengths = [*[110] * 300, *[400] * 20, 96, 150, 96]
    texts, hot = ["".join(draw.choice("ACGT") for _ in range(n)) for n in lengths], np.zeros(1 << near.BINS_BITS, bool)
    hashed, owner, place = near.grams(texts, 8)
    for groups in (np.full(len(texts), 384), np.array([near.GROUPS * n for n in lengths])):
        sizes, sort = [], np.sort
        monkeypatch.setattr(near.np, "sort", lambda x: sizes.append(len(x)) or sort(x))
        near._projections(hashed[:20_000], owner[:20_000], place[:20_000], groups, 3)
        assert sizes and max(sizes) < 20_000 / 2  # most grams are alone in their group
        monkeypatch.setattr(near.np, "sort", sort)
    counted = near.part_enum(texts, hot, 8, 8)
    monkeypatch.setattr(near, "DENSE_GROUPS", 0)
    for one, other in zip(counted, near.part_enum(texts, hot, 8, 8)):
        assert len(one) > 10_000 and (one == other).all()
    everything_hot = near.part_enum(["A" * 100, "ACGT" * 30], ~hot, 8, 8)
    assert len({len(part) for part in everything_hot}) == 1


def test_bucket_pairs_of_entries_that_meet_and_of_none():
    draw = np.random.default_rng(22)
    low = near.PLACE_BITS + near.SPAN_BITS
    codes, ids = (draw.integers(0, 400, 2000) << low | draw.integers(0, 4, 2000) << near.SPAN_BITS).astype(np.uint32), draw.integers(0, 500, 2000)
    expected = {(min(x, y), max(x, y)) for i, x in enumerate(ids.tolist()) for j, y in enumerate(ids[:i].tolist()) if x != y and codes[i] >> low == codes[j] >> low}
    assert set(zip(*(side.tolist() for side in near.bucket_pairs(codes, ids, 8)))) == expected
    for few in (0, 1, 50):
        a, b = near.bucket_pairs((np.arange(few) << low).astype(np.uint32), ids[:few], 8)
        assert len(a) == len(b) == 0
