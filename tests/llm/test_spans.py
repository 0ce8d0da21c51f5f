import random

import numpy as np

from strandloom.llm.spans import Slice, shared_spans, sharing_texts, window_for


def brute(rows, least):
    where = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            for k in range(len(text) - least + 1):
                where.setdefault(text[k : k + least], set()).add(doc)
    cover = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            for k in range(len(text) - least + 1):
                if len(where[text[k : k + least]]) > 1:
                    cover.setdefault(doc, set()).update(range(k, k + least))
    return cover


def words(rng, n):
    return "".join(rng.choice("abcdefgh ij\nkléü") for _ in range(n))


def rows_with_spans(least, seed):
    rng = random.Random(seed)
    shared = [words(rng, least + extra) for extra in (-2, -1, 0, 1, 2, 40, 200, 900)]
    rows = []
    for k in range(160):
        parts = [words(rng, rng.randrange(10, 400))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), words(rng, rng.randrange(0, 60))]
        rows.append((k, "".join(parts)))
    disclaimer = words(rng, least - 20)
    rows += [(300 + k, words(rng, 100) + disclaimer + words(rng, 100)) for k in range(30)]
    rows += [(400, None), (None, rows[0][1]), (401, ""), (402, "z" * 5000), (403, "z" * (least + 1)), (404, words(rng, 50) + "z" * (least - 1)), (405, rows[1][1]), (406, "𝒳" * 20 + shared[3])]
    return rows


def test_spans_to_the_letter(spark):
    for least, seed in ((300, 1), (120, 2), (40, 3)):
        rows = rows_with_spans(least, seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as doc").repartition(5)
        cover = brute(rows, least)
        assert {r[0] for r in sharing_texts(df, "doc_id", "text", least).collect()} == set(cover)
        got = {}
        for r in shared_spans(df, "doc_id", "text", least).collect():
            got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
        assert got == cover


def test_same_id_is_one_text(spark):
    text = words(random.Random(4), 700)
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert sharing_texts(df, "doc_id", "text").collect() == [] and sharing_texts(df.limit(0), "doc_id", "text").collect() == []


def test_cuts_follow_content():
    rng = random.Random(6)
    shared = words(rng, 500)
    pieces = Slice([words(rng, 90) + shared, words(rng, 33) + shared + words(rng, 10)])
    text, cut = pieces.cuts(window_for(300))
    offsets = [set((cut[text == k] - pieces.starts[k] - lead).tolist()) for k, lead in ((0, 90), (1, 33))]
    inside = lambda s: {c for c in s if 79 <= c < 430}
    assert inside(offsets[0]) == inside(offsets[1]) and len(inside(offsets[0])) >= 5
    assert (np.diff(np.sort(cut[text == 0])) <= 64).all()
