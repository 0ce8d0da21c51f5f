import base64
import quopri
import random

import numpy as np

from strandloom.llm import leak
from strandloom.llm.mail import decoded, words

VOCABULARY = [f"w{k}" for k in range(40)]


def brute(docs, items, depth):
    found = set()
    for item, passage in items:
        own = words(passage or "")
        grams = {tuple(own[k : k + depth]) for k in range(len(own) - depth + 1)}
        for doc, text in docs:
            if doc is not None and text is not None:
                ws = words(decoded(text))
                if any(tuple(ws[k : k + depth]) in grams for k in range(len(ws) - depth + 1)):
                    found.add((doc, item))
    return found


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leak, "SHARD_WORDS", 700)
    rng = random.Random(3)
    passage = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(k, passage(rng.randrange(3, 25))) for k in range(20)] + [(20, None), (21, ""), (5, None)]
    items.append((22, items[0][1]))
    docs = []
    for k in range(120):
        held = rng.choice(items)[1] or ""
        ws = held.split()
        cut = ws[rng.randrange(3) :][: rng.randrange(8, 25)]
        docs.append((k, f"{passage(30)} {', '.join(cut).upper()}\r\n> {passage(5)} unknown {' '.join(cut)}"))
    docs += [(500, None), (501, ""), (None, items[1][1]), (502, "x " * 60_000 + items[3][1] + " y"), (502, "x " * 60_000 + items[3][1] + " y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'z' as passage")
    tests = spark.createDataFrame(items, "item_id long, passage string")
    want = brute(docs, items, 10)
    assert {tuple(r) for r in leak.leaked_pairs(frame, tests, 10).collect()} == want and want
    monkeypatch.setattr(leak, "MOST_WORDS", 60)
    assert {tuple(r) for r in leak.leaked_pairs(frame, tests, 10).collect()} == want
    clean = {r.doc_id for r in leak.without_leaks(frame, tests, 10).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_longest_match_and_places(spark):
    passage = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"zero {passage} nine; again ONE-two three four five six!")], "doc_id long, text string")
    rows = leak.leak_places(docs, spark.createDataFrame([(7, passage)], "item_id long, passage string"), 5).collect()
    assert sorted(map(tuple, rows)) == [(1, 7, 6, 11, 0), (1, 7, 8, 1, 0)]


def test_suffixes_are_sorted_to_full_depth():
    rng = random.Random(12)
    for words_known, n in ((1, 40), (2, 200), (3, 2000), (900, 500)):
        ids = np.array([rng.randrange(words_known + 1) for _ in range(n)] + [1] * 30 + [0], np.int32)
        until = lambda at: tuple(ids[at : at + int(np.flatnonzero(ids[at:] == 0)[0])])
        left = leak.to_next_zero(ids)
        found = leak.suffix_array(ids, left, words_known.bit_length())
        assert sorted(found.tolist()) == np.flatnonzero(ids).tolist()
        assert (texts := [until(at) for at in found]) == sorted(texts)


def test_many_items_take_one_pass(spark):
    rng = random.Random(13)
    items = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(15))) for k in range(50_000)]
    docs = spark.createDataFrame([(k, "start " + items[k * 7][1] + " end") for k in range(300)], "doc_id long, text string")
    pairs = leak.leaked_pairs(docs, spark.createDataFrame(items, "item_id long, passage string"))
    assert str(pairs._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    assert sorted(map(tuple, pairs.collect())) == [(k, k * 7) for k in range(300)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert leak.leaked_pairs(docs, items).collect() == []
    assert leak.leaked_pairs(docs, spark.createDataFrame([(1, "a b c")], "item_id long, passage string"), 2).collect() == []


def test_decoding():
    body = "Grüße aus dem Garten, siebzehn Wörter"
    b64 = base64.encodebytes(body.encode()).decode()
    head = "Subject: x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: BASE64\n\n"
    assert body in decoded(head + b64) and "Gr" in decoded(head + b64[: len(b64) // 2])
    qp = quopri.encodestring(body.encode("iso-8859-1")).decode()
    part = f"Content-Type: text/plain;\n charset=\"iso-8859-1\"\nContent-Transfer-Encoding: quoted-printable\n\n{qp}\n"
    assert body in decoded(f"A: b\r\nContent-Type: multipart/mixed;\r\n boundary=\"q=_1\"\r\n\r\n--q=_1\n{part}--q=_1\n{head}{b64}\n--q=_1--\n").replace("\r", "")
    assert decoded(f"Content-Type: multipart/mixed; boundary=x\nA: base64\n\nno parts {qp}").endswith(qp)
    assert "payload" in decoded("Content-Type: image/png\nContent-Transfer-Encoding: base64\n\npayload")
    assert decoded("base64 only") == "base64 only" and decoded("") == ""
    assert body in decoded(head.replace("utf-8", "no-such-charset") + b64)
    assert words("İstanbul x_y É1-ß") == ["i̇stanbul", "x", "y", "é1", "ß"]
