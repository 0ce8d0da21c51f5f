import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import absorb, calibrate, candidates, components, consensus
from strandloom import queries_reads
from strandloom.functions import distance, encode
from strandloom.plans import pipeline
from strandloom.session import cut_lineage
from strandloom.sources.reads import index_reads, parse_lines, number_lines, read_text, unique_reads

SMOKE = ["AAAACCCCGGGGTTTT\t3", "AAAACCCCGGGGTTTA\t2", "TTTTGGGGCCCCAAAA\t5", "TTTTGGGGCCCCAAAT\t1", "GATTACAGATTACAGA\t4"]


def lines_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "at long, value string")
    return cut_lineage(number_lines(parse_lines(df), "at"))


def test_line_edge_cases(spark):
    texts = ["ACGT\t0", "ACGT\t-3\r\n", "", None, "\r\n", "ACGT\tabc", "ACGT\t3abc", "ACGT\t3\t9", "\t5", "ACGT\t 7", "ACGT\t99999999999"]
    rows = [(r.line_no, r.read, r.cnt) for r in lines_of(spark, texts).orderBy("line_no").collect()]
    assert rows == [(1, "ACGT", 1), (2, "ACGT", 1), (3, "ACGT", 1), (4, "ACGT", 3), (5, "ACGT", 3), (6, "", 5), (7, "ACGT", 7), (8, "ACGT", 1)]


def test_smoke(spark):
    lines = lines_of(spark, SMOKE)
    unique = unique_reads(lines)
    result = pipeline.cluster(unique, pipeline.Options(audit_sample=3, stage_log=True))
    sizes = sorted(map(tuple, pipeline.cluster_sizes(unique, result).collect()))
    assert sizes == [("AAAACCCCGGGGTTTA", 5), ("GATTACAGATTACAGA", 4), ("TTTTGGGGCCCCAAAA", 6)]
    members = {r.centroid: r.members for r in pipeline.cluster_members(unique, result).collect()}
    assert members["TTTTGGGGCCCCAAAA"] == "TTTTGGGGCCCCAAAA,TTTTGGGGCCCCAAAT"
    assert {r.centroid: (r.members, r.ids) for r in pipeline.cluster_ids(lines, unique, result).collect()}["AAAACCCCGGGGTTTA"] == ("AAAACCCCGGGGTTTA", "1,2")
    assert [r.centroid for r in pipeline.tidy(lines, unique, result).orderBy("line_no").collect()] == ["AAAACCCCGGGGTTTA"] * 2 + ["TTTTGGGGCCCCAAAA"] * 2 + ["GATTACAGATTACAGA"]
    strings = sorted((r.read, r["size"]) for r in result.strings.collect())
    assert strings == [("AAAACCCCGGGGTTTA", 2), ("TTTTGGGGCCCCAAAA", 2)]
    assert (result.metrics["ceiling"], result.metrics["tau_abs"], result.metrics["tau_cons"], result.metrics["keep"]) == (9, 6, 6, 8)
    assert result.metrics["audit"]["cross"] == 0
    stages = {x["stage"]: x for x in result.stages}
    assert list(stages) == ["input", "cores", "consensus", "thresholds", "merge", "absorb", "clusters"]
    assert stages["input"]["distinct"] == 5 and stages["cores"]["core_count"] == 2 and stages["merge"]["components"] == 2 and stages["clusters"]["clusters"] == 3


def noisy(seed):
    rng = random.Random(seed)
    origins = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(6)]
    out = []
    for k in range(90):
        s = list(origins[k % 6])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s))
            s[at : at + 1] = [[], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]][rng.randrange(3)]
        out.append("".join(s))
    return out, origins


def test_recovers_origins_in_any_order(spark):
    reads, origins = noisy(3)
    results = []
    for order in (reads, reads[::-1]):
        unique = unique_reads(lines_of(spark, order))
        result = pipeline.cluster(unique)
        results.append(sorted(map(tuple, pipeline.cluster_sizes(unique, result).collect())))
    assert results[0] == results[1] and len(results[0]) == 6
    assert {r.read for r in result.strings.collect()} == set(origins)


def test_approx_and_options(spark):
    reads, _ = noisy(4)
    unique = unique_reads(lines_of(spark, reads))
    result = pipeline.cluster(unique, pipeline.Options(approx=True, auto_tau=True))
    assert result.metrics["mode"] == "filtered" and pipeline.cluster_sizes(unique, result).count() == 6
    for bad in ({"tau_core": 33}, {"margin": 1.0}, {"anchor_occ": 0}):
        with pytest.raises(ValueError):
            pipeline.cluster(unique, pipeline.Options(**bad))


@pytest.mark.parametrize(("tau_cons", "searches"), [(20, ["counted_pairs"]), (0, ["counted_pairs", "filtered_pairs"])])
def test_filtered_mode_searches_pairs_once(spark, monkeypatch, tau_cons, searches):
    draw = random.Random(11)
    one = "".join(draw.choice("ACGT") for _ in range(110))
    origins = [one, "T" * 20 + one[20:]]
    reads = [o[:at] + "A" + o[at:] for o in origins for at in (40, 60, 80, 100)]
    unique, calls = unique_reads(lines_of(spark, reads)), []
    for name in ("counted_pairs", "filtered_pairs"):
        search = getattr(calibrate, name)
        monkeypatch.setattr(calibrate, name, lambda *a, name=name, search=search: calls.append(name) or search(*a))
    result = pipeline.cluster(unique, pipeline.Options(approx=True, auto_tau=True, tau_cons=tau_cons, margin=0.0))
    assert calls == searches and pipeline.cluster_sizes(unique, result).count() == 2
    assert 8 < result.metrics["ceiling"] == result.metrics["tau_cons"] + 1 <= 20


def test_pairs_counted_beyond_a_distance(spark):
    draw = random.Random(12)
    one = "".join(draw.choice("ACGT") for _ in range(110))
    texts = spark.createDataFrame([(k, "T" * k + one[k:]) for k in range(30)], "idx long, read string")
    for cap in (4096, None):
        every, counted = calibrate.filtered_pairs(texts, 55, cap=cap), calibrate.counted_pairs(texts, 55, 6, cap=cap).collect()
        expected = every.collect()
        assert sorted(tuple(r)[:3] for r in counted if r.a is not None) == sorted(tuple(r) for r in expected if r.d <= 6)
        assert all(r.n == 1 for r in counted if r.a is not None) and all(r.d > 6 for r in counted if r.a is None)
        assert sum(r.n for r in counted) == len(expected) > 200
        assert calibrate.tau_of(every, 55, 0.25) == calibrate.auto_tau(texts, cap=cap)


def test_empty_and_single(spark):
    unique = unique_reads(lines_of(spark, ["", None]))
    assert pipeline.cluster_sizes(unique, pipeline.cluster(unique)).collect() == []
    unique = unique_reads(lines_of(spark, ["ACGT", "ACGT"]))
    assert [tuple(r) for r in pipeline.cluster_sizes(unique, pipeline.cluster(unique)).collect()] == [("ACGT", 2)]


def test_read_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ACGT\t2\r\n\nTTTT\nACGT\n")
    rows = sorted((r.line_no, r.read, r.cnt) for r in read_text(spark, str(tmp_path / "a.txt")).collect())
    assert rows == [(1, "ACGT", 2), (2, "TTTT", 1), (3, "ACGT", 1)]
    (tmp_path / "b.txt").write_text("\n")
    for bad in ("b.txt", "none.txt"):
        with pytest.raises(ValueError):
            read_text(spark, str(tmp_path / bad))
    written = spark.createDataFrame([("B", 1), ("A", 2)], "centroid string, size long")
    pipeline.write_clusters(written, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "A\t2\nB\t1\n"


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(None, 3), (4, None), (7, 7), (400, 401), (401, 400)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components.components(df).collect()} == {x: find(x) for x in parent}
    assert components.components(df.limit(0)).collect() == []


def test_bucket_cap_counts_keys(spark):
    keys = spark.createDataFrame([(i // 2, 0, 1) for i in range(6)] + [(i, 0, 2) for i in range(7)] + [(9, 1, 1)], "idx long, it int, key long")
    assert sorted(map(tuple, candidates.bucket_pairs(keys, 6).distinct().collect())) == [(0, 1), (0, 2), (1, 2)]
    assert candidates.bucket_pairs(keys, 5).collect() == []


def test_votes_and_majorities(spark):
    reads = spark.createDataFrame(list(enumerate(["ACGT", "ACGT", "ACT", "ACTT", "ANGT"])), "idx long, read string")
    cores = reads.selectExpr("idx", "0L as core")
    centres = consensus.medoids(consensus.medoid_sample(cores, reads))
    assert centres.first()["medoid"] == "ACGT"
    cast = consensus.votes(cores, reads, centres)
    votes = {r.pos: (r.a, r.c, r.g, r.t, r["del"]) for r in consensus.column_votes(cast).collect()}
    assert votes[1] == (0, 4, 0, 0, 0) and votes[2][4] == 1
    assert consensus.consensus(cores, centres, cast).first()["cons"] == "ACGT"


@pytest.mark.parametrize("alphabet", ["ACGT", "ACN", "ANé"])
def test_consensus_of_dissent_alone(spark, alphabet):
    draw = random.Random(len(alphabet))
    texts = []
    for core in range(60):
        root = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 14)))
        for _ in range(draw.randint(2, 7)):
            text = list(root)
            for _ in range(draw.randint(0, 5)):
                at = draw.randint(0, len(text))
                text[at : at + draw.randint(0, 2)] = draw.choice(["", *alphabet, "AC"])
            texts.append((core, "".join(text)))
    cores = spark.createDataFrame([(k, core) for k, (core, _) in enumerate(texts)], "idx long, core long")
    reads = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(texts)], "idx long, read string")
    centres = spark.createDataFrame([(core, next(t for c, t in texts if c == core), 0) for core in range(60)], "core long, medoid string, total long")
    expected = {tuple(r) for r in consensus.consensus(cores, centres, consensus.votes(cores, reads, centres)).collect()}
    assert {tuple(r) for r in consensus.amended(cores, reads, centres).collect()} == expected
    assert any(cons != medoid for _, medoid, cons, _ in expected)


def test_half_of_deletions_keeps_the_column_and_a_majority_inserts(spark):
    reads = spark.createDataFrame(list(enumerate(["AC", "ACG", "TTCG", "TTCCG", "TTCCG"])), "idx long, read string")
    cores = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)], "idx long, core long")
    centres = spark.createDataFrame([(0, "ACG", 1), (2, "TTCG", 2)], "core long, medoid string, total long")
    made = {r.core: r.cons for r in consensus.consensus(cores, centres, consensus.votes(cores, reads, centres)).collect()}
    assert made == {0: "ACG", 2: "TTCCG"}


def test_tie_between_components_is_left_alone(spark):
    near = spark.createDataFrame([(10, 1, 3), (10, 2, 3), (11, 1, 2), (11, 2, 3), (12, 1, 3), (12, 3, 3)], "a long, b long, d int")
    merged = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "idx long, label long")
    assert sorted(map(tuple, absorb.absorb_exact(near, merged).collect())) == [(11, 1, 2), (12, 1, 3)]


def test_partition_differences(spark):
    left = spark.createDataFrame([(0, 5), (1, 5), (2, 7)], "idx long, label long")
    right = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "idx long, label long")
    other = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "idx long, label long")
    assert components.partition_differences(left, right).first()[0] == 0 and components.partition_differences(left, other).first()[0] == 1


def test_index_follows_binary_order(spark):
    unique = unique_reads(lines_of(spark, ["a", "Z", "A", "é", ""] + ["\t1"]))
    assert [r.read for r in index_reads(unique).orderBy("idx").collect()] == ["", "A", "Z", "a", "é"]


def test_stream(spark, tmp_path):
    from strandloom.streaming.incremental import compact, count_stream, counts_so_far, read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ACGT\t2\nTT\nACGT\n")
    parts = str(tmp_path / "parts")
    query = count_stream(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), parts)
    query.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("ACGT\t5\n")
    query.processAllAvailable()
    query.stop()
    want = [("ACGT", 4, 8), ("TT", 2, 1)]
    assert sorted(map(tuple, counts_so_far(spark, parts).collect())) == want
    compact(spark, parts, str(tmp_path / "one"))
    assert sorted(map(tuple, counts_so_far(spark, str(tmp_path / "one")).collect())) == want


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s))
        s[at : at + 1] = [[], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]][rng.randrange(3)]
    return "".join(s)


@pytest.mark.parametrize("seed", [1, 2])
def test_proof_and_neighbours_give_what_the_full_search_gives(spark, seed):
    rng = random.Random(seed)
    origins = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(12)]
    # families whose members lie 6 to 14 edits apart, so that some components are near each other
    strings = [(k, edited(rng, origins[k % 12], 3 + k % 5)) for k in range(48)]
    rest = [(1000 + k, edited(rng, rng.choice(strings)[1], rng.randrange(12))) for k in range(150)] + [(2000 + k, "".join(rng.choice("ACGT") for _ in range(40))) for k in range(20)]
    strings, rest = spark.createDataFrame(strings, "idx long, read string"), spark.createDataFrame(rest, "idx long, read string")
    tau, seen = 8, set()
    for keep, tau_cons in ((20, 4), (20, 8), (11, 6)):
        edges = calibrate.all_pairs(strings, keep).select("a", "b", "d")
        merged = absorb.merge_components(strings, edges, tau_cons)
        c_post = absorb.closest_apart(merged, edges, keep).first()[0]
        resolved = absorb.resolve(rest, strings, edges, merged, c_post, keep, tau)
        label = merged.select(F.col("idx").alias("core"), "label")
        labels = lambda rows: {(r[0], r[1]) for r in rows.join(label, "core").select("idx", "label").collect()}
        near = absorb.near_strings(rest, strings, tau)
        full = absorb.absorb_exact(near, merged)
        assert labels(resolved) == labels(full)
        stats = absorb.absorb_statistics(resolved, merged).first().asDict()
        assert stats["fast"] + stats["local"] + stats["full"] == 170 and stats["absorbed"] == full.count()
        assert stats["tie_rejected"] == near.select("a").distinct().count() - full.count()
        seen |= {k for k in ("fast", "local", "full") if stats[k]}
    assert seen == {"fast", "local", "full"}


def test_all_pairs_are_bounded(spark):
    with pytest.raises(ValueError):
        calibrate.all_pairs(spark.createDataFrame([(0, "A"), (1, "C"), (2, "G")], "idx long, read string"), 4, most=2)


def test_oversized_buckets_without_a_cap(spark):
    size = candidates.BUCKET_CAP + 4
    keys = spark.range(size).selectExpr("id as idx", "0 as it", "7L as key")
    assert candidates.bucket_pairs(keys).count() == 0 and candidates.bucket_pairs(keys, cap=None).count() == size * (size - 1) // 2
    reads = spark.createDataFrame([(f"{'ACGTTGCAAGCT' * 7}{a}{b}{c}", 86 + 1, 1) for a in "ACGT" for b in "ACGT" for c in "ACGT"], "read string, len int, cnt long")
    cores = [pipeline.core_stage(reads, pipeline.Options(bucket_cap=cap))[1].select("label").distinct().count() for cap in (3, None)]
    assert cores == [64, 1]


@pytest.mark.parametrize("name", ["absorb_resolved", "distance_histogram", "merge_exact", "absorb_exact", "absorb_statistics", "ceiling", "consensus_pairs", "histogram_dense", "assembled", "c_post"])
def test_queries_search_any_number_of_strings(spark, monkeypatch, name):
    texts = ["ACGTACGTACGTACGTTGCA", "ACGTACGTACGTACGTTGCC", "TTTTGGGGCCCCAAAATTTT", "ACGTACGTACGTACGTTGAA"]
    reads = spark.createDataFrame(list(enumerate(texts)), "idx long, read string")
    first = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 3)], "idx long, label long")
    strings = reads.where("idx < 3")
    monkeypatch.setattr(queries_reads, "_heads", lambda *_: (reads, first, strings))
    monkeypatch.setattr(queries_reads, "_rest", lambda *_: (reads.where("idx = 3"), strings))
    monkeypatch.setattr(calibrate.all_pairs, "__defaults__", (None, 2))  # a table larger than ``exact_max``
    assert queries_reads.QUERIES[name](spark, "").count() > 0


@pytest.mark.parametrize("name", ["candidate_pairs", "candidate_pairs_multi", "s1_work_counters", "candidate_partners", "signature_hamming"])
def test_candidates_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch, name):
    rng = random.Random(3)
    heads = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(6)]
    texts = sorted({edited(rng, rng.choice(heads), 4) + "ACGTACGTAC" * 2 for _ in range(150)} | {"AC", "NNNNNNNN"})
    reads = cut_lineage(spark.createDataFrame(list(enumerate(texts)), "idx long, read string"))
    monkeypatch.setattr(queries_reads, "_reads", lambda *_: reads)
    monkeypatch.setattr(candidates, "PAIRS_AT_ONCE", 50)
    made = queries_reads.QUERIES[name](spark, "")
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    found = {}
    for occurrences in (1, 4):
        pairs = candidates.bucket_pairs(encode.anchor_keys(reads, candidates.CORE_ROUNDS, occurrences)).collect()
        found[occurrences] = Counter((r["a"], r["b"]) for r in pairs)
    words = {r["idx"]: tuple(r)[1:] for r in encode.signatures(reads).collect()}
    bits = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(words.get(a, (0,) * 6), words.get(b, (0,) * 6)))
    multi = found[4]
    passed = [p for p in multi if bits(*p) <= candidates.THETA_CORE]
    want = {
        "candidate_pairs": Counter(found[1].values()).items(), "candidate_pairs_multi": Counter(multi.values()).items(),
        "candidate_partners": [(a, sum(p[0] == a for p in multi), sum(n for p, n in multi.items() if p[0] == a), sum(p[1] for p in multi if p[0] == a)) for a in {p[0] for p in multi}],
        "s1_work_counters": [(sum(multi.values()), sum(multi[p] for p in passed), len(passed))],
        "signature_hamming": Counter(bits(*p) for p in found[1]).items(),
    }
    assert multi and sorted(map(tuple, made.collect())) == sorted(want[name])


def test_ceiling_counts_all_pairs_of_a_block(spark, monkeypatch):
    rng = random.Random(12)
    tails = sorted({"".join(rng.choice("ACGT") for _ in range(3)) + "ACGT" * k for k in (3, 4) for _ in range(400)}, key=lambda t: (-len(t), t))
    texts = [f"{t}{rng.choice('ACGT')}{rng.choice('ACGT')}{k}" for t in tails for k in "ACGTNRY"]  # longer ones first
    strings = cut_lineage(spark.createDataFrame(list(enumerate(texts)), "idx long, read string"))
    monkeypatch.setattr(queries_reads, "_heads", lambda *_: (strings, None, strings))
    monkeypatch.setattr(calibrate, "blocks_for", lambda count: 1)
    limit = calibrate.distance_limit(strings)
    one, two = np.triu_indices(len(texts), 1)
    every = np.bincount(distance.distances([texts[i] for i in one], [texts[j] for j in two]), minlength=limit + 1)[: limit + 1].tolist()
    found = calibrate.ceiling_below_peak(every)
    assert calibrate.counts_of(queries_reads.QUERIES["histogram_dense"](spark, "")) == every
    assert tuple(queries_reads.QUERIES["ceiling"](spark, "").first())[:2] == (found.kind, found.peak)


def test_search_goes_only_as_far_as_components_ask(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = letters(40)
    everything = lambda strings, limit: calibrate.all_pairs(strings, limit)
    for apart, asked in ((5, [5]), (7, [5, 12]), (30, [5, 12])):
        other = "".join("ACGT"["CGTA".index(c)] if k < apart else c for k, c in enumerate(base))
        texts = [base, base[:-1] + "N", other, other[:-2] + "NN"]
        strings = cut_lineage(spark.createDataFrame(list(enumerate(texts)), "idx long, read string"))
        rest = cut_lineage(spark.createDataFrame([(10 + k, edited(rng, rng.choice(texts), rng.randrange(5))) for k in range(40)], "idx long, read string"))
        limits = []
        edges, complete, merged, c_post = absorb.merged_apart(strings, 4, 12, lambda s, limit: limits.append(limit) or everything(s, limit))
        every = cut_lineage(everything(strings, 12))
        assert limits == asked and c_post == absorb.closest_apart(merged, every, 12).first()[0]
        rows = [sorted(map(tuple, absorb.resolve(rest, strings, e, merged, c_post, 12, 4, complete=c).select("idx", "way", "core", "d", "near").collect())) for e, c in ((edges, complete), (every, None))]
        assert rows[0] == rows[1]
