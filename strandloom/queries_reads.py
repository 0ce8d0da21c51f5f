"""Queries of the clustering operators over ``raw_lines``, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import encode
from strandloom.functions.distance import alignment_ops, edit_distance, exact_distance, pigeonhole_pass
from strandloom.operators import absorb, calibrate, candidates, components, consensus
from strandloom.plans import pipeline
from strandloom.queries_sql import reads_sql
from strandloom.session import cut_lineage, drop_shuffles
from strandloom.sources.reads import index_reads, number_lines, parse_lines, unique_reads


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(spark.read.parquet(f"{d}/raw_lines.parquet").select("line_no", "raw_line"), "raw_line")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return number_lines(_parsed(spark, d).withColumnRenamed("line_no", "ordinal"), "ordinal")


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return unique_reads(_parsed(spark, d))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(index_reads(_unique(spark, d)))


def read_input(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("line_no", "read", "cnt")


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("line_no", "read")


def unique_reads_query(spark: SparkSession, d: str) -> DataFrame:
    ids = _parsed(spark, d).groupBy("read").agg(F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("ids"))
    return _unique(spark, d).join(ids, "read").select("read", "len", "cnt", "ids")


def base_codes(spark: SparkSession, d: str) -> DataFrame:
    return encode.base_rows(_reads(spark, d)).groupBy("pos", "code").agg(F.count("*").alias("n"))


def anchor_grams(spark: SparkSession, d: str) -> DataFrame:
    return encode.gram_rows(_reads(spark, d), encode.ANCHOR)


def anchor_schedule(spark: SparkSession, d: str) -> DataFrame:
    """How often the anchor of each of the 256 rounds occurs."""
    rounds = spark.createDataFrame(list(enumerate(encode.anchor_schedule())), "it int, code int")
    counts = encode.gram_rows(_reads(spark, d), encode.ANCHOR).groupBy("code").agg(F.count("*").alias("n"))
    return rounds.join(counts, "code", "left").select("it", "code", F.coalesce("n", F.lit(0)).alias("n"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return encode.signatures(_reads(spark, d))


def anchor_keys_first(spark: SparkSession, d: str) -> DataFrame:
    return encode.anchor_keys(_reads(spark, d), candidates.CORE_ROUNDS, 1)


def anchor_keys_multi(spark: SparkSession, d: str) -> DataFrame:
    return encode.anchor_keys(_reads(spark, d), candidates.CORE_ROUNDS, 4)


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of the single-occurrence search, and in how many rounds each is proposed."""
    return candidates.repeated_pairs(_reads(spark, d))


def candidate_pairs_multi(spark: SparkSession, d: str) -> DataFrame:
    return candidates.repeated_pairs(_reads(spark, d), occurrences=4)


def candidate_partners(spark: SparkSession, d: str) -> DataFrame:
    """Of each read, how many larger ones the keys propose, how often, and the sum of their indices."""
    return candidates.partners(_reads(spark, d))


def signature_hamming(spark: SparkSession, d: str) -> DataFrame:
    """Differing signature bits over all single-occurrence candidates."""
    return candidates.differing_bits(_reads(spark, d))


def core_edges(spark: SparkSession, d: str) -> DataFrame:
    return candidates.core_edges(_reads(spark, d))


def s1_work_counters(spark: SparkSession, d: str) -> DataFrame:
    return candidates.work_counters(_reads(spark, d))


def edit_distance_query(spark: SparkSession, d: str) -> DataFrame:
    """Distances of each read to the next one in binary order: with cutoff 8, and exact."""
    reads = _reads(spark, d).select("idx", "read")
    after = reads.select((F.col("idx") - 1).alias("idx"), F.col("read").alias("y"))
    return reads.join(after, "idx").select("idx", edit_distance("read", "y", 8).alias("within"), exact_distance("read", "y").alias("exact"))


def pigeonhole(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbours in binary order that the lossless filter lets through, and those truly within 8 edits."""
    reads = _reads(spark, d).select("idx", F.col("read").alias("x"))
    after = reads.select((F.col("idx") - 1).alias("idx"), F.col("x").alias("y"))
    rows = reads.join(after, "idx").select(pigeonhole_pass("x", "y", 8).alias("pass"), (edit_distance("x", "y", 8) <= 8).alias("near"))
    return rows.groupBy("pass", "near").agg(F.count("*").alias("pairs"))


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return pipeline.core_stage(_unique(spark, d), pipeline.Options())


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return _first(spark, d)[1]


def cores_orphans(spark: SparkSession, d: str) -> DataFrame:
    _, first = _first(spark, d)
    return components.cores(first).select("idx", "core").unionByName(components.orphans(first).select("idx", F.lit(None).cast("long").alias("core")))


def core_coverage(spark: SparkSession, d: str) -> DataFrame:
    return components.coverage(_first(spark, d)[1])


def canonical_partition(spark: SparkSession, d: str) -> DataFrame:
    return components.canonical(_first(spark, d)[1])


def partition_differences(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose core changes when only the first occurrence of an anchor makes a key."""
    reads, first = _first(spark, d)
    single = components.labels(reads, candidates.core_edges(reads, occurrences=1))
    return components.partition_differences(first, single)


def s1_audit(spark: SparkSession, d: str) -> DataFrame:
    reads, first = _first(spark, d)
    return absorb.audit(reads, first, 8, 200)


def medoid_sample(spark: SparkSession, d: str) -> DataFrame:
    reads, first = _first(spark, d)
    return consensus.medoid_sample(components.cores(first), reads)


def medoid(spark: SparkSession, d: str) -> DataFrame:
    return consensus.medoids(medoid_sample(spark, d))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    reads, first = _first(spark, d)
    members = components.cores(first)
    return consensus.votes(members, reads, cut_lineage(consensus.medoids(consensus.medoid_sample(members, reads))))


def alignment_ops_query(spark: SparkSession, d: str) -> DataFrame:
    """Operations by kind and place, of every core member against its medoid."""
    reads, first = _first(spark, d)
    members = components.cores(first)
    centres = consensus.medoids(consensus.medoid_sample(members, reads))
    pairs = members.join(reads.select("idx", "read"), "idx").join(centres.select("core", "medoid"), "core")
    return pairs.select(F.explode(alignment_ops("medoid", "read")).alias("op")).groupBy("op.tag", "op.pos").agg(F.count("*").alias("n"))


def alignment_scripts(spark: SparkSession, d: str) -> DataFrame:
    """What the script of each core member against its medoid costs, and the read it makes."""
    reads, first = _first(spark, d)
    members = components.cores(first)
    centres = consensus.medoids(consensus.medoid_sample(members, reads))
    pairs = members.join(reads.select("idx", "read"), "idx").join(centres.select("core", "medoid"), "core")
    scripts = pairs.select("idx", alignment_ops("medoid", "read").alias("ops"))
    cost = F.size(F.filter("ops", lambda op: op["tag"] != "EQ")).alias("cost")
    return scripts.select("idx", cost, F.array_join(F.transform("ops", lambda op: F.coalesce(op["ch"], F.lit(""))), "").alias("made"))


def vote_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How many more symbols the members of each core insert into its medoid than they delete."""
    change = F.when(F.col("kind") == "I", F.col("n") * F.length("ch")).when(F.col("kind") == "D", -F.col("n")).otherwise(F.lit(0))
    return _votes(spark, d).groupBy("core").agg(F.sum(change).alias("surplus"))


def vote_totals(spark: SparkSession, d: str) -> DataFrame:
    """Columns and their votes in each core whose members consist of bases only, so that each member votes in each column."""
    reads, first = _first(spark, d)
    members = components.cores(first)
    pure = members.join(reads.select("idx", "read"), "idx").groupBy("core").agg(F.bool_and(F.col("read").rlike("^[ACGT]+$")).alias("pure")).where("pure").select("core")
    cast = consensus.votes(members, reads, cut_lineage(consensus.medoids(consensus.medoid_sample(members, reads))))
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("del")
    return consensus.column_votes(cast).join(pure, "core").groupBy("core").agg(F.count("*").alias("columns"), F.min(total).alias("least"), F.max(total).alias("most"))


def column_votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.column_votes(_votes(spark, d))


def insertion_votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.insertion_votes(_votes(spark, d))


def consensus_query(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.consensus_stage(*_first(spark, d)).withColumnRenamed("read", "cons")


def _heads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads, first labels and the smallest read of each core: strings that SQL can make, too."""
    reads, first = _first(spark, d)
    heads = reads.join(components.cores(first).select(F.col("core").alias("idx")).distinct(), "idx").select("idx", "read")
    return reads, first, cut_lineage(heads)


def _every_pair(strings: DataFrame, limit: int, keep: int | None = None) -> DataFrame:
    """All pairs whatever the number of strings: unlike the pipeline, these queries have no other way beyond ``EXACT_MAX``."""
    return calibrate.all_pairs(strings, limit, keep, None)


def consensus_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _every_pair(_heads(spark, d)[2], 41).select("a", "b", "d")


def dmax(spark: SparkSession, d: str) -> DataFrame:
    strings = _heads(spark, d)[2]
    return strings.agg(F.greatest(F.lit(4), F.floor(F.coalesce(F.median(F.length("read")), F.lit(0.0)) * 0.5)).cast("int").alias("dmax"))


def _histogram(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    strings = _heads(spark, d)[2]
    limit = calibrate.distance_limit(strings)
    return calibrate.histogram(_every_pair(strings, limit, 0), limit), limit


def distance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d)[0].where("pairs > 0")


def histogram_dense(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d)[0]


def ceiling(spark: SparkSession, d: str) -> DataFrame:
    hist, limit = _histogram(spark, d)
    found = calibrate.ceiling_below_peak(calibrate.counts_of(hist))
    top = found.ceiling if found.kind else limit + 1
    row = (found.kind, found.peak, found.gap_start, found.gap_len, top, calibrate.safe_tau(top, 0.25, exact=True))
    return spark.createDataFrame([row], "kind int, peak int, gap_start int, gap_len int, ceiling int, tau_safe int")


def filtered_histogram(spark: SparkSession, d: str) -> DataFrame:
    strings = _heads(spark, d)[2]
    limit = calibrate.distance_limit(strings)
    return calibrate.histogram(calibrate.filtered_pairs(strings, limit), limit)


def auto_tau(spark: SparkSession, d: str) -> DataFrame:
    found, tau = calibrate.auto_tau(_heads(spark, d)[2])
    return spark.createDataFrame([(found.kind, found.ceiling, tau)], "kind int, ceiling int, tau int")


def c_post(spark: SparkSession, d: str) -> DataFrame:
    strings = _heads(spark, d)[2]
    edges, complete, merged, _ = absorb.merged_apart(strings, 20, 41, _every_pair)
    return absorb.closest_apart(merged, edges, complete)


def merge_exact(spark: SparkSession, d: str) -> DataFrame:
    strings = _heads(spark, d)[2]
    return absorb.merge_components(strings, _every_pair(strings, 20), 20)


def merge_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Components of the strings joined by the pairs that keys and signatures propose."""
    strings = _heads(spark, d)[2]
    return absorb.merge_components(strings, calibrate.filtered_pairs(strings, 20), 20)


def _left_over(reads: DataFrame, first: DataFrame) -> DataFrame:
    return cut_lineage(reads.join(components.orphans(first), "idx").select("idx", "read"))


def _rest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reads, first, strings = _heads(spark, d)
    return _left_over(reads, first), strings


def absorb_candidates(spark: SparkSession, d: str) -> DataFrame:
    rest, strings = _rest(spark, d)
    pairs = candidates.sided_pairs(encode.anchor_keys(rest, 96, 4), encode.anchor_keys(strings, 96, 4))
    return pairs.groupBy("a").agg(F.count("*").alias("proposals"), F.count_distinct("b").alias("strings")).withColumnRenamed("a", "idx")


def absorb_filtered(spark: SparkSession, d: str) -> DataFrame:
    return absorb.absorb_filtered(*_rest(spark, d), 16)


def nearest_consensus(spark: SparkSession, d: str) -> DataFrame:
    near = absorb.near_strings(*_rest(spark, d), 16)
    return near.groupBy(F.col("a").alias("idx")).agg(F.min("d").alias("d"), F.min_by("b", F.struct("d", "b")).alias("core"))


def absorb_exact(spark: SparkSession, d: str) -> DataFrame:
    rest, strings = _rest(spark, d)
    merged = cut_lineage(absorb.merge_components(strings, _every_pair(strings, 20), 20))
    drop_shuffles(spark)
    return absorb.absorb_exact(cut_lineage(absorb.near_strings(rest, strings, 16)), merged)


def _resolved(rest: DataFrame, strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges, complete, merged, closest = absorb.merged_apart(strings, 20, 41, _every_pair)
    return cut_lineage(absorb.resolve(rest, strings, edges, merged, closest, 41, 16, complete=complete)), merged


def absorb_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The component each left-over read goes to, by proof, neighbours or search."""
    resolved, merged = _resolved(*_rest(spark, d))
    return resolved.join(merged.select(F.col("idx").alias("core"), "label"), "core").select("idx", "label")


def absorb_statistics(spark: SparkSession, d: str) -> DataFrame:
    return absorb.absorb_statistics(*_resolved(*_rest(spark, d)))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """The final label of every read: by its core, by the string it was absorbed into, or its own."""
    reads, first, strings = _heads(spark, d)
    resolved, merged = _resolved(_left_over(reads, first), strings)
    return absorb.assemble(reads, components.cores(first), merged, resolved.where("core is not null"))


def _core_sink(make: Callable[[DataFrame, DataFrame, pipeline.Clustering], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A sink over the cores and orphans of the first stage, whose labels SQL can make, too."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = cut_lineage(_lines(spark, d))
        unique = unique_reads(lines)
        reads, first = pipeline.core_stage(unique, pipeline.Options())
        return make(lines, unique, pipeline.Clustering(reads, first, reads))

    return query


def _sink(make: Callable[[DataFrame, DataFrame, pipeline.Clustering], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = cut_lineage(_lines(spark, d))
        unique = unique_reads(lines)
        return make(lines, unique, pipeline.cluster(unique))

    return query


def clusters_approx(spark: SparkSession, d: str) -> DataFrame:
    unique = _unique(spark, d)
    return pipeline.cluster_sizes(unique, pipeline.cluster(unique, pipeline.Options(approx=True, auto_tau=True)))


_SINKS = {
    "sizes": lambda lines, unique, result: pipeline.cluster_sizes(unique, result),
    "members": lambda lines, unique, result: pipeline.cluster_members(unique, result),
    "seq_id": lambda lines, unique, result: pipeline.cluster_ids(lines, unique, result),
    "tidy": lambda lines, unique, result: pipeline.tidy(lines, unique, result),
}

QUERIES = {
    "read_input": read_input, "line_numbers": line_numbers, "unique_reads": unique_reads_query, "base_codes": base_codes,
    "anchor_grams": anchor_grams, "anchor_schedule": anchor_schedule, "signatures": signatures, "anchor_keys_first": anchor_keys_first,
    "anchor_keys_multi": anchor_keys_multi, "candidate_pairs": candidate_pairs, "candidate_pairs_multi": candidate_pairs_multi, "candidate_partners": candidate_partners,
    "signature_hamming": signature_hamming, "core_edges": core_edges, "s1_work_counters": s1_work_counters,
    "edit_distance": edit_distance_query, "pigeonhole": pigeonhole, "connected_components": connected_components,
    "cores_orphans": cores_orphans, "core_coverage": core_coverage, "canonical_partition": canonical_partition,
    "partition_differences": partition_differences, "s1_audit": s1_audit, "medoid_sample": medoid_sample, "medoid": medoid,
    "alignment_ops": alignment_ops_query, "alignment_scripts": alignment_scripts, "vote_lengths": vote_lengths, "vote_totals": vote_totals,
    "column_votes": column_votes, "insertion_votes": insertion_votes, "consensus": consensus_query,
    "consensus_pairs": consensus_pairs, "dmax": dmax, "distance_histogram": distance_histogram, "histogram_dense": histogram_dense,
    "ceiling": ceiling, "filtered_histogram": filtered_histogram, "auto_tau": auto_tau, "c_post": c_post,
    "merge_exact": merge_exact, "merge_filtered": merge_filtered, "assembled": assembled,
    "absorb_candidates": absorb_candidates, "absorb_filtered": absorb_filtered, "nearest_consensus": nearest_consensus,
    "absorb_exact": absorb_exact, "absorb_resolved": absorb_resolved, "absorb_statistics": absorb_statistics,
    "clusters_default": _sink(_SINKS["sizes"]), "clusters_members": _sink(_SINKS["members"]),
    "clusters_seq_id": _sink(_SINKS["seq_id"]), "clusters_tidy": _sink(_SINKS["tidy"]),
    **{f"cores_{name}": _core_sink(make) for name, make in _SINKS.items()},
    "clusters_approx": clusters_approx,
}

SQL = reads_sql()
