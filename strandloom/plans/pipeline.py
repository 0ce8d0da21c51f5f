"""The whole clustering: reads in, a label for each distinct read out, and its output tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import absorb, calibrate, candidates, components, consensus
from strandloom.session import cut_lineage, drop_shuffles
from strandloom.sources.reads import index_reads, unique_reads

log = logging.getLogger(__name__)


@dataclass
class Options:
    """Thresholds and modes; ``validate`` raises ValueError for values outside their domain. ``bucket_cap`` is the reference's
    limit to the keys of a bucket; with None no bucket is dropped, so that no result depends on the size of the input. With
    ``stage_log`` the figures of each stage are counted, logged as it ends and kept in ``Clustering.stages``."""

    tau_core: int = 8
    tau_abs: int = 16
    tau_cons: int = 20
    sig_abs: int = candidates.THETA_MERGE
    margin: float = 0.25
    anchor_occ: int = 4
    exact_max: int = calibrate.EXACT_MAX
    bucket_cap: int | None = candidates.BUCKET_CAP
    audit_sample: int = 0
    stage_log: bool = False
    auto_tau: bool = False
    approx: bool = False

    def validate(self) -> None:
        if not 0 <= self.tau_core <= 32:
            raise ValueError("tau_core must be between 0 and 32")
        if not 0 <= self.margin < 1:
            raise ValueError("margin must be at least 0 and below 1")
        if not 1 <= self.anchor_occ <= 64:
            raise ValueError("anchor_occ must be between 1 and 64")


@dataclass
class Clustering:
    """``reads`` (idx, read, len), ``labels`` (idx, label), ``strings`` (idx, medoid, read, size) and what was decided."""

    reads: DataFrame
    labels: DataFrame
    strings: DataFrame
    histogram: DataFrame | None = None
    metrics: dict = field(default_factory=dict)
    stages: list[dict] = field(default_factory=list)

    def say(self, stage: str, **figures) -> None:
        """A line of the stage log."""
        self.stages.append({"stage": stage, **figures})
        log.info("%s: %s", stage, figures)


def core_stage(unique: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Indexed reads and their first labels (idx, label)."""
    reads = cut_lineage(index_reads(unique))
    edges = candidates.core_edges(reads, options.tau_core, occurrences=1 if options.approx else options.anchor_occ, cap=options.bucket_cap)
    return reads, cut_lineage(components.labels(reads, edges))


def consensus_stage(reads: DataFrame, labelled: DataFrame) -> DataFrame:
    """(idx, medoid, read, size): the consensus of each core, by the core's smallest member."""
    members = components.cores(labelled)
    centres = cut_lineage(consensus.medoids(consensus.medoid_sample(members, reads)))
    made = consensus.amended(members, reads, centres)
    return cut_lineage(made.select(F.col("core").alias("idx"), "medoid", F.col("cons").alias("read"), "size"))


def cluster(unique: DataFrame, options: Options | None = None) -> Clustering:
    """Cluster distinct reads (read, len, cnt). Counts never influence the result, nor does the order of the input."""
    options = options or Options()
    options.validate()
    reads, first = core_stage(unique, options)
    drop_shuffles(unique.sparkSession)
    rest = reads.join(components.orphans(first), "idx").select("idx", "read")
    members = components.cores(first)
    strings = consensus_stage(reads, first)
    count = strings.count()
    drop_shuffles(unique.sparkSession)
    result = Clustering(reads, first, strings, metrics={"strings": count})
    if options.stage_log:
        result.say("input", distinct=reads.count())
        result.say("cores", tau=options.tau_core, **components.coverage(first).first().asDict())
        result.say("consensus", **strings.agg(F.count("*").alias("strings"), F.count_if(F.col("read") == F.col("medoid")).alias("as_medoid")).first().asDict())
    if options.audit_sample:
        result.metrics["audit"] = absorb.audit(reads, first, options.tau_core, options.audit_sample).first().asDict()
    tau_abs, tau_cons = options.tau_abs, options.tau_cons
    if not options.approx and 2 <= count <= options.exact_max:
        limit = calibrate.distance_limit(strings)
        # all that any threshold can need; beyond it only the histogram counts
        pairs = cut_lineage(calibrate.all_pairs(strings, limit, limit if options.auto_tau else min(2 * max(tau_abs, tau_cons) + 1, limit), options.exact_max))
        result.histogram = calibrate.histogram(pairs, limit)
        found = calibrate.ceiling_below_peak(calibrate.counts_of(result.histogram))
        ceiling = found.ceiling if found.kind else limit + 1
        tau_safe = calibrate.safe_tau(ceiling, options.margin, exact=True)
        keep = min(2 * max(tau_abs, tau_cons) + 1, limit)
        if options.auto_tau:
            tau_abs = tau_cons = tau_safe
            keep = min(2 * tau_safe + 1, limit)
        tau_cons, tau_abs = (tau_safe if t >= ceiling else t for t in (tau_cons, tau_abs))
        edges = pairs.where("a is not null").where(F.col("d") <= keep)
        merged = cut_lineage(absorb.merge_components(strings, edges, tau_cons))
        c_post = absorb.closest_apart(merged, edges, keep).first()[0]
        resolved = cut_lineage(absorb.resolve(rest, strings, edges, merged, c_post, keep, tau_abs, options.sig_abs, options.anchor_occ, options.bucket_cap))
        taken = resolved.where("core is not null").select("idx", "core", "d")
        result.metrics |= {"mode": "exact", "limit": limit, "ceiling": ceiling, "kind": found.kind, "keep": keep, "c_post": c_post}
        result.metrics["absorbed"] = absorb.absorb_statistics(resolved, merged).first().asDict()
    else:
        occurrences = 1 if options.approx else options.anchor_occ
        pairs, complete = None, tau_cons
        if options.auto_tau and count:
            limit = calibrate.distance_limit(strings)
            pairs = cut_lineage(calibrate.counted_pairs(strings, limit, min(complete, limit), options.sig_abs, options.bucket_cap))
            found, tau = calibrate.tau_of(pairs, limit, options.margin)
            if tau > 0:
                tau_abs = tau_cons = tau
            complete = min(complete, limit)
            result.metrics |= {"ceiling": found.ceiling, "kind": found.kind}
        if pairs is None or tau_cons > complete:  # else that search has all pairs that are merged
            pairs = calibrate.filtered_pairs(strings, tau_cons, options.sig_abs, options.bucket_cap)
        merged = cut_lineage(absorb.merge_components(strings, pairs.where("a is not null"), tau_cons))
        drop_shuffles(unique.sparkSession)
        taken = absorb.absorb_filtered(rest, strings, tau_abs, options.sig_abs, occurrences, options.bucket_cap)
        result.metrics["mode"] = "filtered"
    result.labels = cut_lineage(absorb.assemble(reads, members, merged, taken))
    result.metrics |= {"tau_abs": tau_abs, "tau_cons": tau_cons}
    if options.stage_log:
        result.say("thresholds", tau_abs=tau_abs, tau_cons=tau_cons, **{k: result.metrics[k] for k in ("mode", "limit", "ceiling", "kind", "keep", "c_post") if k in result.metrics})
        result.say("merge", components=merged.select("label").distinct().count())
        result.say("absorb", **result.metrics.get("absorbed", {"absorbed": taken.count()}))
        result.say("clusters", clusters=result.labels.select("label").distinct().count())
    log.info("clustering: %s", result.metrics)
    return result


def cluster_lines(lines: DataFrame, options: Options | None = None) -> Clustering:
    """Cluster lines (read, cnt, ...)."""
    return cluster(unique_reads(lines), options)


def _named(unique: DataFrame, result: Clustering) -> DataFrame:
    """(label, idx, read, cnt, centroid) of each distinct read; the centroid is the cluster's smallest read."""
    rows = result.reads.select("idx", "read").join(result.labels, "idx").join(unique.select("read", "cnt"), "read")
    least = result.labels.groupBy("label").agg(F.min("idx").alias("idx")).join(result.reads.select("idx", "read"), "idx").select("label", F.col("read").alias("centroid"))
    return rows.join(least, "label")


def cluster_sizes(unique: DataFrame, result: Clustering) -> DataFrame:
    """(centroid, size), to be ordered by centroid when written."""
    return _named(unique, result).groupBy("centroid").agg(F.sum("cnt").alias("size"))


def cluster_members(unique: DataFrame, result: Clustering) -> DataFrame:
    """(centroid, size, members): the members' comma list, as long as the cluster is large."""
    return _named(unique, result).groupBy("centroid").agg(F.sum("cnt").alias("size"), F.array_join(F.array_sort(F.collect_list("read")), ",").alias("members"))


def cluster_ids(lines: DataFrame, unique: DataFrame, result: Clustering, members: bool = False) -> DataFrame:
    """(centroid, size, members, ids): line numbers ascending; ``members`` is the centroid alone unless asked for."""
    named = _named(unique, result)
    ids = lines.select("read", "line_no").join(named.select("read", "centroid"), "read").groupBy("centroid").agg(F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("ids"))
    base = cluster_members(unique, result) if members else cluster_sizes(unique, result).withColumn("members", F.col("centroid"))
    return base.join(ids, "centroid").select("centroid", "size", "members", "ids")


def tidy(lines: DataFrame, unique: DataFrame, result: Clustering) -> DataFrame:
    """(line_no, read, centroid): a row for each input line, to be ordered by line when written."""
    return lines.select("line_no", "read").join(_named(unique, result).select("read", "centroid"), "read")


def write_clusters(rows: DataFrame, path: str) -> None:
    """Tab-separated text, ordered by the first column through a range partitioning."""
    ordered = rows.orderBy(rows.columns[0])
    ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in (rows.columns if rows.columns[0] != "line_no" else rows.columns[1:])]).alias("value")).write.mode("overwrite").text(path)
