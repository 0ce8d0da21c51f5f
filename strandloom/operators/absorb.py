"""Merging of consensus strings and assignment of left-over reads to them.

Defined results: a left-over read goes to the nearest string within the threshold, unless a second component is as near;
the filtered search takes the smallest of equally near strings instead; empty sides give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encode import signed_keys
from strandloom.functions.fused import met_pairs
from strandloom.operators.candidates import BUCKET_CAP, MERGE_ROUNDS, THETA_MERGE, near_pairs, sided_pairs, verified
from strandloom.operators.calibrate import blocks_for, spread
from strandloom.operators.components import labels
from strandloom.session import cut_lineage, drop_shuffles


def merge_components(strings: DataFrame, edges: DataFrame, tau: int) -> DataFrame:
    """(idx, label): components of the strings joined by edges of at most ``tau``."""
    return labels(strings, edges.where(F.col("d") <= tau))


def closest_apart(merged: DataFrame, edges: DataFrame, keep: int) -> DataFrame:
    """(c_post, components, unions): the least kept distance between components, keep + 1 where there is none."""
    x, y = merged.select(F.col("idx").alias("a"), F.col("label").alias("la")), merged.select(F.col("idx").alias("b"), F.col("label").alias("lb"))
    least = edges.where(F.col("d") <= keep).join(x, "a").join(y, "b").where("la <> lb").agg(F.min("d")).first()[0]
    c_post = F.lit(keep + 1 if least is None else least).cast("int").alias("c_post")
    return merged.agg(c_post, F.count_distinct("label").alias("components"), (F.count("*") - F.count_distinct("label")).alias("unions"))


def merged_apart(strings: DataFrame, tau: int, keep: int, pairs: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, int, DataFrame, int]:
    """(edges, complete, merged, c_post): every pair (a, b, d) within ``complete`` edits, the components of those within
    ``tau``, and ``closest_apart`` of them. ``pairs`` searches strings for all pairs within a limit.

    Components lie more than ``tau`` apart, so where two lie ``tau`` + 1 apart no pair beyond can be closer, and only
    where none do are all pairs within ``keep`` searched.
    """
    for complete in (min(tau + 1, keep), keep):
        drop_shuffles(strings.sparkSession)
        edges = cut_lineage(pairs(strings, complete))
        merged = cut_lineage(merge_components(strings, edges, tau))
        c_post = closest_apart(merged, edges, complete).first()[0]
        if c_post <= complete:
            break
    drop_shuffles(strings.sparkSession)
    return edges, complete, merged, c_post


def near_strings(rest: DataFrame, strings: DataFrame, tau: int) -> DataFrame:
    """(a, b, d): every string b within ``tau`` edits of a left-over read a, exactly.

    The strings are taken in blocks; the pipeline bounds them by ``exact_max``, single queries do not. The left-over reads are cut into as many
    blocks as they need; two blocks meet in one group of bounded size.
    """
    across, down = blocks_for(strings.count()), blocks_for(rest.count())
    right = strings.select("idx", "read", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("p"), F.pmod(F.xxhash64("idx"), F.lit(across)).cast("int").alias("q"))
    left = rest.select("idx", "read", F.lit(0).alias("side"), F.pmod(F.xxhash64("idx"), F.lit(down)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"))

    return met_pairs(spread(left.unionByName(right), across * down), tau, tau, False).select("a", "b", "d")


def absorb_filtered(rest: DataFrame, strings: DataFrame, tau: int, theta: int = THETA_MERGE, occurrences: int = 4, cap: int | None = BUCKET_CAP) -> DataFrame:
    """(idx, core, d): the nearest string that the keys and signatures propose, the smallest of equally near ones."""
    if cap is None:
        near = verified(sided_pairs(signed_keys(rest, MERGE_ROUNDS, occurrences), signed_keys(strings, MERGE_ROUNDS, occurrences), cap, theta), rest, strings, tau)
    else:
        near = near_pairs(rest, strings, tau, MERGE_ROUNDS, theta, occurrences, cap, gather=True)
    return near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.col("a").alias("idx"), F.col("m.b").alias("core"), F.col("m.d").alias("d"))


def absorb_exact(near: DataFrame, merged: DataFrame) -> DataFrame:
    """(idx, core, d): the nearest string, where all equally near ones lie in one component."""
    labelled = near.join(merged.select(F.col("idx").alias("b"), "label"), "b")
    best = labelled.groupBy("a").agg(F.min("d").alias("least")).withColumnRenamed("a", "a0")
    ties = labelled.join(best, (F.col("a") == F.col("a0")) & (F.col("d") == F.col("least")))
    return ties.groupBy("a").agg(F.min("b").alias("core"), F.min("d").alias("d"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 = l1").select(F.col("a").alias("idx"), "core", "d")


def resolve(rest: DataFrame, strings: DataFrame, edges: DataFrame, merged: DataFrame, c_post: int, keep: int, tau: int, theta: int = THETA_MERGE, occurrences: int = 4, cap: int | None = BUCKET_CAP, complete: int | None = None) -> DataFrame:
    """(idx, way, first, core, d, near) of each left-over read: the component that ``absorb_exact`` gives it, mostly without
    a search over all strings.

    Keys propose a string ``first`` at some distance ``a``. Where 2a is below ``c_post``, the least distance between
    components, no other component can be as near (way ``fast``). Else, where a + ``tau`` is at most ``keep``, every string
    within ``tau`` is linked to the proposed one by an edge of at most a + ``tau``, so only its neighbours are compared
    (``local``). All strings are searched for the remaining reads alone (``full``). ``core`` is null for a read that stays
    alone, ``near`` says whether a string was within ``tau``; for way ``fast`` the core is the proposed string.
    Where ``edges`` hold only the pairs within ``complete`` edits, local reads that need more search all strings, too.
    """
    proposed = absorb_filtered(rest, strings, tau, theta, occurrences, cap).select("idx", F.col("core").alias("first"), F.col("d").alias("a"))
    way = F.when(2 * F.col("a") < c_post, "fast").when(F.col("a") + tau <= keep, "local").otherwise("full")
    ways = cut_lineage(rest.select("idx", "read").join(proposed, "idx", "left").withColumn("way", way))
    beside = F.col("a") + tau <= (keep if complete is None else complete)
    local, sought = ways.where((F.col("way") == "local") & beside), ways.where((F.col("way") == "full") | ((F.col("way") == "local") & ~beside))
    kept = edges.where(F.col("d") <= keep).select("a", "b", "d")
    around = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).withColumnRenamed("a", "first")
    around = local.join(around, "first").where(F.col("d") <= F.col("a") + tau).select(F.col("idx").alias("a"), "b")
    met = verified(around.unionByName(local.select(F.col("idx").alias("a"), F.col("first").alias("b"))), local, strings, tau)
    near = cut_lineage(met.unionByName(near_strings(sought, strings, tau)))
    some = near.select(F.col("a").alias("idx")).distinct().withColumn("near", F.lit(True))
    fast = ways.where("way = 'fast'").select("idx", F.col("first").alias("core"), F.col("a").alias("d"))
    chosen = fast.unionByName(absorb_exact(near, merged))
    rows = ways.select("idx", "way", "first").join(chosen, "idx", "left").join(some, "idx", "left")
    return rows.select("idx", "way", "first", "core", "d", (F.coalesce("near", F.lit(False)) | (F.col("way") == "fast")).alias("near"))


def absorb_statistics(resolved: DataFrame, merged: DataFrame) -> DataFrame:
    """(fast, local, full, moved, added, tie_rejected, absorbed) of what ``resolve`` did: how many reads took each way, and
    among those that were compared, how many changed component, were added, or were as near to two components."""
    was, now = (merged.select(F.col("idx").alias(c), F.col("label").alias(n)) for c, n in (("first", "was"), ("core", "now")))
    rows = resolved.join(was, "first", "left").join(now, "core", "left")
    checked = F.col("way") != "fast"
    return rows.agg(
        *[F.count_if(F.col("way") == w).alias(w) for w in ("fast", "local", "full")],
        F.count_if(checked & F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))).alias("moved"),
        F.count_if(checked & F.col("was").isNull() & F.col("now").isNotNull()).alias("added"),
        F.count_if(checked & F.col("near") & F.col("now").isNull()).alias("tie_rejected"),
        F.count("now").alias("absorbed"),
    )


def assemble(reads: DataFrame, cores: DataFrame, merged: DataFrame, absorbed: DataFrame) -> DataFrame:
    """(idx, label): core reads take their component, absorbed ones that of their string, all others are alone."""
    label = merged.select(F.col("idx").alias("core"), "label")
    placed = cores.select("idx", "core").unionByName(absorbed.select("idx", "core")).join(label, "core").select("idx", "label")
    return reads.select("idx").join(placed, "idx", "left").select("idx", F.coalesce("label", "idx").alias("label"))


def audit(reads: DataFrame, labelled: DataFrame, tau: int, sample: int) -> DataFrame:
    """(sampled, neighbours, cross, reads_with_cross): all neighbours within ``tau`` edits of evenly spread reads, and
    those of them that lie in another component. The sample is a stated set of bounded size."""
    total = reads.count()
    sample = min(sample, total) if total >= 2 else 0
    spread = reads.sparkSession.range(sample).select(F.floor(F.col("id") * F.lit(total) / F.lit(max(sample, 1))).alias("idx"))
    chosen = reads.join(spread, "idx").select("idx", "read")
    near = near_strings(reads, chosen, tau).where("a <> b")
    x, y = labelled.select(F.col("idx").alias("a"), F.col("label").alias("la")), labelled.select(F.col("idx").alias("b"), F.col("label").alias("lb"))
    met = near.join(x, "a").join(y, "b")
    return met.agg(F.lit(sample).cast("long").alias("sampled"), F.count("*").alias("neighbours"), F.count_if(F.col("la") != F.col("lb")).alias("cross"), F.count_distinct(F.when(F.col("la") != F.col("lb"), F.col("b"))).alias("reads_with_cross"))
