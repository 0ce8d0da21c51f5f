"""Distance histograms and the thresholds that a gap in them sets.

A histogram has a row for each distance from 0 to the limit, zeros too. Everything past it is a few hundred numbers, worked
out on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encode import signed_keys
from strandloom.functions.fused import met_pairs
from strandloom.operators.candidates import BUCKET_CAP, MERGE_ROUNDS, THETA_MERGE, bucket_pairs, near_pairs, verified
from strandloom.session import MOST_PARTITIONS

MIN_GAP = 2
#: Least and most strings that one block of the exact pair search holds, and blocks that small tables are cut into.
BLOCK, MOST_BLOCK, FEW_BLOCKS = 512, 8192, 6
#: Strings up to which the pipeline searches all pairs; ``filtered_pairs`` is its way beyond.
EXACT_MAX = 50_000


@dataclass
class Ceiling:
    """What the histogram says: kind 1 for a gap below the peak, 2 for none, 0 for an empty histogram."""

    kind: int = 0
    peak: int = -1
    gap_start: int = 0
    gap_len: int = 0
    ceiling: int = -1


def distance_limit(strings: DataFrame, fraction: float = 0.5) -> int:
    """Half the median length, 4 at least; 4 for an empty table."""
    middle = strings.agg(F.median(F.length("read"))).first()[0]
    return max(4, int(fraction * (middle or 0)))


def blocks_for(count: int) -> int:
    """How many blocks ``count`` strings are put into."""
    return max(1, -(-count // min(MOST_BLOCK, max(BLOCK, -(-count // FEW_BLOCKS)))))


def spread(sides: DataFrame, groups: int) -> DataFrame:
    """The two sides of all groups (p, q) in tasks of few groups each; by their bytes, which are few, Spark would put many
    of these long ones into one."""
    return sides.repartition(min(4 * groups, MOST_PARTITIONS), "p", "q")


def all_pairs(strings: DataFrame, limit: int, keep: int | None = None, most: int | None = EXACT_MAX) -> DataFrame:
    """(a, b, d, n): every pair within ``keep`` edits, and beyond it up to ``limit`` only how many there are (a, b null).

    The work grows with the square of the strings, so more than ``most`` of them raise ValueError; with None any number is
    searched. They are put into blocks, and every two blocks meet in one group of bounded size, so the pairs spread evenly
    over tasks and no side is broadcast.
    """
    keep = limit if keep is None else keep
    count = strings.count()
    if most is not None and count > most:
        raise ValueError(f"{count} strings are too many for all pairs; use filtered_pairs above {most}")
    blocks = blocks_for(count)
    placed = strings.select("idx", "read", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("blk"))
    left = placed.select("idx", "read", F.lit(0).alias("side"), F.col("blk").alias("p"), F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("q"))
    right = placed.where("blk > 0").select("idx", "read", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blk") - 1)).alias("p"), F.col("blk").alias("q"))

    return met_pairs(spread(left.unionByName(right), blocks * (blocks + 1) // 2), limit, keep, True)


def filtered_pairs(strings: DataFrame, limit: int, theta: int = THETA_MERGE, cap: int | None = BUCKET_CAP) -> DataFrame:
    """(a, b, d): the pairs within ``limit`` edits that the anchor keys and signatures propose."""
    if cap is None:
        return verified(bucket_pairs(signed_keys(strings, MERGE_ROUNDS, 1), cap, theta), strings, strings, limit)
    return near_pairs(strings, None, limit, MERGE_ROUNDS, theta, 1, cap, gather=True)


def histogram(pairs: DataFrame, limit: int) -> DataFrame:
    """(d, pairs) for d = 0..limit; ``pairs`` may carry how many pairs a row stands for as n."""
    size = F.sum("n") if "n" in pairs.columns else F.count("*")
    counts = pairs.where(F.col("d") <= limit).groupBy("d").agg(size.alias("pairs"))
    every = pairs.sparkSession.range(limit + 1).select(F.col("id").cast("int").alias("d"))
    return every.join(counts, "d", "left").select("d", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def ceiling_below_peak(counts: list[int], min_gap: int = MIN_GAP) -> Ceiling:
    """The highest peak's gap to its left; ``counts`` by distance from 0, of which 0 itself is left out."""
    occupied = [d for d in range(1, len(counts)) if counts[d]]
    if not occupied:
        return Ceiling()
    peak = max(occupied, key=lambda d: (counts[d], -d))
    upper = peak
    for lower in [d for d in reversed(occupied) if d < peak]:
        if upper - lower - 1 >= max(1, min_gap):
            return Ceiling(1, peak, lower + 1, upper - lower - 1, upper)
        upper = lower
    return Ceiling(2, peak, 0, 0, occupied[0])


def safe_tau(ceiling: int, margin: float, exact: bool) -> int:
    """The threshold a ceiling allows. The exact search lets the floor of 2 win, the filtered one the ceiling."""
    tau = int((ceiling - 1) * (1.0 - margin))
    return max(2, min(tau, ceiling - 1)) if exact else min(max(2, tau), ceiling - 1)


def counts_of(hist: DataFrame) -> list[int]:
    """The histogram as a list; it has as many rows as distances."""
    return [row["pairs"] for row in hist.orderBy("d").collect()]


def counted_pairs(strings: DataFrame, limit: int, keep: int, theta: int = THETA_MERGE, cap: int | None = BUCKET_CAP) -> DataFrame:
    """(a, b, d, n): the pairs of ``filtered_pairs`` within ``keep`` edits, and beyond it only how many (a, b null)."""
    if cap is None:
        pairs = filtered_pairs(strings, limit, theta, cap)
        near = pairs.where(F.col("d") <= keep).withColumn("n", F.lit(1).cast("long"))
        null = F.lit(None).cast("long")
        return near.unionByName(pairs.where(F.col("d") > keep).groupBy("d").agg(F.count("*").alias("n")).select(null.alias("a"), null.alias("b"), "d", "n"))
    return near_pairs(strings, None, limit, MERGE_ROUNDS, theta, 1, cap, gather=True, counted=keep)


def tau_of(pairs: DataFrame, limit: int, margin: float) -> tuple[Ceiling, int]:
    """The ceiling and threshold of the filtered histogram; 0 where there are fewer than two strings or no pair."""
    found = ceiling_below_peak(counts_of(histogram(pairs, limit)))
    return found, safe_tau(found.ceiling, margin, exact=False) if found.kind else 0


def auto_tau(strings: DataFrame, margin: float = 0.25, theta: int = THETA_MERGE, cap: int | None = BUCKET_CAP) -> tuple[Ceiling, int]:
    """``tau_of`` the filtered pairs, none of which is kept."""
    limit = distance_limit(strings)
    return tau_of(counted_pairs(strings, limit, 0, theta, cap), limit, margin)
