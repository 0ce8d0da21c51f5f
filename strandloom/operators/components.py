"""Connected components, and what is read off them.

Stars are rewritten towards their smallest node until nothing changes: every node first links its larger neighbours to the
smallest one it sees, then its smaller ones. Both steps are joins on a minimum that is aggregated partly before the
shuffle; each round is written to the checkpoint folder.

Defined results: nodes without an edge are their own component; a null end links nothing; repeated, reversed and self edges
change nothing; the label is the smallest node; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import ordered_positions
from strandloom.session import cut_lineage

#: Rounds are about the square of the logarithm of a component's size; twice what any table can need.
MOST_ROUNDS = 200


def _largest(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; edges run from larger to smaller here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of all nodes with an edge to another one."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    current = cut_lineage(links)
    before = None
    for _ in range(MOST_ROUNDS):
        current = cut_lineage(_smallest(_largest(current)))
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def labels(nodes: DataFrame, edges: DataFrame, node: str = "idx") -> DataFrame:
    """(node, label) of every given node, alone or not."""
    found = components(edges)
    return nodes.select(node).join(found.withColumnRenamed("node", node), node, "left").select(node, F.coalesce("label", node).alias("label"))


def cores(labelled: DataFrame) -> DataFrame:
    """(core, idx) of the components with two members or more."""
    several = labelled.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return labelled.join(several, "label").select(F.col("label").alias("core"), "idx")


def orphans(labelled: DataFrame) -> DataFrame:
    """(idx) of the components of one."""
    return labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).where("n = 1").select("idx")


def coverage(labelled: DataFrame) -> DataFrame:
    """(core_count, orphan_count, frac_reads_in_cores)."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    total = F.count_if(F.col("n") > 0)
    return sizes.agg(
        F.count_if(F.col("n") > 1).alias("core_count"), F.count_if(F.col("n") == 1).alias("orphan_count"),
        F.when(total > 0, F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).otherwise(F.lit(0.0)).alias("frac_reads_in_cores"),
    )


def canonical(labelled: DataFrame, label: str = "label") -> DataFrame:
    """(idx, cluster): clusters numbered from 0 by their smallest member, without a global window."""
    smallest = labelled.groupBy(label).agg(F.min("idx").alias("least"))
    ranked = ordered_positions(smallest.withColumn("__one", F.lit(0)), "__one", "least").select(label, (F.col("position") - 1).alias("cluster"))
    return labelled.join(ranked, label).select("idx", "cluster")


def partition_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(different): rows whose canonical cluster differs between two labellings (idx, label) of the same rows."""
    a, b = canonical(left), canonical(right).withColumnRenamed("cluster", "other")
    return a.join(b, "idx", "full").agg(F.count_if(~F.col("cluster").eqNullSafe(F.col("other"))).alias("different"))
