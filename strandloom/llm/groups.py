"""Groups of records linked directly or indirectly.

Each edge partition is reduced to a spanning forest by union-find, so what leaves it is at most one row for each node in it.
A node that lies in several forests picks one of its roots; where it has others, the roots are linked, and these links are
a smaller graph over roots only, which goes through the same step with fewer partitions. Roots are chosen by a hash that
changes each level, so that no order of ids can keep chains from shrinking. When the links fit one bounded partition, one
last forest joins what remains. Levels are written to the checkpoint folder, and groups are read back down the levels.

Defined results: a row with a null end links nothing, nor does a self-link; repeated and reversed links count once; a node
without a link to another node is not in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.hashing import mix
from strandloom.session import cut_lineage

#: Links that one task may hold at once.
BOUND = 1_000_000
#: Levels of forests; each leaves a fraction of the links, so no table needs as many.
MOST_LEVELS = 100


def _order(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x ^ np.int64(seed * 7919)).view(np.int64)


def union_find(u: np.ndarray, v: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each): roots are the nodes of least hash in their component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(_order(nodes, seed), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    a, b = rank[ends[: len(u)]], rank[ends[len(u) :]]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return nodes, nodes[order[parent[rank]]]
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while (parent != (up := parent[parent])).any():
            parent = up


def forests(links: DataFrame, seed: int) -> DataFrame:
    """(node, root, prio) of each partition of (u, v); a partition's links are taken in bounded pieces."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        nodes = roots = np.empty(0, np.int64)

        def fold() -> tuple[np.ndarray, np.ndarray]:
            return union_find(np.concatenate([nodes, *(h[0] for h in held)]), np.concatenate([roots, *(h[1] for h in held)]), seed)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= BOUND:
                nodes, roots = fold()
                held, size = [], 0
        if held:
            nodes, roots = fold()
        prio = _order(roots, seed)
        for at in range(0, len(nodes), 65536):
            cut = slice(at, at + 65536)
            yield pa.RecordBatch.from_pydict({"node": nodes[cut], "root": roots[cut], "prio": prio[cut]})

    return links.mapInArrow(reduce, "node long, root long, prio long")


def link_groups(links: DataFrame, a: str = "a", b: str = "b", bound: int = BOUND) -> DataFrame:
    """(node, group_id) for every node linked to another one; the group id is the smallest node of the group."""
    current = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    picks: list[DataFrame] = []
    count, seed = None, 1
    while count != 0:
        if count is not None:
            current = current.coalesce(1) if count <= bound else current.repartition(-(-count // bound))
        stars = cut_lineage(forests(current, seed))
        pick = stars.groupBy("node").agg(F.min_by("root", F.struct("prio", "root")).alias("picked"))
        picks.append(cut_lineage(pick))
        current = cut_lineage(
            stars.join(picks[-1], "node").where("root <> picked")
            .select(F.least("root", "picked").alias("u"), F.greatest("root", "picked").alias("v")).distinct()
        )
        count, seed = current.count(), seed + 1
        if seed > MOST_LEVELS:
            raise RuntimeError(f"{count} links left after {MOST_LEVELS} levels")
    groups = picks.pop()
    while picks:
        deeper = groups.select(F.col("node").alias("picked"), F.col("picked").alias("deep"))
        groups = picks.pop().join(deeper, "picked", "left").select("node", F.coalesce("deep", "picked").alias("picked"))
    groups = cut_lineage(groups)
    least = groups.groupBy("picked").agg(F.min("node").alias("group_id"))
    return groups.join(least, "picked").select("node", "group_id")
