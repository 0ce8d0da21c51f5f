"""Most frequent items in bounded memory.

Every partition keeps a space-saving summary of at most ``capacity`` counters, each with the largest error it may hold, and
the weight of all its rows. The summaries are merged in a tree of ``FAN_IN``; an item outside the final one occurs at most
``floor`` times. A second pass over the data counts the surviving candidates exactly; there are no other passes.

Defined results: a null item belongs to no counter but its weight counts in the total; a null weight counts as 1; repeated
rows count each time; ties at the threshold are all returned; an empty table gives no rows; other columns are ignored. If
the capacity proves too small for the threshold the summary is made again with four times as many counters, up to
``MOST_CAPACITY``; a share that would need more raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut_lineage

FAN_IN = 16
#: Counters of a summary; ``FAN_IN`` of them meet in one task.
MOST_CAPACITY = 200_000
#: Candidates up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST = 20_000
_SCHEMA = "part int, item string, n long, err long, floor long"


def merge(a: pd.DataFrame, floor_a: int, b: pd.DataFrame, floor_b: int, capacity: int) -> tuple[pd.DataFrame, int]:
    """One summary of both; frames are indexed by item with columns n (upper bound) and err (n - err is a lower bound)."""
    both = a.join(b, how="outer", lsuffix="_a", rsuffix="_b")
    n = both["n_a"].fillna(floor_a) + both["n_b"].fillna(floor_b)
    err = both["err_a"].fillna(floor_a) + both["err_b"].fillna(floor_b)
    out = pd.DataFrame({"n": n, "err": err}, dtype="int64")
    if len(out) <= capacity:
        return out, floor_a + floor_b
    out = out.sort_values("n", ascending=False, kind="stable")
    return out.iloc[:capacity].sort_index(), max(floor_a + floor_b, int(out["n"].iloc[capacity]))


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"n": pd.Series(dtype="int64"), "err": pd.Series(dtype="int64")}, index=pd.Index([], dtype=object))


def _summaries(weighted: DataFrame, capacity: int) -> DataFrame:
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, floor, total = _empty(), 0, 0
        for batch in batches:
            total += pc.sum(batch.column(1)).as_py() or 0
            sums = pa.Table.from_batches([batch.filter(batch.column(0).is_valid())]).group_by("item").aggregate([("w", "sum")])
            exact = pd.DataFrame({"n": sums["w_sum"].to_numpy(), "err": 0}, index=pd.Index(sums["item"].to_pylist(), dtype=object))
            kept, floor = merge(kept, floor, exact, 0, capacity)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "item": pa.array([None], pa.string()), "n": [total], "err": [0], "floor": [0]})
        if len(kept):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(kept), pa.int32()), "item": pa.array(kept.index, pa.string()), "n": kept["n"].to_numpy(), "err": kept["err"].to_numpy(), "floor": pa.array([floor] * len(kept), pa.int64())})

    return weighted.mapInArrow(summarize, _SCHEMA)


def summary(weighted: DataFrame, capacity: int) -> DataFrame:
    """One merged summary (item, n, err, floor) of rows (item, w); n of the null item is the weight of all rows."""
    parts = _summaries(weighted, capacity)
    count = max(1, weighted.rdd.getNumPartitions())

    def merge_group(rows: pd.DataFrame) -> pd.DataFrame:
        kept, floor, counters = _empty(), 0, rows["item"].notna()
        for _, one in rows[counters].groupby("part"):
            kept, floor = merge(kept, floor, one.set_index("item")[["n", "err"]], int(one["floor"].iloc[0]), capacity)
        whole = pd.DataFrame({"item": [None], "n": [rows.loc[~counters, "n"].sum()], "err": [0], "floor": [0]})
        merged = pd.DataFrame({"item": kept.index.to_numpy(object), "n": kept["n"].to_numpy(), "err": kept["err"].to_numpy(), "floor": floor})
        return pd.concat([whole, merged]).assign(part=int(rows["part"].iloc[0]) // FAN_IN)[["part", "item", "n", "err", "floor"]]

    while count > 1:
        parts = parts.groupBy((F.col("part") / F.lit(FAN_IN)).cast("int")).applyInPandas(merge_group, _SCHEMA)
        count = -(-count // FAN_IN)
    return parts.select("item", "n", "err", "floor")


def frequent_items(df: DataFrame, item: str, weight: Column | None = None, share: float = 1 / 250, capacity: int | None = None) -> DataFrame:
    """(item, total, upper, lower, share) of every item whose weight is at least ``share`` of the weight of all rows.

    ``upper`` and ``lower`` are the bounds of the first pass, ``total`` is exact. The candidates are at most ``capacity``
    rows, by default eight times the number of items that can reach the share, and are broadcast up to ``BROADCAST`` of them.
    """
    weight = F.lit(1) if weight is None else weight
    weighted = df.select(F.col(item).cast("string").alias("item"), F.coalesce(weight.cast("long"), F.lit(1).cast("long")).alias("w"))
    capacity = min(capacity or max(64, int(8 / share)), MOST_CAPACITY)
    while True:
        kept = cut_lineage(summary(weighted, capacity))
        total, floor = kept.agg(F.coalesce(F.max(F.when(F.col("item").isNull(), F.col("n"))), F.lit(0)), F.coalesce(F.max("floor"), F.lit(0))).first()
        need = max(1, -(-total * round(share * 1e12) // 10**12))
        if floor < need:
            break
        if capacity == MOST_CAPACITY:
            raise ValueError(f"a share of {share} needs more than {MOST_CAPACITY} counters")
        capacity = min(4 * capacity, MOST_CAPACITY)
    found = kept.where(F.col("item").isNotNull() & (F.col("n") >= need)).select("item", F.col("n").alias("upper"), (F.col("n") - F.col("err")).alias("lower"))
    exact = weighted.join(F.broadcast(found) if capacity <= BROADCAST else found, "item").groupBy("item").agg(F.sum("w").alias("total"), F.first("upper").alias("upper"), F.first("lower").alias("lower"))
    return exact.where(F.col("total") >= need).select(F.col("item").alias(item), "total", "upper", "lower", (F.col("total") / F.lit(max(total, 1))).alias("share"))
