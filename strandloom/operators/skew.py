"""Per-key results over keys of very uneven size.

Rows are range-partitioned on (key, order): Spark samples quantiles of the pair, so a key that owns a third of all rows is
cut into as many partitions as its size calls for. Each partition makes partial states in one sorted pass, and only the
states of keys that cross a boundary need stitching.

Defined results: rows with a null key belong to no key and are left out; null order values are not members; repeated
(key, order) rows count once in ``distinct_sizes`` and each time in ``ordered_positions``; an empty table gives no rows;
other columns are ignored by ``distinct_sizes`` and carried by ``ordered_positions``, where ``position`` and
``__strand_*`` may not be among them (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut_lineage, partitions_for


def range_split(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """Range-partitioned on the pair by sampled quantiles, sorted inside each partition."""
    return df.repartitionByRange(partitions or partitions_for(df.sparkSession), key, order).sortWithinPartitions(key, order)


def distinct_sizes(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """(key, size): the number of different non-null ``order`` values of each non-null key.

    Each task drops the pairs it has seen before any are shuffled, so one repeated very often costs no more than a row a
    task. Equal pairs then fall into the same range; what is shuffled afterwards is one partial count for each key and
    partition.
    """
    pairs = df.select(F.col(key).alias("__key"), F.col(order).alias("__order")).where("__key is not null and __order is not null")
    distinct = range_split(_seen_once(pairs), "__key", "__order", partitions).dropDuplicates(["__key", "__order"])
    return distinct.groupBy("__key").agg(F.count("*").alias("size")).select(F.col("__key").alias(key), "size")


def _seen_once(pairs: DataFrame) -> DataFrame:
    """Different pairs of each batch."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).select(batch.schema.names).to_batches()

    return pairs.mapInArrow(once, pairs.schema)


def ordered_positions(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """Every row with a non-null key plus ``position``: its 1-based rank by ``order`` (nulls first) within its key.

    A window over the key would hold a heavy key in one task. Here each range partition numbers its own rows, and a key
    continued from earlier partitions gets the number of its rows there added. A window over the states makes these offsets;
    there is one state for each key and partition it reaches into, so a key has at most as many as there are partitions.
    """
    if clash := [c for c in df.columns if c == "position" or c.startswith("__strand_")]:
        raise ValueError(f"reserved column names: {clash}")
    ranged = range_split(df.where(F.col(key).isNotNull()), key, order, partitions)
    schema = T.StructType([*ranged.schema.fields, T.StructField("__strand_part", T.IntegerType()), T.StructField("__strand_pos", T.LongType())])
    at = df.columns.index(key)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not len(batch):
                continue
            # rows are sorted by key: each run of one key is numbered from 1, the first goes on from the batch before
            ends = pc.run_end_encode(batch.column(at)).run_ends.to_numpy().astype(np.int64)
            begin = np.r_[0, ends[:-1]]
            carried = count if batch.column(at)[0].as_py() == last else 0
            positions = np.arange(1, len(batch) + 1) - np.repeat(begin, ends - begin)
            positions[: ends[0]] += carried
            last, count = batch.column(at)[-1].as_py(), int(positions[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(positions)], [*batch.schema.names, "__strand_part", "__strand_pos"])

    # read twice below: the ranges must be the same both times, also after a lost executor
    numbered = cut_lineage(ranged.mapInArrow(number, schema))
    states = numbered.groupBy(F.col(key).alias("__strand_key"), F.col("__strand_part").alias("__strand_at")).agg(F.max("__strand_pos").alias("__strand_n"))
    before = F.sum("__strand_n").over(Window.partitionBy("__strand_key").orderBy("__strand_at").rowsBetween(Window.unboundedPreceding, -1))
    offsets = states.withColumn("__strand_before", before).where("__strand_before is not null").drop("__strand_n")
    joined = numbered.join(offsets, (numbered[key] == offsets["__strand_key"]) & (numbered["__strand_part"] == offsets["__strand_at"]), "left")
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__strand_pos") + F.coalesce("__strand_before", F.lit(0))).alias("position"))


def size_mismatches(recorded: DataFrame, members: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cores whose recorded size (``core_id``, ``run_id``, ``sizes``) differs from the number of their members.

    A repeated (core_id, run_id) counts once, with its largest size where repeats disagree; a null size adds nothing.
    """
    sums = (
        recorded.where("core_id is not null").groupBy("core_id", "run_id").agg(F.max("sizes").alias("sizes"))
        .groupBy("core_id").agg(F.coalesce(F.sum(F.col("sizes").cast("long")), F.lit(0)).alias("recorded"))
    )
    true = distinct_sizes(members, "core_id", "member", partitions)
    return (
        sums.join(true, "core_id", "left")
        .select("core_id", "recorded", F.coalesce("size", F.lit(0)).alias("true_size"))
        .where("recorded <> true_size")
    )
