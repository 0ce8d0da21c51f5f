"""Mixing sources to target shares of all tokens.

Tokens are counted with a public tokenizer, whose file is a parameter and is sent to the executors. The total is cut into
equal-token blocks, which are given to the sources by the highest Sainte-Lague quotient; a source takes no more blocks than
its tokens, used ``max_repeats`` times, can fill, and blocks are small enough that the smallest source with tokens fills
several. A source that is given all the blocks it can fill is exhausted: all its messages are used as often as they may be. A
source falls short only if the quotas exhaust it, and its tokens settle whether it does. The blocks of any other source are apportioned to its shards
in the same way. Inside a shard the messages stand in a seeded order by their running token count; the tokens of the
shard's blocks give whole rounds over the shard first and the leading messages of the next round.

Defined results: a null text has no tokens; a source without messages gets nothing and is short; a source without a target
is left out; a null source belongs to no target; repeated target rows of a source count once, the one with the largest
share; a null ``max_repeats`` counts as 1; ties between quotients go to the source earlier in binary order; empty tables
give no rows or shares of 0.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of this length or more is encoded apart from its text: the pattern would be matched by recursion over it.
RUN = 100_000
_SPACE = r"[ \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(f"{_SPACE}{{{RUN},}}")
#: Messages of a shard, and the blocks it should hold at least, so that what a block's border cuts weighs little.
SHARD_ROWS, SHARD_BLOCKS = 20_000, 64
#: Blocks that the smallest source with tokens fills at least.
LEAST_BLOCKS = 8


@lru_cache(1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str | None) -> int:
    """The number of tokens of a whole text, long white space included."""
    if not text:
        return 0
    total, at = 0, 0
    for run in _LONG.finditer(text) if len(text) >= RUN else ():
        end = run.end() - (run.end() < len(text))  # the last one goes with what follows
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end].encode()))
        at = end
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns plus ``tokens``; the texts themselves go no further."""
    keep = keep or []
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    df.sparkSession.sparkContext.addFile(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(os.path.basename(tokenizer)))
        for batch in batches:
            tokens = [count_tokens(encoding, t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(tokens, pa.int64())], [*keep, "tokens"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "tokens long"])
    return source.mapInArrow(count, fields)


def highest_quotients(weight: np.ndarray, cap: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each row by the highest weight / (2 n + 1), ties to the earlier row. Bisection finds a quotient that no more
    than ``seats`` seats lie above, and only the few left are given one by one, so the work grows with rows, not with seats."""
    cap = np.where(weight > 0, np.maximum(cap, 0), 0)
    seats = min(int(seats), int(cap.sum()))

    def above(quotient: float) -> np.ndarray:
        return np.minimum(cap, np.ceil(np.maximum(weight / quotient - 1, 0) / 2).astype(np.int64))

    high = float(weight.max(initial=0.0)) * 2 or 1.0
    low = high / (4 * max(int(cap.max(initial=0)), 1) + 4) * (float(weight[cap > 0].min(initial=high)) / high)
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (low, middle) if above(middle).sum() <= seats else (middle, high)
    given = above(high)
    heap = [(-weight[i] / (2 * given[i] + 1), i) for i in np.flatnonzero(given < cap)]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        i = heap[0][1]
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heapreplace(heap, (-weight[i] / (2 * given[i] + 1), i))
        else:
            heapq.heappop(heap)
    return given


def apportion(claims: DataFrame, key: list[str], within: list[str], seats: str) -> DataFrame:
    """``claims`` plus ``quota``: ``seats`` blocks go to the rows of each ``within`` by the highest weight / (2 n + 1).

    ``claims`` has ``weight`` and ``cap``, the most blocks a row can take. There is a row here for a source or a shard of
    many messages, never one for a message or a block.
    """
    schema = T.StructType([claims.schema[c] for c in [*within, *key]] + [T.StructField("quota", T.LongType())])

    def give(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        quota = highest_quotients(rows["weight"].fillna(0).to_numpy(np.float64), rows["cap"].fillna(0).to_numpy(np.int64), rows[seats].iloc[0])
        return rows[[*within, *key]].assign(quota=quota)

    given = claims.select(*within, *key, "weight", "cap", seats).groupBy(*within).applyInPandas(give, schema)
    return claims.join(given, [*within, *key], "left").select(*claims.columns, F.coalesce("quota", F.lit(0)).alias("quota"))


def shares(counted: DataFrame, targets: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row for each target source: its tokens, its capacity and the blocks it can fill, the blocks given, whether these
    exhaust it, and whether it falls short of its share.

    ``counted`` is (source, tokens). Only sums by source are gathered. There are 10,000 blocks or, where that is more, as
    many as give each shard of ``SHARD_ROWS`` messages ``SHARD_BLOCKS`` of them and the smallest source ``LEAST_BLOCKS``.

    The quotas exhaust every short source: with ``n`` sources a quota lies at most (n + 1) / 2 blocks below its exact share,
    which caps of other sources only raise, and a short source can fill less than that share.
    """
    held = cut_lineage(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))  # read twice, tokens are counted once
    goals = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", "g.*")
    claims = goals.join(held, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    claims = claims.withColumn("capacity", F.col("tokens") * F.coalesce("max_repeats", F.lit(1)))
    total, rows = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    least, count, goal = claims.agg(F.min(F.when(F.col("capacity") > 0, F.col("capacity"))), F.count("*"), F.coalesce(F.sum("target_share"), F.lit(0.0))).first()
    blocks = blocks or max(10_000, rows * SHARD_BLOCKS // SHARD_ROWS)
    block = max(1, min(-(-total // blocks), (least or total) // LEAST_BLOCKS))
    claims = (
        claims.withColumn("total", F.lit(total).cast("long")).withColumn("block", F.lit(block).cast("long")).withColumn("cap", F.ceil(F.col("capacity") / F.col("block")))
        .withColumn("weight", F.col("target_share")).withColumn("seats", F.lit(int(total * max(goal, 1.0)) // block).cast("long")).withColumn("whole", F.lit(1))
    )
    quotas = apportion(claims, ["source"], ["whole"], "seats").withColumn("exhausted", F.col("quota") + (count + 1) // 2 >= F.col("cap"))
    return quotas.select("source", "target_share", "max_repeats", "tokens", "capacity", "total", "block", "cap", "quota", "exhausted", (F.col("exhausted") & (F.col("capacity") < F.col("target_share") * F.col("total"))).alias("short"))


def select_blocks(counted: DataFrame, plan: DataFrame, seed: int = 7, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, source, tokens, times): how often each message is used, for those used at least once.

    A shard holds about ``shard_rows`` messages of one source and ``SHARD_BLOCKS`` blocks at least, so a source with a third
    of all messages is spread over as many tasks as it needs. The messages whose middle token lies within the tokens of the
    shard's last round are used once more. ``counted`` is (doc_id, source, tokens).
    """
    repeats = F.coalesce("max_repeats", F.lit(1))
    given = plan.where("quota > 0").withColumn("max_repeats", repeats)
    whole = counted.join(given.where("quota >= cap").select("source", "max_repeats"), "source").where("tokens > 0").select("doc_id", "source", "tokens", F.col("max_repeats").cast("int").alias("times"))
    rows = counted.groupBy("source").agg(F.ceil(F.count("*") / shard_rows).alias("by_rows"), F.sum("tokens").alias("held"))
    by_tokens = F.floor(F.col("held") / (F.col("block") * SHARD_BLOCKS))
    goals = given.where("quota < cap").join(rows, "source").select("source", "block", "quota", "max_repeats", F.greatest(F.lit(1), F.least("by_rows", by_tokens)).alias("shards"))
    placed = counted.where("tokens > 0").join(goals, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))
    sizes = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("weight"), F.first("block").alias("block"), F.first("quota").alias("seats"), F.first("max_repeats").alias("most"))
    sizes = sizes.withColumn("cap", F.ceil(F.col("weight") * F.col("most") / F.col("block")))
    wanted = F.least(F.col("quota") * F.col("block"), F.col("weight") * F.col("most"))
    quotas = apportion(sizes, ["shard"], ["source"], "seats").select("source", "shard", F.floor(wanted / F.col("weight")).alias("rounds"), (wanted % F.col("weight")).alias("rest"))
    running = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    chosen = placed.withColumn("middle", F.coalesce(running, F.lit(0)) + F.col("tokens") / 2).join(quotas, ["source", "shard"])
    times = F.col("rounds") + F.when(F.col("middle") < F.col("rest"), 1).otherwise(0)
    return chosen.select("doc_id", "source", "tokens", times.cast("int").alias("times")).where("times > 0").unionByName(whole)


def reached(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """``plan`` plus ``used``, the tokens of the messages chosen, and ``share``, what they are of all tokens chosen."""
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"))
    both = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    mixed = F.sum("used").over(Window.partitionBy(F.lit(1)))  # one row for each source
    return both.withColumn("share", F.coalesce(F.try_divide("used", mixed), F.lit(0.0)))
