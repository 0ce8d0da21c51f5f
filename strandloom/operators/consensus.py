"""One consensus string for each core, by votes of all its members against its medoid.

Defined results: the medoid is taken among the ``SAMPLE`` smallest members, ties to the smallest read; a symbol that is no
base casts no substitution vote; a column is dropped only by a strict majority of deletions, an inserted text is taken only
by a strict majority; ties between bases go to the first in A, C, G, T; a column without a vote keeps the medoid's symbol;
an empty table gives no rows; a consensus can be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.distance import DEL, INS, SUB, align_many, exact_distance

SAMPLE = 64
BASES = [ord(b) for b in "ACGT"]


def medoid_sample(cores: DataFrame, reads: DataFrame) -> DataFrame:
    """(core, idx, read): the smallest members of each core. Spark limits each group before the shuffle, too."""
    nth = F.row_number().over(Window.partitionBy("core").orderBy("idx"))
    few = cores.withColumn("__n", nth).where(F.col("__n") <= SAMPLE).select("core", "idx")
    return few.join(reads.select("idx", "read"), "idx").select("core", "idx", "read")


def medoids(sample: DataFrame) -> DataFrame:
    """(core, medoid, total): the member with the least sum of exact distances to the sample; at most 64 x 63 / 2 pairs."""
    left, right = sample.select("core", F.col("idx").alias("a"), F.col("read").alias("x")), sample.select("core", F.col("idx").alias("b"), F.col("read").alias("y"))
    pairs = left.join(right, "core").where("a < b").select("core", "a", "b", exact_distance("x", "y").alias("d"))
    sums = pairs.select("core", F.explode(F.array("a", "b")).alias("idx"), "d").groupBy("core", "idx").agg(F.sum("d").alias("total"))
    best = sums.groupBy("core").agg(F.min(F.struct("total", "idx")).alias("m")).select("core", F.col("m.idx").alias("idx"), F.col("m.total").alias("total"))
    return best.join(sample.select("core", "idx", "read"), ["core", "idx"]).select("core", F.col("read").alias("medoid"), "total")


def _inserted(core: np.ndarray, pair: np.ndarray, tag: np.ndarray, pos: np.ndarray, ch: np.ndarray) -> pd.DataFrame:
    """(core, pos, kind, ch): what one pair inserts before one place is one text."""
    at = np.flatnonzero(tag == INS)
    new = np.flatnonzero(np.r_[True, (pair[at][1:] != pair[at][:-1]) | (pos[at][1:] != pos[at][:-1])]) if len(at) else at
    letters = "".join(map(chr, ch[at].tolist()))
    texts = [letters[x:y] for x, y in zip(new.tolist(), [*new[1:].tolist(), len(letters)])]
    return pd.DataFrame({"core": core[at[new]], "pos": pos[at[new]], "kind": "I", "ch": texts})


def votes(cores: DataFrame, reads: DataFrame, centres: DataFrame) -> DataFrame:
    """(core, pos, kind, ch, n): members' votes, kind B for a base, D for a deletion, I for an inserted text before pos.

    Votes are summed for the members of one batch first and for the partition next, so a core with a third of all reads
    sends no more rows than its medoid has columns.
    """
    members = cores.join(reads.select("idx", "read"), "idx").join(centres.select("core", "medoid"), "core").select("core", "medoid", "read")

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pair, tag, pos, ch = align_many(batch["medoid"].tolist(), batch["read"].tolist())
            core = batch["core"].to_numpy()[pair]
            base = (tag <= SUB) & np.isin(ch, BASES)
            plain = pd.DataFrame({"core": core, "pos": pos, "kind": np.where(tag == DEL, "D", "B"), "ch": ch})[base | (tag == DEL)]
            plain = plain.groupby(["core", "pos", "kind", "ch"], as_index=False).size()
            plain["ch"] = [chr(c) if c else "" for c in plain["ch"]]
            inserted = _inserted(core, pair, tag, pos, ch)
            yield pd.concat([plain, inserted.groupby(["core", "pos", "kind", "ch"], as_index=False).size()]).rename(columns={"size": "n"})

    return members.mapInPandas(cast, "core long, pos int, kind string, ch string, n long").groupBy("core", "pos", "kind", "ch").agg(F.sum("n").alias("n"))


def column_votes(cast: DataFrame) -> DataFrame:
    """(core, pos, a, c, g, t, del): one row for each column with a base or deletion vote."""
    count = lambda kind, ch: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("ch") == ch), F.col("n"))), F.lit(0))
    return cast.where("kind <> 'I'").groupBy("core", "pos").agg(*[count("B", b).alias(b.lower()) for b in "ACGT"], count("D", "").alias("del"))


def insertion_votes(cast: DataFrame) -> DataFrame:
    """(core, pos, text, n)."""
    return cast.where("kind = 'I'").select("core", "pos", F.col("ch").alias("text"), "n")


def consensus(cores: DataFrame, centres: DataFrame, cast: DataFrame) -> DataFrame:
    """(core, medoid, cons, size)."""
    sizes = cores.groupBy("core").agg(F.count("*").alias("size"))
    base = centres.select("core", "medoid").join(sizes, "core")
    columns = base.where(F.length("medoid") > 0).select("core", "medoid", "size", F.explode(F.sequence(F.lit(0), F.length("medoid") - 1)).alias("pos"))
    most = F.greatest("a", "c", "g", "t")
    base_at = F.when(most.isNull() | (most == 0), F.expr("substring(medoid, pos + 1, 1)")).when(F.col("a") == most, "A").when(F.col("c") == most, "C").when(F.col("g") == most, "G").otherwise("T")
    kept = columns.join(column_votes(cast), ["core", "pos"], "left").select("core", F.col("pos"), F.lit(1).alias("part"), F.when(2 * F.coalesce("del", F.lit(0)) > F.col("size"), "").otherwise(base_at).alias("out"))
    inserted = insertion_votes(cast).join(sizes, "core").where(2 * F.col("n") > F.col("size")).select("core", "pos", F.lit(0).alias("part"), F.col("text").alias("out"))
    joined = kept.unionByName(inserted).groupBy("core").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "out"))), lambda x: x["out"]), "").alias("cons"))
    return base.join(joined, "core", "left").select("core", "medoid", F.coalesce("cons", F.lit("")).alias("cons"), "size")


def dissent(cores: DataFrame, reads: DataFrame, centres: DataFrame) -> DataFrame:
    """(core, pos, kind, ch, n): as ``votes``, but only what differs from the medoid; kind N for a symbol that is no base.

    In each column of a medoid each member agrees or has one row's vote here, so the votes that agree, which are nearly all,
    need not be sent.
    """
    members = cores.join(reads.select("idx", "read"), "idx").join(centres.select("core", "medoid"), "core").where("read <> medoid").select("core", "medoid", "read")

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pair, tag, pos, ch = align_many(batch["medoid"].tolist(), batch["read"].tolist())
            core = batch["core"].to_numpy()[pair]
            at = np.flatnonzero((tag == SUB) | (tag == DEL))
            base = np.isin(ch[at], BASES) & (tag[at] == SUB)
            plain = pd.DataFrame({"core": core[at], "pos": pos[at], "kind": np.where(base, "B", np.where(tag[at] == DEL, "D", "N")), "ch": [chr(c) if c else "" for c in np.where(base, ch[at], 0).tolist()]})
            yield pd.concat([plain, _inserted(core, pair, tag, pos, ch)]).groupby(["core", "pos", "kind", "ch"], as_index=False).size().rename(columns={"size": "n"})

    return members.mapInPandas(cast, "core long, pos int, kind string, ch string, n long").groupBy("core", "pos", "kind", "ch").agg(F.sum("n").alias("n"))


def amended(cores: DataFrame, reads: DataFrame, centres: DataFrame) -> DataFrame:
    """(core, medoid, cons, size): what ``consensus`` makes of ``votes``, from the votes against the medoid alone. A column
    without one keeps the medoid's symbol, so only the changed places are gathered."""
    base = centres.select("core", "medoid").join(cores.groupBy("core").agg(F.count("*").alias("size")), "core")
    count = lambda kind, ch="": F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("ch") == ch), F.col("n"))), F.lit(0))
    against = F.coalesce(F.sum(F.when(F.col("kind") != "I", F.col("n"))), F.lit(0)).alias("against")
    places = dissent(cores, reads, centres).groupBy("core", "pos").agg(
        *[count("B", b).alias(b.lower()) for b in "ACGT"], count("D").alias("del"), against, F.max(F.when(F.col("kind") == "I", F.struct("n", "ch"))).alias("new")
    )
    own = F.expr("substring(medoid, pos + 1, 1)")
    total = {b: F.col(b.lower()) + F.when(own == b, F.col("size") - F.col("against")).otherwise(0) for b in "ACGT"}
    most = F.greatest(*total.values())
    voted = F.when(2 * F.col("del") > F.col("size"), "").when(most == 0, own).when(total["A"] == most, "A").when(total["C"] == most, "C").when(total["G"] == most, "G").otherwise("T")
    change = lambda part, out: F.struct(F.col("pos"), F.lit(part).alias("part"), out.alias("out"))
    changes = F.array(F.when(2 * F.col("new.n") > F.col("size"), change(0, F.col("new.ch"))), F.when((F.col("against") > 0) & (voted != own), change(1, voted)))
    changed = places.join(base, "core").select("core", F.explode(F.array_compact(changes)).alias("c")).groupBy("core").agg(F.array_sort(F.collect_list("c")).alias("changes"))
    made = F.expr("""aggregate(changes, struct('' as text, 0 as at), (s, c) -> struct(s.text || substring(medoid, s.at + 1, c.pos - s.at) || c.out as text, c.pos + c.part as at),
        s -> s.text || substring(medoid, s.at + 1))""")
    return base.join(changed, "core", "left").select("core", "medoid", F.coalesce(made, "medoid").alias("cons"), "size")
