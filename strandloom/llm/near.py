"""Pairs of texts that differ by a few small edits, by PartEnum signatures.

A text is the set of its ``q``-grams. The domain of grams is partitioned by a hash into groups, and each group into
``SUBSETS`` parts; a signature is the projection of a text onto all parts of a group but one. ``d`` edits change at most
``2 q d`` grams, so most groups are hit by at most one change, and leaving out the part it falls into gives both texts the
same signature. The number of groups follows the band of sizes a text falls into, near an edge it takes part in both bands,
and independent partitionings are drawn until a text has ``ENOUGH`` signatures, or more if much of it is hot. A signature must hold two grams or more that
reach over ``MIN_SPAN`` further places, so that it is specific; this is what may lose a pair, and README gives the share by
length and hot part. Of long texts, which fill far more groups than needed, signatures are taken by their hash.

Grams in more than ``hot_share`` of all texts (counted over all of them, in bins that grow with the length of the texts)
name no text and are left out, unless that would leave less than half of a text. Signatures travel to their buckets as
packed arrays; a bucket is sorted once and gives its pairs; a signature counted as large is cut into slices that meet two by
two over tasks; each pair is then verified by exact edit distance. Texts under ``SHORT`` characters are too short for
signatures; a join on their pieces finds all their pairs. Buckets and partitions are as many as the texts call for.

Defined results: a null text takes no part; equal texts are one class, whose id is the smallest (``text_classes`` gives the
members), and pairs are given between classes; case matters; the empty text is a short text; an empty table gives no rows;
other columns are ignored; a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.distance import distances_within
from strandloom.llm.hashing import from_planes, mix, pack_texts, planes, unpack_texts
from strandloom.session import cut_lineage, partitions_for

#: Bins that grams are counted in, as a power of two, for texts of about 100 characters; longer ones get more, up to the second.
BINS_BITS, MOST_BITS = 18, 22
#: A bin is hot only above this many times the load of an average bin, however long the texts are.
OVER_AVERAGE = 4
#: Signatures a text draws for, and the draws it may take. Edits that gather in the cold part of a text leave few of its
#: signatures, so a text draws for more the more of it is hot, and few groups fill there in a draw.
ENOUGH, MOST_DRAWS = 40, 48
#: Parts of a group; a signature leaves out one.
SUBSETS = 3
#: Groups for a character of a band: the more there are, the fewer grams a signature holds, and the likelier it survives.
GROUPS = 4
#: Signatures a group gives in a draw, for random texts: a measured figure.
FILLED = 0.04
MIN_SPAN = 8
#: Groups up to which grams are counted by group before they are sorted.
DENSE_GROUPS = 1 << 22
#: Characters worked on at a time, so that the arrays of a step stay in the processor's cache.
PIECE_CHARS = 50_000
SHORT = 96
ENTRIES_PER_BUCKET = 300_000
#: Bytes of input, as Spark plans it, for one partition of the texts.
TEXT_BYTES = 4 << 20
_MULTIPLIER = np.uint64(1099511628211)
#: Entries of a slice: a signature of more than two slices is cut, and its slices meet two by two, each two in a group.
SLICE = 2048
#: Texts up to which signatures are counted over all of them; one in ``SAMPLED`` beyond. At most ``MOST_LARGE`` signatures are cut.
COUNTED, SAMPLED, MOST_LARGE = 20_000, 64, 200_000
#: Entries a batch repeats for slices before it sends them.
REPEATED = 2_000_000
#: Pairs of a task among which repeated ones are dropped.
HELD = 2_000_000
_SIGNATURE = "bucket long, sigs binary, ids binary"
#: Bits of a packed signature that hold where it begins, in steps of two places modulo 128, and how far it reaches, in steps
#: of four modulo 128; what lies farther apart than the edits can move it is no pair of this signature.
PLACE_BITS, SPAN_BITS = 6, 5


def bands(length: int, slack: int) -> set[int]:
    """Lower edges of the size bands a text belongs to; the edge is also the band's number of groups."""
    edges = set()
    for size in (length, length + slack):
        edge = SHORT
        while edge + edge // 2 <= size:
            edge += edge // 2
        edges.add(edge)
    return edges


def grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every gram of every text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = max(0, len(codes) - q + 1)
    hashed = np.zeros(width, np.uint64)
    for j in range(q):
        hashed = hashed * _MULTIPLIER + codes[j : j + width]
    owner = np.repeat(np.arange(len(texts)), lengths)[:width]
    place = np.arange(width) - (np.cumsum(lengths) - lengths)[owner]
    whole = place <= lengths[owner] - q
    return mix(hashed[whole]), owner[whole], place[whole]


def _projections(hashed: np.ndarray, owner: np.ndarray, place: np.ndarray, groups: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, place code) of one partitioning: each group without one of its parts, where the rest is specific.
    What two subsets of a group have in common when a part is empty is given once."""
    base = np.cumsum(groups) - groups
    x = mix(hashed ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64))
    if len(groups) and (groups == groups[0]).all():  # one band, nearly always: division by one number is much faster
        first, parts = owner * (groups[0] * SUBSETS), np.uint64(groups[0] * SUBSETS)
    else:
        first, parts = base[owner] * SUBSETS, (groups[owner] * SUBSETS).astype(np.uint64)
    cell = first + (x - x // parts * parts).astype(np.int64)
    # a gram alone in its group, as most are, gives no signature
    met = np.flatnonzero((np.bincount(group := cell // SUBSETS) > 1)[group]) if int(groups.sum()) <= DENSE_GROUPS else np.arange(len(cell))
    order = np.sort((cell[met] << 32) | met)  # by cell, places ascending
    cell, at = order >> 32, order & 0xFFFFFFFF
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    end = np.r_[begin, len(cell)][1:]
    sums = np.add.reduceat(mix(x[at]), begin) if len(begin) else np.empty(0, np.uint64)
    first, last, group = place[at[begin]], place[at[end - 1]], cell[begin] // SUBSETS
    filled = np.bincount(group)[group] if len(group) else group
    single = np.flatnonzero((end - begin >= 2) & (filled < SUBSETS))
    pairs = [(k, k + step) for step in range(1, SUBSETS) if len(k := np.flatnonzero(group[step:] == group[:-step]))]
    one, two = (np.concatenate([single, *(p[i] for p in pairs)]) for i in (0, 1))
    low, high = np.minimum(first[one], first[two]), np.maximum(last[one], last[two])
    wide = high - low >= MIN_SPAN
    one, two, low, high = one[wide], two[wide], low[wide], high[wide]
    text = np.searchsorted(base, group[one], "right") - 1
    label = mix((group[one] - base[text]).astype(np.uint64) | (groups[text].astype(np.uint64) << np.uint64(24)) | np.uint64(salt << 52))
    return mix((sums[one] + np.where(one == two, np.uint64(0), sums[two])) ^ label), text, ((low >> 1) % (1 << PLACE_BITS) << SPAN_BITS | ((high - low) >> 2) % (1 << SPAN_BITS)).astype(np.int32)


def _signatures(hashed: np.ndarray, owner: np.ndarray, place: np.ndarray, groups: np.ndarray, enough: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, place code); ``groups`` by text. A text takes part in partitionings until it has ``enough``
    signatures; near texts stop at about the same one, and share those of the fewer partitionings."""
    count, seen = np.zeros(len(groups), np.int64), np.arange(len(groups))
    sigs, texts, codes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for draw in range(MOST_DRAWS):
        left = count[seen] < enough[seen]
        if draw and not left.all():
            mine, number = left[owner], np.cumsum(left) - 1
            hashed, owner, place = hashed[mine], number[owner[mine]], place[mine]
            seen, groups = seen[left], groups[left]
        if not len(owner):
            break
        sig, text, code = _projections(hashed, owner, place, groups, draw * 2 + mode)
        rate = np.minimum(1.0, 2 * ENOUGH / (FILLED * groups))[text]
        if (rate < 1).any():
            kept = (mix(sig ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) < rate * 2.0**53
            sig, text, code = sig[kept], text[kept], code[kept]
        sigs.append(sig)
        texts.append(seen[text])
        codes.append(code)
        count[seen] += np.bincount(text, minlength=len(seen))
    return np.concatenate(sigs), np.concatenate(texts), np.concatenate(codes)


def part_enum(texts: list[str], hot: np.ndarray, q: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the text, place code) of all signatures of some texts; ``hot`` says which gram bins are."""
    pieces = np.searchsorted(np.cumsum([0, *map(len, texts)]), np.arange(0, sum(map(len, texts)) + 1, PIECE_CHARS)).tolist()
    pieces = sorted({*pieces, len(texts)} - {0})
    parts = [_part_enum(texts, begin, end, hot, q, slack) for begin, end in zip([0, *pieces], pieces)]
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))


def _part_enum(texts: list[str], begin: int, end: int, hot: np.ndarray, q: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chosen = [(i, n) for i in range(begin, end) if len(texts[i]) >= SHORT for n in bands(len(texts[i]), slack)]
    index, groups = np.array([i for i, _ in chosen], np.int64), np.array([GROUPS * n for _, n in chosen], np.int64)
    hashed, owner, place = grams([texts[i] for i in index], q)
    cold = ~hot[(hashed >> np.uint64(65 - len(hot).bit_length())).astype(np.int64)]
    named, whole = np.bincount(owner[cold], minlength=len(groups)), np.bincount(owner, minlength=len(groups))
    enough = ENOUGH * (2 - named / np.maximum(whole, 1)) ** 1.5
    sigs, text, codes = _signatures(hashed[cold], owner[cold], place[cold], groups, enough, 0)
    few = 2 * named < whole
    if few.any():
        own = few[owner]
        more = _signatures(hashed[own], owner[own], place[own], groups, np.full(len(groups), ENOUGH), 1)
        sigs, text, codes = (np.concatenate(pair) for pair in zip((sigs, text, codes), more))
    return sigs, index[text], codes


def text_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id): the class of a text is the smallest id that has it."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.join(rows.groupBy("text").agg(F.min("id").alias("class_id")), "text").select("id", "class_id").distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pack_texts(batch.column(1)), batch.column(2)], ["id", "text", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), unpack_texts(batch.column(1))], ["id", "text"])


def bins_for(length: float) -> int:
    """The number of gram bins, as a power of two, for texts of this mean length."""
    return int(min(MOST_BITS, BINS_BITS + max(0, np.ceil(np.log2(max(length, 1) / 128)))))


def hot_bins(texts: DataFrame, q: int, least: float, bits: int, known: int) -> np.ndarray:
    """Which of the 2^bits gram bins ``least`` grams or more fall into; at most as many as bins reach the driver. A task
    reports the bins that hold a quarter or more of its texts' share of ``least``; bins found with three quarters of it are
    hot, so none with all of it is missed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            seen += len(batch)
            hashed, _, _ = grams([t for t in unpack_texts(batch.column(0)).to_pylist() if len(t) >= q], q)
            counts += np.bincount((hashed >> np.uint64(64 - bits)).astype(np.int64), minlength=len(counts))
        bins = np.flatnonzero(counts > least / 4 * seen / max(known, 1))
        if len(bins):
            yield pa.RecordBatch.from_pydict({"bin": bins.astype(np.int32), "n": counts[bins]})

    rows = texts.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).where(F.col("n") >= 0.75 * least).select("bin")
    hot = np.zeros(1 << bits, bool)
    hot[[r[0] for r in rows.collect()]] = True
    return hot


class Slices:
    """Signatures that are cut, with their numbers of slices, and the groups in which their slices meet; groups come after
    ``buckets``: first each slice with itself, then each two of them."""

    def __init__(self, sigs: np.ndarray, slices: np.ndarray, buckets: int):
        order = np.argsort(sigs)
        self.sigs, self.slices = sigs[order], slices[order]
        groups = self.slices * (self.slices + 1) // 2
        self.begin = buckets + np.cumsum(groups) - groups

    def find(self, sigs: np.ndarray) -> np.ndarray:
        """The place of each signature among those that are cut, or -1."""
        if not len(self.sigs):
            return np.full(len(sigs), -1)
        at = np.minimum(np.searchsorted(self.sigs, sigs), len(self.sigs) - 1)
        return np.where(self.sigs[at] == sigs, at, -1)

    @staticmethod
    def number(ids: np.ndarray, slices: np.ndarray | int) -> np.ndarray:
        return (mix(ids.astype(np.int64).view(np.uint64)) % np.asarray(slices).astype(np.uint64)).astype(np.int64)

    def spread(self, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(entry, group) for each group of an entry's signature that its slice takes part in, some entries at a time."""
        for some in np.array_split(np.arange(len(at)), int(self.slices[at].sum()) // REPEATED + 1):
            n = self.slices[at[some]]
            entry = np.repeat(some, n)
            other = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            k = self.slices[at[entry]]
            own = self.number(ids[entry], k)
            low, high = np.minimum(own, other), np.maximum(own, other)
            yield entry, self.begin[at[entry]] + np.where(low == high, low, k + high * (high - 1) // 2 + low)

    def first_met(self, group: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of a group are its own; those within a slice belong to the group of the slice with itself."""
        at = int(np.searchsorted(self.begin, group, "right")) - 1
        if at < 0 or group - self.begin[at] < self.slices[at]:
            return np.ones(len(a), bool)
        return self.number(a, self.slices[at]) != self.number(b, self.slices[at])


def large_signatures(texts: DataFrame, hot: np.ndarray, q: int, slack: int, buckets: int, known: int, size: int = SLICE) -> Slices:
    """Counts signatures before any are gathered. A sample will do: a signature that is taken for small is met in one group."""
    rate = 1 if known <= COUNTED else SAMPLED
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, n = np.unique(part_enum(unpack_texts(batch.column(0)).to_pylist(), shared.value, q, slack)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"sig": sigs, "n": n.astype(np.int64)})

    counts = texts.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("text").mapInArrow(count, "sig long, n long").groupBy("sig").agg((F.sum("n") * rate).alias("n"))
    rows = counts.where(F.col("n") > 2 * size).orderBy(F.desc("n")).limit(MOST_LARGE).collect()
    return Slices(np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([-(-r[1] // size) for r in rows], np.int64), buckets)


def _emit(texts: DataFrame, hot: np.ndarray, q: int, slack: int, buckets: int, large: Slices) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((hot, large))

    low = np.uint64(PLACE_BITS + SPAN_BITS)

    def pack(bucket: np.ndarray, sigs: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((ids, bucket))
        bucket, own, code = bucket[by], ids[by], ((sigs[by] >> (np.uint64(32) + low) << low) | codes[by].astype(np.uint64)).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = [(int(bucket[a]), planes(code[a:b]), planes(np.diff(own[a:b], prepend=0))) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "sigs", "ids"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, large = shared.value
        for batch in batches:
            sigs, text, codes = part_enum(unpack_texts(batch.column(1)).to_pylist(), hot, q, slack)
            ids = batch.column(0).to_numpy()[text]
            at = large.find(sigs)
            small = at < 0
            if small.any():
                yield pack((sigs[small] % np.uint64(buckets)).astype(np.int64), sigs[small], ids[small], codes[small])
            if not small.all():
                at, sigs, ids, codes = at[~small], sigs[~small], ids[~small], codes[~small]
                for entry, group in large.spread(at, ids):
                    if len(entry):
                        yield pack(group, sigs[entry], ids[entry], codes[entry])

    return texts.select("id", "text").mapInArrow(emit, _SIGNATURE)


def bucket_pairs(codes: np.ndarray, ids: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of ids that share a signature at about the same place, in one bucket."""
    order = np.sort(codes.astype(np.int64) << 32 | np.arange(len(codes)))
    alike = np.diff(order >> 32 + PLACE_BITS + SPAN_BITS) == 0
    if not alike.any():
        return ids[:0], ids[:0]
    order = order[np.r_[alike, False] | np.r_[False, alike]]  # the other entries meet none
    codes = (order >> 32).astype(np.uint32)
    known, own = np.unique(ids[order & 0xFFFFFFFF], return_inverse=True)
    sigs = codes >> np.uint32(PLACE_BITS + SPAN_BITS)
    places, spans = (codes >> np.uint32(SPAN_BITS) & np.uint32((1 << PLACE_BITS) - 1)).astype(np.int32), (codes & np.uint32((1 << SPAN_BITS) - 1)).astype(np.int32)

    def near(x: np.ndarray, y: np.ndarray, ring: int, most: int) -> np.ndarray:
        apart = (x - y) % ring
        return np.minimum(apart, ring - apart) <= most

    new = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.empty(0, np.int64)
    ahead = np.repeat(np.r_[new[1:], len(sigs)], np.diff(np.r_[new, len(sigs)])) - np.arange(len(sigs)) - 1
    keys, step = [], 1
    at = np.flatnonzero(ahead >= 1)
    while len(at):  # each entry with the one ``step`` after it in its group
        other = at + step
        alike = near(places[at], places[other], 1 << PLACE_BITS, (slack + 1) // 2) & near(spans[at], spans[other], 1 << SPAN_BITS, (slack + 3) // 4)
        x, y = own[at[alike]], own[other[alike]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        keys.append(((x << 32) | y)[x != y])
        step += 1
        at = at[ahead[at] >= step]
        if step % 64 == 0:
            keys = [np.unique(np.concatenate(keys))]
    pairs = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return known[pairs >> 32], known[pairs & 0xFFFFFFFF]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pairs of some groups, before any are shuffled."""
    held, size = [], 0

    def different() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= HELD:
            yield different()
            held, size = [], 0
    if size:
        yield different()


def candidate_pairs(texts: DataFrame, hot: np.ndarray, q: int, slack: int, buckets: int, large: Slices, parts: int) -> DataFrame:
    """(a, b), a < b: pairs of ids that share a signature, about once for every task they meet in."""
    shared = texts.sparkSession.sparkContext.broadcast(large)

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids = [np.cumsum(d) for d in from_planes(group["ids"], 8)]
        a, b = bucket_pairs(np.concatenate(from_planes(group["sigs"], 4, np.uint32)), np.concatenate(ids), slack)
        own = shared.value.first_met(key[0].as_py(), a, b)
        return pa.table({"a": a[own], "b": b[own]})

    return _emit(texts, hot, q, slack, buckets, large).repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long").mapInArrow(_once, "a long, b long")


def near_pairs(df: DataFrame, id_col: str, text_col: str, edits: int = 8, q: int = 8, hot_share: float = 0.01, hot_least: int = 50, size: int = SLICE) -> DataFrame:
    """(a, b, d) with a < b: classes of equal texts at an edit distance d of ``edits`` or less. The pairs are written to the
    checkpoint folder, so that nothing is kept in memory after the call."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    parts = partitions_for(df.sparkSession, rows, TEXT_BYTES)
    packed = rows.select("id", "text", F.length("text").alias("n")).mapInArrow(_packed, "id long, text binary, n int")
    # kept by id: both joins below find the texts where they need them
    texts = packed.groupBy("text").agg(F.min("id").alias("id"), F.min("n").alias("n")).repartition(parts, "id").persist()
    known, short, length = texts.agg(F.count("*"), F.count_if(F.col("n") < SHORT), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    bits = bins_for(length)
    hot = hot_bins(texts, q, max(hot_share * known, hot_least, OVER_AVERAGE * known * length / 2**bits), bits, known)
    buckets = max(parts, int(known * ENOUGH * 1.2 / ENTRIES_PER_BUCKET))
    large = large_signatures(texts, hot, q, edits, buckets, known, size)
    pairs = candidate_pairs(texts, hot, q, edits, buckets, large, parts).repartition(parts, "a").dropDuplicates(["a", "b"])
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances_within(unpack_texts(batch.column(2)).to_pylist(), unpack_texts(batch.column(3)).to_pylist(), edits)
            close = pa.array(d <= edits)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(close), batch.column(1).filter(close), pa.array(d, pa.int32()).filter(close)], ["a", "b", "d"])

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, d int")
    if short:
        near = texts.where(F.col("n") < SHORT + edits).select("id", "text").mapInArrow(_unpacked, "id long, text string")
        found = found.unionByName(_short_pairs(near, edits))  # signatures are of longer texts only, so no pair comes twice
    found = cut_lineage(found)
    texts.unpersist()
    return found


def _short_pairs(near: DataFrame, edits: int) -> DataFrame:
    """Pairs with a text too short for signatures, without loss; ``near`` holds those texts and all that are at most ``edits``
    longer. The shorter text of a pair is cut into ``edits`` + 1 even
    pieces; one of them stands unchanged in the other text, shifted by no more than the edits on either side of it allow.
    So pairs meet in an equi-join on length, piece and letters, and their distance is taken once."""
    pieces = edits + 1
    begin, size = f"int(i * l div {pieces})", f"int((i + 1) * l div {pieces} - i * l div {pieces})"
    number = F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i")
    shorter = near.where(F.length("text") < SHORT).select(F.col("id").alias("s"), "text", F.length("text").alias("l"), number)
    shorter = shorter.select("s", "l", "i", F.expr(f"substring(text, {begin} + 1, {size})").alias("piece"))
    longer = near.select(F.col("id").alias("r"), "text", F.length("text").alias("n"))
    longer = longer.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - edits), F.col("n"))).alias("l")).where(F.col("l") < SHORT).select("*", number)
    least = F.expr(f"greatest(0, {begin} - i, {begin} + n - l - ({edits} - i))")
    most = F.expr(f"least(n - {size}, {begin} + i, {begin} + n - l + ({edits} - i))")
    places = longer.where(least <= most).select("r", "text", "n", "l", "i", F.explode(F.sequence(least, most)).alias("at"))
    places = places.select("r", "n", "l", "i", F.expr(f"substring(text, at + 1, {size})").alias("piece")).distinct()
    met = shorter.join(places, ["l", "i", "piece"]).where("s < r OR (s > r AND l < n)")
    pairs = met.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct()
    left, right = near.select(F.col("id").alias("a"), F.col("text").alias("x")), near.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.levenshtein("x", "y", edits).alias("d")).where("d >= 0")
