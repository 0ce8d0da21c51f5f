"""Candidate pairs from shared keys, and the chain of filters that makes edges of them.

Defined results: pairs join different reads only and are ordered a < b; a bucket counts its keys, repeats of one read too,
and takes part with 2 to ``cap`` of them, or any number from 2 where ``cap`` is None; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encode import SIG_WORDS, PackedReads, Symbols, hamming, signatures, signed_keys
from strandloom.session import MOST_PARTITIONS

# Fixed values of the clustering.
BUCKET_CAP = 4096
CORE_ROUNDS, MERGE_ROUNDS = 64, 96
THETA_CORE, THETA_MERGE = 60, 96
#: Keys of a bucket that meet all its others in one task.
SLICE = 256
#: Reads whose pairs one task counts and the least number of such tasks, keys of one task's buckets, pairs counted at once.
PAIR_READS, PAIR_TASKS, BUCKET_KEYS, PAIRS_AT_ONCE = 350_000, 4, 1_000_000, 1_000_000
#: Keys of one task where the distances are worked out beside the buckets, the least number of such tasks, and of how many
#: rounds and occurrences a read has one key, about; reads of a group and the least number of groups, of which every two meet.
TASK_KEYS, LEAST_PARTS, KEYS_PER_READ = 1_200_000, 6, 10
GROUP_READS, LEAST_GROUPS = 20_000, 5


def capped(keys: DataFrame, cap: int | None = BUCKET_CAP) -> DataFrame:
    """The keys of buckets with 2 to ``cap`` of them. Sizes are counted partly before the shuffle, so that an oversized
    bucket, which takes no part, is never gathered in one task."""
    sizes = keys.groupBy("it", "key").agg(F.count("*").alias("m")).where((F.col("m") >= 2) if cap is None else F.col("m").between(2, cap)).select("it", "key", F.ceil(F.col("m") / SLICE).cast("int").alias("slices"))
    return keys.join(sizes, ["it", "key"])


def _side(kept: DataFrame, idx: str, prefix: str, sliced: bool) -> DataFrame:
    """One side of the join. A large bucket is cut into slices on one side and repeated for each on the other, so that its
    pairs, which grow with the square of its size, spread over tasks."""
    words = [F.col(f"s{b}").alias(f"{prefix}{b}") for b in range(SIG_WORDS) if f"s{b}" in kept.columns]
    part = F.pmod(F.xxhash64("idx"), F.col("slices")).cast("int") if sliced else F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    return kept.select("it", "key", F.col("idx").alias(idx), *words, part.alias("part"))


def bucket_pairs(keys: DataFrame, cap: int | None = BUCKET_CAP, theta: int | None = None) -> DataFrame:
    """(a, b) of every two keys in a bucket, of different owners; a pair may come several times.

    With ``theta`` the keys carry their owner's signature, and pairs that differ in more bits end inside the join.
    """
    kept = capped(keys, cap)
    met = _side(kept, "a", "x", True).join(_side(kept, "b", "y", False), ["it", "key", "part"]).where("a < b")
    return (met if theta is None else met.where(hamming() <= theta)).select("a", "b")


def sided_pairs(left: DataFrame, right: DataFrame, cap: int | None = BUCKET_CAP, theta: int | None = None) -> DataFrame:
    """(a, b) with a from ``left`` and b from ``right``; a bucket's size counts the keys of both sides."""
    kept = capped(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))), cap)
    met = _side(kept.where("side = 0"), "a", "x", True).join(_side(kept.where("side = 1"), "b", "y", False), ["it", "key", "part"])
    return (met if theta is None else met.where(hamming() <= theta)).select("a", "b")


def signed(reads: DataFrame, prefix: str, idx: str) -> DataFrame:
    """Reads with their signature, columns renamed for one side of a pair."""
    joined = reads.select("idx", "read").join(signatures(reads), "idx", "left")
    return joined.select(F.col("idx").alias(idx), F.col("read").alias(f"{prefix}_read"), *[F.col(f"s{b}").alias(f"{prefix}{b}") for b in range(SIG_WORDS)])


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, tau: int) -> DataFrame:
    """(a, b, d): different pairs within ``tau`` edits."""
    x, y = left.select(F.col("idx").alias("a"), F.col("read").alias("x")), right.select(F.col("idx").alias("b"), F.col("read").alias("y"))
    near = pairs.distinct().join(x, "a").join(y, "b").where(F.abs(F.length("x") - F.length("y")) <= tau)
    return near.select("a", "b", F.levenshtein("x", "y", tau).alias("d")).where("d >= 0")


def core_edges(reads: DataFrame, tau: int = 8, rounds: int = CORE_ROUNDS, theta: int = THETA_CORE, occurrences: int = 4, cap: int | None = BUCKET_CAP) -> DataFrame:
    """(a, b, d): pairs of reads that share an anchor key, pass the signature and lie within ``tau`` edits."""
    if cap is None:  # one bucket can hold most reads then; only the join cuts it into slices
        return verified(bucket_pairs(signed_keys(reads, rounds, occurrences), cap, theta), reads, reads, tau)
    return near_pairs(reads, None, tau, rounds, theta, occurrences, cap).distinct()


def near_pairs(left: DataFrame, right: DataFrame | None, tau: int, rounds: int, theta: int, occurrences: int, cap: int, gather: bool = False, counted: int | None = None) -> DataFrame:
    """(a, b, d) of pairs that share a bucket of 2 to ``cap`` keys, pass the signature and lie within ``tau`` edits: of
    ``left`` with a < b, or with ``right`` a from the one and b from the other. A pair may come once for each task.

    Keys go to the task of their bucket without signatures; each task gets the text of a read once, packed, and makes
    signatures and distances of it. No candidate is shuffled and nothing is joined. With ``gather``, for distances that cost
    more than that, the pairs that pass the signature go to the block of their two groups of reads first, packed, so that
    each comes and is compared once. Only with ``gather``: beyond ``counted`` edits rows (null, null, d, n) tell how many
    pairs there are, and n is 1 for the pairs up to it.
    """
    texts = lambda df, side: df.where("read is not null").select(F.col("idx").cast("long").alias("idx"), "read", F.lit(side).alias("side"))
    two = right is not None
    both = texts(left, 0) if right is None else texts(left, 0).unionByName(texts(right, 1))
    expected = both.count() * rounds * occurrences // KEYS_PER_READ
    parts = max(LEAST_PARTS, -(-expected // TASK_KEYS))
    groups = max(LEAST_GROUPS, -(-(expected * KEYS_PER_READ // (rounds * occurrences)) // GROUP_READS)) if gather else 0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reads = batch.column(1).to_pylist()
            symbols, packed = Symbols(reads), PackedReads.of(reads)
            at, it, key = symbols.keys(rounds, occurrences)
            code, own = it << 20 | key, symbols.owner[at]
            part = code * 0x9E3779B1 % 2**32 * parts >> 32
            order = np.lexsort((own, code, part))
            code, own, part = code[order], own[order], part[order]
            if len(code):  # more than show that a bucket is too large are not needed
                new = np.flatnonzero(np.diff(code, prepend=-1))
                some = np.arange(len(code)) - np.repeat(new, np.diff(np.r_[new, len(code)])) <= cap
                code, own, part = code[some], own[some], part[some]
            idx, side = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            rows = {"h": part[cuts], **{c: [] for c in ("codes", "members", "idx", "side", "lengths", "packed", "odd")}}
            for x, y in zip(cuts, [*cuts[1:], len(part)]):
                some, member = np.unique(own[x:y], return_inverse=True)
                lengths, grid, odd = packed.pick(some)
                for name, value in (("codes", _packed(code[x:y].astype(np.uint32))), ("members", _packed(member.astype(np.uint32))), ("idx", _packed(idx[some])), ("side", side[some].astype(np.uint8).tobytes()), ("lengths", lengths.tobytes()), ("packed", grid), ("odd", odd)):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict({"h": pa.array(rows["h"], pa.int64()), "odd": pa.array(rows["odd"], pa.list_(pa.string())), **{c: pa.array(rows[c], pa.binary()) for c in _BLOBS}}).select(["h", "odd", *_BLOBS])

    def meet(table: pa.Table) -> pa.Table:
        member, held = [], 0
        ids, sides = _unpacked(table["idx"], np.int64), np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["side"]])
        for m, s in zip(table["members"], table["side"]):
            member.append(_unpacked([m], np.uint32).astype(np.int64) + held)
            held += len(s.as_buffer())
        code, own = _unpacked(table["codes"], np.uint32), np.concatenate(member)
        order = np.lexsort((ids[own], sides[own], code))
        code, own = code[order], own[order]
        reads = PackedReads.joined(*(table[c].to_pylist() for c in ("lengths", "packed", "odd")))
        a, b = bucket_near(code, own, ids, sides if two else None, reads.signatures(), theta, cap)
        if gather:
            x, y = _group(ids[a], groups), _group(ids[b], groups)
            p = x * groups + y if two else np.minimum(x, y) * groups + np.maximum(x, y)
            order = np.argsort(p, kind="stable")
            a, b, p = ids[a[order]], ids[b[order]], p[order]
            cuts = np.flatnonzero(np.diff(p, prepend=-1)).tolist()
            ends = [*cuts[1:], len(p)]
            none = {c: pa.nulls(len(cuts), pa.binary()) for c in ("idx", "side", "lengths", "packed")}
            pairs = {c: pa.array([_packed(v[x:y]) for x, y in zip(cuts, ends)], pa.binary()) for c, v in (("a", a), ("b", b))}
            return pa.table({"p": pa.array(p[cuts], pa.int64()), **pairs, "odd": pa.nulls(len(cuts), pa.list_(pa.string())), **none})
        d = reads.distances(a, b, tau)
        a, b, d = a[d <= tau], b[d <= tau], d[d <= tau]
        return pa.table({"a": ids[a], "b": ids[b], "d": d.astype(np.int32)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, packed, side = batch.column(0).to_numpy(), PackedReads.of(batch.column(1).to_pylist()), batch.column(2).to_numpy()
            group, rows = _group(idx, groups), {"p": [], **{c: [] for c in ("odd", "idx", "side", "lengths", "packed")}}
            for g, s in {(g, s) for g, s in zip(group.tolist(), side.tolist())}:
                some = np.flatnonzero((group == g) & (side == s))
                lengths, grid, odd = packed.pick(some)
                for k in range(groups):
                    p = (g * groups + k if s == 0 else k * groups + g) if two else min(g, k) * groups + max(g, k)
                    for name, value in (("p", p), ("odd", odd), ("idx", _packed(idx[some])), ("side", np.full(len(some), s, np.uint8).tobytes()), ("lengths", lengths.tobytes()), ("packed", grid)):
                        rows[name].append(value)
            none = pa.nulls(len(rows["p"]), pa.binary())
            yield pa.RecordBatch.from_pydict({"p": pa.array(rows["p"], pa.int64()), "a": none, "b": none, "odd": pa.array(rows["odd"], pa.list_(pa.string())), **{c: pa.array(rows[c], pa.binary()) for c in ("idx", "side", "lengths", "packed")}})

    def compare(table: pa.Table) -> pa.Table:
        pairs, rows = table.filter(pa.compute.is_valid(table["a"])), table.filter(pa.compute.is_null(table["a"]))
        if not pairs.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32()), ("n", pa.int64()))}).select(made)
        reads, sides = PackedReads.joined(*(rows[c].to_pylist() for c in ("lengths", "packed", "odd"))), np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows["side"]])
        ids = _unpacked(rows["idx"], np.int64)
        order = np.lexsort((ids, sides))
        edge = np.count_nonzero(sides == 0)
        ids = ids[order]
        a = np.searchsorted(ids[:edge], _unpacked(pairs["a"], np.int64))
        b = np.searchsorted(ids[edge:], _unpacked(pairs["b"], np.int64)) + edge if two else np.searchsorted(ids, _unpacked(pairs["b"], np.int64))
        a, b = np.divmod(_once(a * len(ids) + b), len(ids))
        d = reads.distances(order[a], order[b], tau)
        a, b, d = a[d <= tau], b[d <= tau], d[d <= tau]
        if counted is None:
            return pa.table({"a": ids[a], "b": ids[b], "d": d.astype(np.int32)})
        few, far = d <= counted, np.bincount(d[d > counted])
        beyond = np.flatnonzero(far)
        none = pa.nulls(len(beyond), pa.int64())
        ends = {c: pa.concat_arrays([pa.array(ids[x[few]], pa.int64()), none]) for c, x in (("a", a), ("b", b))}
        return pa.table({**ends, "d": np.r_[d[few], beyond].astype(np.int32), "n": np.r_[np.ones(np.count_nonzero(few), np.int64), far[beyond]]})

    made = ["a", "b", "d", *["n"] * (counted is not None)]
    sent = both.mapInArrow(split, "h long, odd array<string>, " + ", ".join(f"{c} binary" for c in _BLOBS))
    sent = sent.repartition(min(4 * parts, MOST_PARTITIONS), "h").groupBy("h")  # by their bytes Spark would put many of these long groups into one task
    if not gather:
        return sent.applyInArrow(meet, "a long, b long, d int")
    kinds = "p long, a binary, b binary, odd array<string>, idx binary, side binary, lengths binary, packed binary"
    return sent.applyInArrow(meet, kinds).unionByName(both.mapInArrow(place, kinds)).groupBy("p").applyInArrow(compare, "a long, b long, d int" + ", n long" * (counted is not None))


_BLOBS = ("codes", "members", "idx", "side", "lengths", "packed")


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (ids * 0x9E3779B1 % 2**32 >> 8) % groups


def bucket_near(code: np.ndarray, own: np.ndarray, ids: np.ndarray, sides: np.ndarray | None, words: np.ndarray, theta: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), each once: the owners of two keys of a bucket of 2 to ``cap`` that differ in at most ``theta`` signature bits.
    Keys are sorted by code, side and id; with ``sides`` an owner of side 0 meets those of side 1, else each the larger ones."""
    new = np.flatnonzero(np.diff(code.astype(np.int64), prepend=-1))
    size = np.diff(np.r_[new, len(code)])
    end = np.repeat(new + size, size)
    stays = np.repeat((size >= 2) & (size <= cap), size)
    if sides is None:
        row, begin = np.arange(len(code)), np.arange(1, len(code) + 1)
    else:
        begin = np.repeat(new + np.add.reduceat(sides[own] == 0, new, dtype=np.int64), size) if len(new) else new
        row, stays = np.arange(len(code)), stays & (sides[own] == 0)
    row = row[stays & (begin < end)]
    begin, count = begin[row], (end - begin)[row]
    total, at, found = np.cumsum(count), 0, [np.empty(0, np.int64)]
    while at < len(row):
        stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE // 4)), at + 1)
        n, base = count[at:stop], row[at]
        local = own[base : int((begin[stop - 1] + count[stop - 1]))]
        bits = words[:, local]
        x = np.repeat(row[at:stop] - base, n)
        y = np.repeat(begin[at:stop] - base - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        apart = np.zeros(len(x), np.uint16)
        for w in range(SIG_WORDS):
            apart += np.bitwise_count(bits[w].take(x) ^ bits[w].take(y))
            if w >= 2 and w < SIG_WORDS - 1:
                some = np.flatnonzero(apart <= theta)
                if 2 * len(some) < len(x):
                    x, y, apart = x.take(some), y.take(some), apart.take(some)
        some = np.flatnonzero(apart <= theta)
        a, b = local[x[some]], local[y[some]]
        if sides is None:
            a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
        found.append(_once(a * len(ids) + b))
        at = stop
        if len(found) > 64:
            found = [_once(np.concatenate(found))]
    return np.divmod(_once(np.concatenate(found)), max(1, len(ids)))


def _once(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


def _packed(values: np.ndarray) -> bytes:
    """Differences by planes of bytes, which compress in the shuffle."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(blob.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel() for blob in blobs]
    return np.concatenate([np.empty(0, kind), *(np.cumsum(part, dtype=kind) for part in parts)])


def pair_counts(reads: DataFrame, rounds: int, occurrences: int, make: Callable[..., dict], kinds: str, cap: int | None = BUCKET_CAP, signed: bool = False) -> DataFrame:
    """Rows that ``make`` gives for (a, b, n): the pairs that ``bucket_pairs`` makes and how often. All pairs of an ``a`` come
    in one call, each pair once, sorted; with ``signed`` their signatures come, too.

    No pair is shuffled. Keys go to the task of their bucket; that sends each block of reads, of ``blocks``, the bucket's
    members from the block's first one on, so a bucket of k keys sends at most k x ``blocks`` numbers, not k^2 / 2 pairs.
    Of a bucket larger than ``cap`` a batch sends no more keys than show that it is.
    """
    total = reads.count()
    kind = np.uint32 if total < 2**32 else np.uint64
    blocks, parts = max(PAIR_TASKS, -(-total // PAIR_READS)), max(PAIR_TASKS, -(-total * 32 // BUCKET_KEYS))
    # the first blocks have more partners behind them and are smaller
    bounds = np.floor(total * (1 - np.sqrt(1 - np.arange(blocks + 1) / blocks))).astype(np.int64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, symbols = batch.column(0).to_numpy(), Symbols(batch.column(1).to_pylist())
            at, it, key = symbols.keys(rounds, occurrences)
            code, own = it << 20 | key, idx[symbols.owner[at]]  # a key is below 2^20
            part = code * 0x9E3779B1 % 2**32 * parts >> 32
            order = np.lexsort((own, code, part))
            code, own, part = code[order], own[order], part[order]
            if cap is not None and len(code):
                new = np.flatnonzero(np.diff(code, prepend=-1))
                some = np.arange(len(code)) - np.repeat(new, np.diff(np.r_[new, len(code)])) <= cap
                code, own, part = code[some], own[some], part[some]
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            ends = [*cuts[1:], len(part)]
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(part[cuts], pa.int64()), "codes": pa.array([_packed(code[x:y].astype(np.uint32)) for x, y in zip(cuts, ends)], pa.binary()),
                "reads": pa.array([_packed(own[x:y].astype(kind)) for x, y in zip(cuts, ends)], pa.binary()),
            })

    def gather(table: pa.Table) -> pa.Table:
        code, own = _unpacked(table["codes"], np.uint32), _unpacked(table["reads"], kind)
        order = np.lexsort((own, code))
        code, own = code[order], own[order].astype(np.int64)
        new = np.flatnonzero(np.diff(code.astype(np.int64), prepend=-1))
        size = np.diff(np.r_[new, len(code)])
        stays = np.repeat((size >= 2) & (size <= (cap or len(code))), size)
        end = np.repeat(new + size, size)[stays] - (np.cumsum(~stays))[stays]
        own = own[stays]
        block = np.searchsorted(bounds, own, "right") - 1
        begin = np.flatnonzero((np.diff(end, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        mine, length = np.diff(np.r_[begin, len(own)]), end[begin] - begin
        order = np.argsort(block[begin], kind="stable")
        order = order[length[order] > 1]
        begin, mine, length, block = begin[order], mine[order], length[order], block[begin][order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        rows = {"p": [], "sizes": [], "mine": [], "members": []}
        for x, y in zip(cuts, [*cuts[1:], len(block)]):
            n = length[x:y]
            at = np.repeat(begin[x:y] - np.cumsum(n) + n, n) + np.arange(n.sum())
            for name, value in (("p", int(block[x])), ("sizes", _packed(n.astype(np.uint32))), ("mine", _packed(mine[x:y].astype(np.uint32))), ("members", _packed(own[at].astype(kind)))):
                rows[name].append(value)
        return pa.table({"p": pa.array(rows["p"], pa.int64()), **{c: pa.array(rows[c], pa.binary()) for c in ("sizes", "mine", "members")}, "bits": pa.nulls(len(rows["p"]), pa.binary())})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, bits = batch.column(0).to_numpy(), Symbols(batch.column(1).to_pylist()).words()[0]
            order = np.argsort(idx)
            idx, bits = idx[order], bits[order]
            first = [p for p in range(blocks) if len(idx) and bounds[p] <= idx[-1]]
            starts = [int(np.searchsorted(idx, bounds[p])) for p in first]
            none = pa.nulls(len(first), pa.binary())
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(first, pa.int64()), "sizes": none, "mine": none, "members": pa.array([_packed(idx[x:].astype(kind)) for x in starts], pa.binary()),
                "bits": pa.array([bits[x:].tobytes() for x in starts], pa.binary()),
            })

    def count(batches: pa.Table) -> Iterator[dict]:
        lists, words = batches.filter(pa.compute.is_null(batches["bits"])), batches.filter(pa.compute.is_valid(batches["bits"]))
        start = int(bounds[batches["p"][0].as_py()])
        size, mine, members = (_unpacked(lists[c], k) for c, k in (("sizes", np.uint32), ("mine", np.uint32), ("members", kind)))
        members -= kind(start)
        bits = np.zeros((total - start if signed else 0, SIG_WORDS), np.uint64)
        if words.num_rows:
            bits[_unpacked(words["members"], kind).astype(np.int64) - start] = np.concatenate([np.frombuffer(w.as_buffer(), np.uint64) for w in words["bits"]]).reshape(-1, SIG_WORDS)
        small = np.int32 if len(members) < 2**31 else np.int64
        size, mine = size.astype(small), mine.astype(small)
        begin = np.cumsum(size, dtype=small) - size
        place = np.repeat(begin - np.cumsum(mine, dtype=small) + mine, mine) + np.arange(mine.sum(), dtype=small)
        partners = np.repeat(begin + size, mine) - place - 1
        a = members[place]
        order = np.argsort(a, kind="stable").astype(small)
        a, place, partners = a[order], place[order] + 1, partners[order]
        del order, begin
        ends, at = np.cumsum(partners, dtype=np.int64), 0
        while at < len(a):
            held = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, held + PAIRS_AT_ONCE)), at + 1)
            stop = int(np.searchsorted(a, a[stop - 1], "right"))  # all of a read's pairs together
            n = partners[at:stop].astype(np.int64)
            b = members[np.repeat(place[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
            one = np.repeat(a[at:stop].astype(np.int64), n)
            code = np.sort(one[b > one] * (total - start) + b[b > one])
            at = stop
            if len(code):
                new = np.flatnonzero(np.diff(code, prepend=-1))
                one, two = np.divmod(code[new], total - start)
                yield make(one + start, two + start, np.diff(np.r_[new, len(code)]), *((bits[one], bits[two]) if signed else ()))

    def counted(table: pa.Table) -> pa.Table:
        return pa.concat_tables([empty, *(pa.table(made).cast(empty.schema) for made in count(table))])

    empty = pa.table({name: pa.array([], {"long": pa.int64(), "int": pa.int32()}[of]) for name, of in (c.split() for c in kinds.split(", "))})
    texts, lists = reads.where("read is not null").select(F.col("idx").cast("long").alias("idx"), "read"), "p long, sizes binary, mine binary, members binary, bits binary"
    sent = texts.mapInArrow(split, "h long, codes binary, reads binary").groupBy("h").applyInArrow(gather, lists)
    if signed:
        sent = sent.unionByName(texts.mapInArrow(sign, lists))
    return sent.groupBy("p").applyInArrow(counted, kinds)


def repeated_pairs(reads: DataFrame, rounds: int = CORE_ROUNDS, occurrences: int = 1) -> DataFrame:
    """(n, pairs): how many pairs share n keys."""

    def make(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> dict:
        held = np.bincount(n)
        return {"n": np.flatnonzero(held), "pairs": held[held > 0]}

    return pair_counts(reads, rounds, occurrences, make, "n long, pairs long").groupBy("n").agg(F.sum("pairs").alias("pairs"))


def partners(reads: DataFrame, rounds: int = CORE_ROUNDS, occurrences: int = 4) -> DataFrame:
    """(a, partners, times, indices): of each read how many larger ones share keys, how many, and the sum of their indices."""

    def make(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> dict:
        new = np.flatnonzero(np.diff(a, prepend=-1))
        return {"a": a[new], "partners": np.diff(np.r_[new, len(a)]), "times": np.add.reduceat(n, new), "indices": np.add.reduceat(b, new)}

    return pair_counts(reads, rounds, occurrences, make, "a long, partners long, times long, indices long")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def differing_bits(reads: DataFrame, rounds: int = CORE_ROUNDS, occurrences: int = 1) -> DataFrame:
    """(bits, pairs): differing signature bits of the different pairs that share keys."""

    def make(a: np.ndarray, b: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        held = np.bincount(_differing(x, y))
        return {"bits": np.flatnonzero(held), "pairs": held[held > 0]}

    return pair_counts(reads, rounds, occurrences, make, "bits int, pairs long", signed=True).groupBy("bits").agg(F.sum("pairs").alias("pairs"))


def work_counters(reads: DataFrame, tau: int = 8, rounds: int = CORE_ROUNDS, theta: int = THETA_CORE, occurrences: int = 4) -> DataFrame:
    """(cand, sig_pass, edit): candidates with repeats, those that pass the signature, distinct pairs put to the distance."""

    def make(a: np.ndarray, b: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        ok = _differing(x, y) <= theta
        return {"cand": [n.sum()], "sig_pass": [n[ok].sum()], "edit": [np.count_nonzero(ok)]}

    rows = pair_counts(reads, rounds, occurrences, make, "cand long, sig_pass long, edit long", signed=True)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("cand", "sig_pass", "edit")])
