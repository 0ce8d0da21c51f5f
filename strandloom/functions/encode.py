"""Integer codes of DNA reads: bases, grams, anchor keys and signatures.

A, C, G, T are 0 to 3. Any other character, lower case too, makes the grams that hold it invalid. All functions take rows
with ``idx`` and ``read`` and give rows; a null read gives none, a read shorter than a gram gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.distance import base_distances, distances_within, indexed_distances

# Fixed values that define the keys and signatures.
ANCHOR = 4
KEY_SYMBOLS = 6
SIG_GRAM = 3
SIG_BLOCK = 22
SIG_WORDS = 6
INVALID = 255
PAST_END = 4
_BASES = np.full(128, -1, np.int64)
_BASES[[ord(b) for b in "ACGT"]] = np.arange(4)


def base_code(symbol: Column) -> Column:
    """0 to 3, or -1; for one symbol."""
    return F.position(symbol, F.lit("ACGT")) - 1


def base_rows(reads: DataFrame) -> DataFrame:
    """(idx, pos, code): every symbol of every read, code -1 where it is no base."""
    rows = reads.where(F.length("read") > 0).select("idx", "read", F.explode(F.sequence(F.lit(0), F.length("read") - 1)).alias("pos"))
    return rows.select("idx", "pos", base_code(F.expr("substring(read, pos + 1, 1)")).alias("code"))


def gram_rows(reads: DataFrame, q: int, keep: list[str] | None = None) -> DataFrame:
    """(idx, pos, code, keep...): the valid q-grams, first base most significant."""
    keep = keep or []
    rows = reads.where(F.length("read") >= q).select("idx", "read", *keep, F.explode(F.sequence(F.lit(0), F.length("read") - q)).alias("pos"))
    symbols = [base_code(F.expr(f"substring(read, pos + {k + 1}, 1)")) for k in range(q)]
    coded = rows.select("idx", "pos", *keep, *[s.alias(f"__b{k}") for k, s in enumerate(symbols)])
    valid = F.least(*[F.col(f"__b{k}") for k in range(q)]) >= 0 if q > 1 else F.col("__b0") >= 0
    fold = F.lit(0)
    for k in range(q):
        fold = fold * 4 + F.col(f"__b{k}")
    return coded.where(valid).select("idx", "pos", fold.cast("int").alias("code"), *keep)


def anchor_schedule() -> list[int]:
    """The 4-gram code of each round: a linear congruence modulo 2^32 from 1, its low byte taken."""
    state, codes = 1, []
    for _ in range(256):
        state = (1664525 * state + 1013904223) % 2**32
        codes.append(state % 256)
    return codes


class Symbols:
    """The reads of a batch laid end to end as base codes, -1 for no base, with owner and place of each symbol."""

    def __init__(self, reads: list[str]):
        self.count, lengths = len(reads), np.fromiter(map(len, reads), np.int64, len(reads))
        points = np.frombuffer("".join(reads).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.where(points < 128, _BASES[np.minimum(points, 127)], -1).astype(np.int64)
        self.owner = np.repeat(np.arange(len(reads)), lengths)
        self.place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.left = np.repeat(lengths, lengths) - self.place  # symbols from here to the end

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each valid q-gram begins, its code)."""
        width = max(0, len(self.codes) - q + 1)
        code, valid = np.zeros(width, np.int64), self.left[:width] >= q
        for k in range(q):
            code = code * 4 + self.codes[k : k + width]
            valid &= self.codes[k : k + width] >= 0
        at = np.flatnonzero(valid)
        return at, code[at]

    def keys(self, rounds: int, occurrences: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the anchor begins, round, key)."""
        turn = np.full(256, rounds)
        turn[anchor_schedule()[:rounds]] = np.arange(rounds)
        at, code = self.grams(ANCHOR)
        it = turn[code]
        at, it = at[it < rounds], it[it < rounds]
        order = np.argsort(self.owner[at] * rounds + it, kind="stable")  # places stay in order
        at, it = at[order], it[order]
        new = np.flatnonzero(np.diff(self.owner[at] * rounds + it, prepend=-1))
        nth = np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))
        at, it = at[nth < occurrences], it[nth < occurrences]
        key, padded = np.zeros(len(at), np.int64), np.concatenate([self.codes, np.zeros(ANCHOR + KEY_SYMBOLS, np.int64)])
        for j in range(ANCHOR, ANCHOR + KEY_SYMBOLS):
            symbol = padded[at + j]
            key = key * 5 + np.where(j >= self.left[at], PAST_END, np.where(symbol < 0, INVALID, symbol))
        return at, it, key

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(signature of each read, whether it has a valid gram)."""
        at, code = self.grams(SIG_GRAM)
        bits, some = np.zeros((self.count, SIG_WORDS), np.uint64), np.zeros(self.count, bool)
        np.bitwise_or.at(bits, (self.owner[at], np.minimum(self.place[at] // SIG_BLOCK, SIG_WORDS - 1)), np.uint64(1) << code.astype(np.uint64))
        some[self.owner[at]] = True
        return bits.view(np.int64), some


#: Longest read that is packed, and pairs of such reads whose texts are unpacked at once.
PACKED_MOST, PACKED_PAIRS = 512, 32_768
#: Reads kept as text whose signatures are made at once.
ODD_READS = 2048


class PackedReads:
    """Reads of A, C, G, T, two bits a base, in rows of one width; reads with other symbols and long ones stay text, as ``odd``."""

    def __init__(self, lengths: np.ndarray, grid: np.ndarray, odd: dict[int, str]):
        self.lengths, self.grid, self.odd = lengths, grid, odd

    @staticmethod
    def of(reads: list[str]) -> PackedReads:
        odd = {k: read for k, read in enumerate(reads) if len(read) > PACKED_MOST or read.strip("ACGT")}
        short = ["" if k in odd else read for k, read in enumerate(reads)]
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        wide = -(-int(lengths.max(initial=0)) // 4) * 4
        codes = np.zeros((len(short), wide), np.uint8)
        codes[np.arange(wide) < lengths[:, None]] = _BASES[np.frombuffer("".join(short).encode(), np.uint8)]
        grid = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
        lengths[list(odd)] = -1
        return PackedReads(lengths.astype(np.int16), grid, odd)

    def pick(self, some: np.ndarray) -> tuple[np.ndarray, bytes, list[str]]:
        """Lengths, packed rows and odd texts of the chosen reads, as ``joined`` takes them."""
        lengths = self.lengths[some]
        return lengths, self.grid[some].tobytes(), [self.odd[k] for k in some[lengths < 0].tolist()]

    @staticmethod
    def joined(lengths: list[bytes], grids: list[bytes], odd: list[list[str]]) -> PackedReads:
        pieces = [np.frombuffer(x, np.int16) for x in lengths]
        rows = [np.frombuffer(g, np.uint8).reshape(len(n), -1) for n, g in zip(pieces, grids)]
        every = np.concatenate(pieces)
        grid, at = np.zeros((len(every), max(1, max(r.shape[1] for r in rows))), np.uint8), 0
        for r in rows:
            grid[at : at + len(r), : r.shape[1]] = r
            at += len(r)
        return PackedReads(every, grid, dict(zip(np.flatnonzero(every < 0).tolist(), (text for texts in odd for text in texts))))

    def codes(self, some: np.ndarray) -> np.ndarray:
        """(read, place): base codes, 0 past the end."""
        rows = self.grid[some]
        return np.stack([rows >> 2 * k & 3 for k in range(4)], axis=2).reshape(len(rows), -1)

    def texts(self, some: np.ndarray) -> list[str]:
        """The chosen reads."""
        codes, lengths = self.codes(some), self.lengths[some].astype(np.int64)
        letters, wide = np.frombuffer(b"ACGT", np.uint8)[codes].tobytes().decode(), codes.shape[1]
        return [letters[k * wide : k * wide + n] if n >= 0 else self.odd[read] for k, (read, n) in enumerate(zip(some.tolist(), lengths.tolist()))]

    def signatures(self) -> np.ndarray:
        """(word, read): the bits that ``Symbols.words`` gives."""
        bits = np.zeros((SIG_WORDS, len(self.lengths)), np.uint64)
        for at in range(0, len(self.lengths), 8192):
            some = slice(at, at + 8192)
            codes, left = np.ascontiguousarray(self.codes(some).T), self.lengths[some]
            for p in range(len(codes) - SIG_GRAM + 1):
                code = (codes[p] << 4 | codes[p + 1] << 2 | codes[p + 2]).astype(np.uint64)
                bits[min(p // SIG_BLOCK, SIG_WORDS - 1), some] |= (left >= p + SIG_GRAM).astype(np.uint64) << code
        odd = list(self.odd)
        for at in range(0, len(odd), ODD_READS):  # their symbols take far more room than packed reads
            some = odd[at : at + ODD_READS]
            bits[:, some] = Symbols([self.odd[k] for k in some]).words()[0].view(np.uint64).T
        return bits

    def distances(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """The distance of each pair up to ``limit``, and some larger number beyond it."""
        out, plain = np.empty(len(a), np.int64), (self.lengths[a] >= 0) & (self.lengths[b] >= 0)
        long = np.array([k for k, text in self.odd.items() if len(text) > PACKED_MOST], np.int64)
        beyond = ~plain & (np.isin(a, long) | np.isin(b, long))
        for kind in (plain, ~plain & ~beyond):
            todo = np.flatnonzero(kind)
            for at in range(0, len(todo), PACKED_PAIRS):
                pairs = todo[at : at + PACKED_PAIRS]
                some, place = np.unique(np.r_[a[pairs], b[pairs]], return_inverse=True)
                i, j = place[: len(pairs)], place[len(pairs) :]
                out[pairs] = base_distances(self.codes(some), self.lengths[some].astype(np.int64), i, j, limit) if kind is plain else indexed_distances(self.texts(some), i, j, limit)
        rest = np.flatnonzero(beyond)
        out[rest] = distances_within(self.texts(a[rest]), self.texts(b[rest]), limit) if len(rest) else 0
        return out


def _coded(reads: DataFrame, make: Callable[[pa.Array, Symbols], dict], kinds: str) -> DataFrame:
    """Rows that ``make`` gives for the ids and symbols of a batch. No read is shuffled, and none is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(make(batch.column(0).to_numpy(), Symbols(batch.column(1).to_pylist())))

    return reads.where("read is not null").select(F.col("idx").cast("long").alias("idx"), "read").mapInArrow(run, kinds)


_WORDS = ", ".join(f"s{b} long" for b in range(SIG_WORDS))


def anchor_keys(reads: DataFrame, rounds: int, occurrences: int) -> DataFrame:
    """(idx, it, pos, key): the keys of the first ``occurrences`` places of each round's anchor.

    A key folds the six symbols after the anchor in base 5; a place past the end counts 4, an invalid symbol 255, which is
    why the fold is arithmetic.
    """

    def make(idx: np.ndarray, symbols: Symbols) -> dict:
        at, it, key = symbols.keys(rounds, occurrences)
        return {"idx": idx[symbols.owner[at]], "it": it.astype(np.int32), "pos": symbols.place[at].astype(np.int32), "key": key}

    return _coded(reads, make, "idx long, it int, pos int, key long")


def signatures(reads: DataFrame) -> DataFrame:
    """(idx, s0..s5): 384 bits, one 64-bit word a block of 22 places, the bit being the trigram's code.

    Reads without a valid trigram have no row; their signature is all zero.
    """

    def make(idx: np.ndarray, symbols: Symbols) -> dict:
        bits, some = symbols.words()
        return {"idx": idx[some], **{f"s{b}": bits[some, b] for b in range(SIG_WORDS)}}

    return _coded(reads, make, f"idx long, {_WORDS}")


def signed_keys(reads: DataFrame, rounds: int, occurrences: int) -> DataFrame:
    """(idx, it, key, s0..s5): keys that carry their read's signature, made together."""

    def make(idx: np.ndarray, symbols: Symbols) -> dict:
        at, it, key = symbols.keys(rounds, occurrences)
        own, bits = symbols.owner[at], symbols.words()[0]
        return {"idx": idx[own], "it": it.astype(np.int32), "key": key, **{f"s{b}": bits[own, b] for b in range(SIG_WORDS)}}

    return _coded(reads, make, f"idx long, it int, key long, {_WORDS}")


def hamming(left: str = "x", right: str = "y") -> Column:
    """Differing bits of two signatures with the given prefixes; a missing one is all zero."""
    total = F.lit(0)
    for b in range(SIG_WORDS):
        total = total + F.bit_count(F.coalesce(F.col(f"{left}{b}"), F.lit(0).cast("long")).bitwiseXOR(F.coalesce(F.col(f"{right}{b}"), F.lit(0).cast("long"))))
    return total.cast("int")
