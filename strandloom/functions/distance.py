"""Edit distances and alignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

OPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("ch", T.StringType())]))


def edit_distance(a: str, b: str, cutoff: int | None = None) -> Column:
    """Exact up to the cutoff and cutoff + 1 beyond it; without a cutoff always exact; null where a side is null."""
    if cutoff is None:
        return F.levenshtein(a, b)
    within = F.levenshtein(a, b, cutoff)
    return F.when(within < 0, cutoff + 1).otherwise(within)


def pigeonhole_pass(a: str, b: str, tau: int) -> Column:
    """False only where the distance is surely above tau: no one of tau + 1 pieces of a stands in b within tau places."""
    pieces = tau + 1
    hits = f"""exists(sequence(0, {tau}), t -> exists(sequence(-{tau}, {tau}), s ->
        int(t * length({a}) div {pieces}) + s >= 0
        AND int((t + 1) * length({a}) div {pieces}) + s <= length({b})
        AND substring({a}, int(t * length({a}) div {pieces}) + 1, int((t + 1) * length({a}) div {pieces} - t * length({a}) div {pieces}))
          = substring({b}, int(t * length({a}) div {pieces}) + s + 1, int((t + 1) * length({a}) div {pieces} - t * length({a}) div {pieces}))))"""
    return F.expr(f"length({a}) < {pieces} OR {hits}")


#: Pairs put side by side; the arrays of one step stay in the processor's cache.
LANES = 8192
#: Words of 64 texts, patterns that meet them, and words of 64 pairs that one sweep takes.
TEXT_WORDS, PATTERNS, PAIR_WORDS = 8, 64, 256
#: Bits of one sweep's table of equal symbols.
TABLE_BITS = 2**28
#: Lengths of grams that pairs are filtered by, longest first, and entries of a table of their places.
GRAMS, GRAM_PLACES = (6, 5, 4), 2**24
#: Parts of a pattern whose grams are sought apart, patterns and texts of one product.
PARTS, PRODUCT_ROWS, PRODUCT_TEXTS = 4, 1024, 4096
#: Length of a middle part, in edits allowed, that tells random texts apart, and the most of a text it is worth taking.
MIDDLE, MOST_MIDDLE = 2.5, 0.7
BASES = [ord(b) for b in "ACGT"]


class Texts:
    """Strings as a grid of small symbol numbers."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = np.uint8 if len(alphabet) < 255 else np.int32
        self.grid = np.zeros((len(texts), max(1, int(self.lengths.max(initial=0)))), kind)
        self.inside = np.arange(self.grid.shape[1]) < self.lengths[:, None]
        codes = _codes(texts)
        if len(alphabet) and alphabet.max() < 65536:
            number = np.zeros(int(alphabet.max()) + 1, kind)
            number[alphabet] = np.arange(1, len(alphabet) + 1)  # 0 pads
            self.grid[self.inside] = number[codes]
        else:
            order = np.argsort(alphabet)
            self.grid[self.inside] = order[np.searchsorted(alphabet, codes, sorter=order)] + 1

    def without_ends(self, ends: int) -> Texts:
        """The strings less so many symbols at either end."""
        out = copy(self)
        out.lengths = np.maximum(0, self.lengths - 2 * ends)
        out.inside = np.arange(max(1, int(out.lengths.max(initial=0)))) < out.lengths[:, None]
        out.grid = np.where(out.inside, self.grid[:, ends : ends + out.inside.shape[1]], 0).astype(self.grid.dtype) if out.lengths.any() else np.zeros(out.inside.shape, self.grid.dtype)
        return out

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, place, hashed code) of every gram; the bases' grams have codes of their own."""
        width = self.grid.shape[1] - q + 1
        if width <= 0:
            return (np.empty(0, np.int64),) * 3
        code = np.zeros((len(self.lengths), width), np.int32)
        for k in range(q):
            code = code * 4 + self.grid[:, k : k + width] - 1
        row, at = np.nonzero(self.inside[:, q - 1 :])
        return row, at, code[row, at].astype(np.int64) % 4**q


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _alphabet(*sides: list[str]) -> np.ndarray:
    counts = [np.flatnonzero(np.bincount(c)) if len(c := _codes(side)) and c.max() < 65536 else np.unique(c) for side in sides]
    every = np.unique(np.concatenate(counts))
    base = np.isin(every, BASES)  # they come first, so that their grams have bins of their own
    return np.concatenate([every[base], every[~base]])


def _lanes(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray, symbols: int) -> np.ndarray:
    """Distances of the pairs (a[i], b[j]) by bit-parallel columns, each pair in a 64-bit lane of its own."""
    m, n, count = a.lengths[i], b.lengths[j], len(i)
    words, pattern, text = -(-a.grid.shape[1] // 64), a.grid[i], b.grid[j].T.copy()
    masks = np.zeros((symbols + 1, words, count), np.uint64)
    lane = np.arange(count)
    for k in range(a.grid.shape[1]):  # each lane sets its own bit
        masks[pattern[:, k], k // 64, lane] |= np.uint64(1) << np.uint64(k % 64)
    masks[0] = 0
    one, top = np.uint64(1), np.uint64(63)
    vp, vn = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    score = m.copy()
    last_word, last_bit = np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
    at = [last_word == w for w in range(words)]
    for k in range(int(n.max(initial=0))):
        live = k < n
        hp_in, hn_in = np.full(count, one), np.zeros(count, np.uint64)
        for w in range(words):
            eq = masks[text[k], w, lane]
            x = eq | hn_in
            d0 = (((x & vp[w]) + vp[w]) ^ vp[w]) | x | vn[w]
            hp, hn = vn[w] | ~(d0 | vp[w]), d0 & vp[w]
            if at[w].any():
                score += (((hp >> last_bit) & one).astype(np.int64) - ((hn >> last_bit) & one).astype(np.int64)) * (at[w] & live)
            hp_out, hn_out = hp >> top, hn >> top
            hp, hn = (hp << one) | hp_in, (hn << one) | hn_in
            vp[w], vn[w] = hn | ~(d0 | hp), d0 & hp
            hp_in, hn_in = hp_out, hn_out
    return np.where(m == 0, n, score)


def _words(rows: np.ndarray) -> np.ndarray:
    """Truth values as words of 64 along the last axis."""
    full = np.zeros((*rows.shape[:-1], -(-rows.shape[-1] // 64) * 64), bool)
    full[..., : rows.shape[-1]] = rows
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def _sweep(m: np.ndarray, n: np.ndarray, limit: int, unlike: Callable[[int, int, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Distances, each pair in one bit of a word: exact up to ``limit``, some larger number beyond it.

    Cells of one anti-diagonal depend only on the one before, so all of them are worked out at once, as differences to their
    neighbours. Within ``limit`` edits no path leaves the diagonals between (n - m - limit) / 2 and (n - m + limit) / 2; the
    cells outside count as one more than their neighbours. The distance is |n - m| and one for each step along the pair's own
    diagonal that costs something. ``m`` and ``n`` are lengths, m with a last axis of 1 where a pattern meets all texts;
    ``unlike`` fills in the different symbols of the cells from (i, j) upwards and to the right.

    A cell costs one where its symbols differ, it is not below its left neighbour's upper one, v >= 0, and likewise h >= 0.
    Then v of the cell is that cost less h, and h that cost less v. The signs v >= 0, v <= 0, h <= 0, h >= 0 take fewest steps.
    """
    apart = n - m
    low, top = max(int(apart.min()), -limit), min(int(apart.max()), limit)
    out = np.broadcast_to(limit + 1, apart.shape).copy()
    if low > top:
        return out
    rows, columns, full = int(m.max()), int(n.max()), ~np.uint64(0)
    lo, hi = max(-rows, -((limit - low) // 2)), min(columns, (top + limit) // 2)
    marks = _words(apart == np.arange(low, top + 1).reshape(-1, *[1] * apart.ndim))
    shape, half, shortest = marks.shape[1:], (hi - lo) // 2 + 4, int(m.min())
    inside = _words(np.broadcast_to(m >= np.arange(rows + 1).reshape(-1, *[1] * m.ndim), (rows + 1, *apart.shape))) if shortest < rows else None
    v_up, h_up = ([np.full((half, *shape), full) for _ in range(2)] for _ in range(2))
    v_down, h_down = ([np.zeros((half, *shape), np.uint64) for _ in range(2)] for _ in range(2))
    free, room = np.empty((half, *shape), np.uint64), np.empty((half, *shape), np.uint64)
    # of two steps in a row, each goes along the own diagonal of other pairs
    paid = np.zeros(((rows + columns) // 2 + 1, *shape), np.uint64)
    both, either, differ = np.bitwise_and, np.bitwise_or, np.bitwise_xor
    for k in range(2, rows + columns + 1):
        first, last = max(lo, 2 - k, k - 2 * rows), min(hi, k - 2, 2 * columns - k)
        first += (k - first) & 1
        if first > last:
            continue
        count, odd, at = (last - first) // 2 + 1, (first - lo) & 1, (first - lo) // 2 + 1
        own, left, over = slice(at, at + count), slice(at - 1 + odd, at - 1 + odd + count), slice(at + odd, at + odd + count)
        left_up, left_down, over_up, over_down = v_up[1 - odd][left], v_down[1 - odd][left], h_up[1 - odd][over], h_down[1 - odd][over]
        z, t = free[:count], room[:count]
        unlike((k - first) // 2, (k + first) // 2, z, t)
        both(z, left_up, z)
        both(z, over_up, z)
        either(over_down, z, v_up[odd][own])
        both(over_down, z, t)
        differ(over_up, t, v_down[odd][own])
        both(left_down, z, t)
        differ(left_up, t, h_down[odd][own])
        either(left_down, z, h_up[odd][own])
        start, stop = max(first, low + ((low - k) & 1)), min(last, top)
        if start > stop:
            continue
        some = marks[start - low : stop - low + 1 : 2]
        t, i = t[: len(some)] if len(some) <= count else room[: len(some)], (k - start) // 2
        both(z[(start - first) // 2 :][: len(some)], some, t)
        if i > shortest:
            t &= inside[i - np.arange(len(some))]
        for row in t:
            either(paid[k // 2], row, paid[k // 2])
    steps = np.zeros((*shape[:-1], shape[-1] * 64), np.uint16 if len(paid) < 2**16 else np.int64)
    for at in range(0, len(paid), 128):
        steps += np.unpackbits(paid[at : at + 128].view(np.uint8), axis=-1, bitorder="little").sum(axis=0, dtype=np.uint8)
    known = np.abs(apart) <= limit
    out[known] = (steps[..., : apart.shape[-1]] + np.abs(apart))[known]
    return out


def _grid_distances(a: Texts, chosen: np.ndarray, b: Texts, symbols: int, limit: int, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distances) of tiles of the chosen patterns and all texts, which together hold every pair that can be within
    ``limit``; where ``inner`` says that both sides are one, each pair has its distance once, as (i, j) or (j, i). Like lengths stand together, so that a tile has few diagonals."""
    down, across = chosen[np.argsort(a.lengths[chosen], kind="stable")], np.argsort(b.lengths, kind="stable")
    width = max(64, min(64 * TEXT_WORDS, TABLE_BITS // ((symbols + 1) * max(1, b.grid.shape[1])) // 64 * 64))
    for t in range(0, len(across), width):
        texts = across[t : t + width]
        n = b.lengths[texts]
        columns = max(1, int(n.max()))
        grid = b.grid[texts, :columns].T
        table = np.stack([~_words(grid == s) if s else ~_words(np.zeros(grid.shape, bool)) for s in range(symbols + 1)]).reshape((symbols + 1) * columns, -1)
        for s in range(0, min(len(down), t + width) if inner else len(down), PATTERNS):
            some = down[s : s + PATTERNS]
            m = a.lengths[some]
            if m[0] > n[-1] + limit or m[-1] < n[0] - limit:
                continue
            rows = max(1, int(m[-1]))
            place, along = a.grid[some, :rows].T[::-1].astype(np.int64) * columns, np.arange(columns)[:, None]

            def unlike(i: int, j: int, z: np.ndarray, t: np.ndarray) -> None:
                table.take(place[rows - i : rows - i + len(z)] + along[j - 1 : j - 1 + len(z)], 0, z, "clip")

            d = _sweep(m[:, None], n, limit, unlike)
            if inner and s + len(some) > t:
                d[np.arange(s, s + len(some))[:, None] >= np.arange(t, t + len(texts))] = limit + 1
            yield some, texts, d


def _pair_distances(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray, symbols: int, limit: int) -> np.ndarray:
    """The distance of each pair (a[i], b[j]) up to ``limit``, and some larger number beyond it."""
    if symbols > 4:  # most pairs consist of the first four symbols only, which are the bases where there are any
        few = (a.grid.max(1) <= 4)[i] & (b.grid.max(1) <= 4)[j]
        if few.any():
            out = np.empty(len(i), np.int64)
            out[few] = _pair_distances(a, i[few], b, j[few], 4, limit)
            out[~few] = _pair_distances(a, i[~few], b, j[~few], symbols, limit) if not few.all() else 0
            return out
    out, one = np.full(len(i), limit + 1, np.int64), a.grid.dtype.type(1)
    m, n = a.lengths[i], b.lengths[j]
    todo = np.flatnonzero(np.abs(m - n) <= limit)
    todo = todo[np.lexsort((n[todo], m[todo]))]
    at = 0
    while at < len(todo):
        longest = int(m[todo[min(at + 64 * PAIR_WORDS, len(todo)) - 1]]) + limit
        some = todo[at : at + 64 * max(1, min(PAIR_WORDS, TABLE_BITS // (16 * 64 * (longest + 1))))]
        rows, columns = max(1, int(m[some].max())), max(1, int(n[some].max()))
        x, y = np.ascontiguousarray(a.grid[i[some], :rows].T[::-1]) - one, np.ascontiguousarray(b.grid[j[some], :columns].T) - one
        planes = [(_words(x >> p & 1), _words(y >> p & 1)) for p in range(max(1, (symbols - 1).bit_length()))]

        def unlike(i: int, j: int, z: np.ndarray, t: np.ndarray) -> None:
            for p, (up, along) in enumerate(planes):
                np.bitwise_xor(up[rows - i : rows - i + len(z)], along[j - 1 : j - 1 + len(z)], out=t if p else z)
                if p:
                    z |= t

        out[some] = _sweep(m[some], n[some], limit, unlike)
        at += len(some)
    return out


def base_distances(codes: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """The distance of each pair of rows of base codes up to ``limit``, and some larger number beyond it."""
    texts = Texts([], np.empty(0, np.uint32))
    texts.lengths, texts.inside = lengths, np.arange(codes.shape[1]) < lengths[:, None]
    texts.grid = (codes + np.uint8(1)) * texts.inside
    return _pair_distances(texts, i, texts, j, 4, limit)


def indexed_distances(texts: list[str], i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """The distance of each pair of ``texts`` up to ``limit``, and some larger number beyond it; for texts of like length."""
    alphabet = _alphabet(texts)
    grid = Texts(texts, alphabet)
    return _pair_distances(grid, i, grid, j, len(alphabet), limit)


def block_distances(left: list[str], right: list[str], limit: int, inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d) of all pairs within ``limit`` edits; ``inner`` takes i < j of one block with itself."""
    return block_counts(left, right, limit, limit, inner)[:3]


def block_counts(left: list[str], right: list[str], limit: int, keep: int, inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d) of all pairs within ``keep`` edits, and for each distance beyond it up to ``limit`` the number of pairs.

    Strings for which grams tell most pairs apart meet only those that share enough; all others meet side by side, first
    with their middle parts alone where these can tell pairs apart.
    """
    none, far = np.empty(0, np.int64), np.zeros(limit + 1, np.int64)
    if not left or not right:
        return none, none, none, far
    alphabet = _alphabet(left, right)
    a, b = Texts(left, alphabet), Texts(right, alphabet)
    q, telling = _telling(a, b, limit)
    middles = _middles(a, b, limit)
    found = [(none, none, none)]
    for kind in (True, False):
        down = np.flatnonzero(telling == kind)
        if not len(down):
            continue
        whole = inner and not kind and len(down) == len(left)
        if kind:
            sharing = _sharing if q > GRAMS[-1] else _sharing_parts
            parts = ((i, j, _pair_distances(a, i, b, j, len(alphabet), limit)) for i, j in sharing(a, down, b, limit, q, inner))
        elif middles:
            shared = ((i, j, d <= limit) for i, j, d in _grid_distances(middles[0], down, middles[1], len(alphabet), limit, whole))
            parts = ((i, j, _pair_distances(a, i, b, j, len(alphabet), limit)) for i, j in _gathered(shared))
        else:
            parts = _grid_distances(a, down, b, len(alphabet), limit, whole)
        for i, j, d in parts:
            if d.ndim == 2:
                row, column = np.nonzero(d <= limit)
                i, j, d = i[row], j[column], d[row, column]
            if whole:
                i, j = np.minimum(i, j), np.maximum(i, j)
            elif inner:
                some = i < j
                i, j, d = i[some], j[some], d[some]
            far += np.bincount(d[(d > keep) & (d <= limit)], minlength=limit + 1)
            close = d <= keep
            found.append((i[close], j[close], d[close]))
    return *(np.concatenate(c) for c in zip(*found)), far


def _middles(a: Texts, b: Texts, limit: int) -> tuple[Texts, Texts] | None:
    """All strings without as many symbols at either end, which often are alike. Their distance is at most that of the whole
    strings: what an alignment sets against the cut of one string is as many places off the cut of the other as there are
    edits before it, or after it at the end. None where such parts are too long to spare much."""
    size, length = int(MIDDLE * limit), int(np.median(a.lengths))
    if size > MOST_MIDDLE * length:
        return None
    return a.without_ends((length - size) // 2), b.without_ends((length - size) // 2)


def _gathered(tiles: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of what is true in tiles of patterns and texts, many at once."""
    one, two, held = [], [], 0
    for i, j, some in tiles:
        row, column = np.nonzero(some)
        one.append(i[row])
        two.append(j[column])
        held += len(row)
        if held > 64 * PAIR_WORDS:
            yield np.concatenate(one), np.concatenate(two)
            one, two, held = [], [], 0
    if held:
        yield np.concatenate(one), np.concatenate(two)


def _telling(a: Texts, b: Texts, limit: int) -> tuple[int, np.ndarray]:
    """A length of grams, and the patterns whose grams ``limit`` edits leave far more of than random texts share."""
    for q in GRAMS:
        telling = a.lengths - q + 1 - q * limit > a.lengths * (0.3 + (limit + 1) / 4**q)
        if q == GRAMS[-1]:  # places are told apart by parts: what random texts share, and two deviations
            share = 1 - np.exp(-np.minimum(a.lengths, a.lengths / PARTS + 1.5 * limit) / 4**q)
            telling = a.lengths - q + 1 - q * limit > a.lengths * share + 2 * np.sqrt(a.lengths * share)
            if 2 * np.count_nonzero(telling) > len(telling):
                return q, telling
            continue
        if 2 * np.count_nonzero(telling) > len(telling) and 4**q * len(np.unique(b.lengths)) * (b.grid.shape[1] + 1) <= GRAM_PLACES:
            return q, telling
    return 0, np.zeros(len(a.lengths), bool)


def _sharing(a: Texts, down: np.ndarray, b: Texts, limit: int, q: int, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), among them every pair within ``limit`` edits. An edit touches ``q`` grams at most, so all others of the
    longer string stand in the other one, and on a diagonal that so few edits can reach: between (n - m - limit) / 2 and
    (n - m + limit) / 2. Texts are listed by gram, length and place, so each gram of a pattern finds one run for a length."""
    lengths, rank = np.unique(b.lengths, return_inverse=True)
    width = b.grid.shape[1] + 1
    owner, place, code = b.grams(q)
    key = (code * len(lengths) + rank[owner]) * width + place
    order = np.argsort(key, kind="stable")
    owners = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=4**q * len(lengths) * width))])
    own, at, gram = a.grams(q)
    edge = np.searchsorted(own, np.arange(len(a.lengths) + 1))
    one, two, held = [], [], 0
    for i in down.tolist():
        m = int(a.lengths[i])
        some = np.flatnonzero(np.abs(lengths - m) <= limit)
        apart = lengths[some] - m
        mine = slice(edge[i], edge[i + 1])
        base, pos = (gram[mine, None] * len(lengths) + some) * width, at[mine, None]
        start = begin[base + np.clip(pos - (limit - apart) // 2, 0, width - 1)].ravel()
        size = begin[base + np.clip(pos + (limit + apart) // 2 + 1, 0, width - 1)].ravel() - start
        start, size = start[size > 0], size[size > 0]
        ends = np.cumsum(size)
        if not len(ends):
            continue
        hits = np.bincount(owners[np.repeat(start - ends + size, size) + np.arange(ends[-1])], minlength=len(b.lengths))
        j = np.flatnonzero(hits >= np.maximum(m, b.lengths) - q + 1 - q * limit)
        j = j[(np.abs(b.lengths[j] - m) <= limit) & ((j > i) | (not inner))]
        one.append(np.full(len(j), i))
        two.append(j)
        held += len(j)
        if held > 64 * PAIR_WORDS:
            yield np.concatenate(one), np.concatenate(two)
            one, two, held = [], [], 0
    if held:
        yield np.concatenate(one), np.concatenate(two)


def _sharing_parts(a: Texts, down: np.ndarray, b: Texts, limit: int, q: int, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_sharing``, for short grams, which are too frequent to list: how many grams of a pattern stand in a text at all,
    by a product of counts and presences. The grams of each part are sought as far beyond it as the diagonals reach; like
    lengths stand together, so that these are few."""
    codes, wide = 4**q, max(1, -(-int(np.median(a.lengths[down])) // PARTS))
    down, across = down[np.argsort(a.lengths[down], kind="stable")], np.argsort(b.lengths, kind="stable")
    number = np.full(len(a.lengths), -1)
    number[down] = np.arange(len(down))
    own, at, gram = a.grams(q)
    own, at, gram = (c[number[own] >= 0] for c in (own, at, gram))
    order = np.argsort(number[own], kind="stable")
    bins, edge = (number[own] * PARTS + np.minimum(at // wide, PARTS - 1))[order] * codes + gram[order], np.searchsorted(number[own][order], np.arange(len(down) + 1))
    owner, place, code = b.grams(q)
    lost = q - 1 + q * limit
    width = int(a.lengths[down].max()) - q + 1
    mine, theirs = np.zeros((len(a.lengths), width), np.uint8), np.zeros((len(b.lengths), limit + max(width + limit, b.grid.shape[1])), np.uint8)
    mine[own, at], theirs[owner, limit + place] = gram, code
    inside = np.arange(width) < (a.lengths - q + 1)[:, None]

    def near_places(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether enough grams stand in the text on a diagonal that ``limit`` edits can reach."""
        apart, out, step = b.lengths[j] - a.lengths[i], np.zeros(len(i), bool), max(1, 2**17 // width)
        for gap in np.unique(apart).tolist():
            every = np.flatnonzero(apart == gap)
            for k in range(0, len(every), step):
                some = every[k : k + step]
                x, y, met = mine[i[some]].T.copy(), theirs[j[some]].T.copy(), np.zeros((width, len(some)), bool)
                for shift in range(-((limit - gap) // 2), (limit + gap) // 2 + 1):
                    met |= x == y[limit + shift : limit + shift + width]
                shared = (met & inside[i[some]].T).sum(0)
                out[some] = shared >= np.maximum(a.lengths[i[some]], b.lengths[j[some]]) - lost
        return out

    def presences(texts: np.ndarray, back: int, ahead: int) -> np.ndarray:
        row = np.full(len(b.lengths), -1)
        row[texts] = np.arange(len(texts))
        some = np.flatnonzero(row[owner] >= 0)
        mine, at, gram, there = row[owner[some]], place[some], code[some], np.zeros((len(texts), PARTS * codes), np.float32)
        for part in range(PARTS):
            near = np.flatnonzero((at >= part * wide - back) & ((at < (part + 1) * wide + ahead) | (part == PARTS - 1)))
            there[mine[near], part * codes + gram[near]] = 1
        return there

    def products() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for t in range(0, len(across), PRODUCT_TEXTS):
            texts, known = across[t : t + PRODUCT_TEXTS], None
            for s in range(0, len(down), PRODUCT_ROWS):
                some = down[s : s + PRODUCT_ROWS]
                least, most = b.lengths[texts[0]] - a.lengths[some[-1]], b.lengths[texts[-1]] - a.lengths[some[0]]
                if least > limit or most < -limit:
                    continue
                # some places more, so that the same presences serve several products
                reach = tuple((limit + int(min(limit, gap)) + 1) // 2 // 3 * 3 + 2 for gap in (-least, most))
                if known != reach:
                    known, there = reach, presences(texts, *reach)
                counts = np.bincount(bins[edge[s] : edge[s + len(some)]] - s * PARTS * codes, minlength=len(some) * PARTS * codes).reshape(len(some), -1).astype(np.float32)
                hits = counts @ there.T
                row, j = np.divmod(np.flatnonzero(hits >= (a.lengths[some] - lost)[:, None].astype(np.float32)), len(texts))
                yield some[row], texts[j], hits[row, j]

    one, two, held = [], [], 0
    for i, j, shared in products():
        good = (shared >= b.lengths[j] - lost) & (np.abs(b.lengths[j] - a.lengths[i]) <= limit) & ((j > i) | (not inner))
        i, j = i[good], j[good]
        good = near_places(i, j)
        one.append(i[good])
        two.append(j[good])
        held += np.count_nonzero(good)
        if held > 64 * PAIR_WORDS:
            yield np.concatenate(one), np.concatenate(two)
            one, two, held = [], [], 0
    if held:
        yield np.concatenate(one), np.concatenate(two)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """The exact distance of each pair; pairs of like length share lanes, so long ones cost no others."""
    out = np.zeros(len(left), np.int64)
    order = np.array(sorted(range(len(left)), key=lambda k: max(len(left[k]), len(right[k]))), np.int64)
    at = 0
    while at < len(order):
        width = max(len(left[order[at]]), len(right[order[at]]), 64)
        some = order[at : at + LANES]
        some = some[: max(1, sum(max(len(left[k]), len(right[k])) <= 2 * width for k in some))]
        x, y = [left[k] for k in some], [right[k] for k in some]
        alphabet = _alphabet(x, y)
        a, b = Texts(x, alphabet), Texts(y, alphabet)
        lanes = np.arange(len(some))
        step = max(1, min(LANES, 2**26 // (a.grid.shape[1] * (len(alphabet) + 1))))
        out[some] = np.concatenate([_lanes(a, lanes[s : s + step], b, lanes[s : s + step], len(alphabet)) for s in range(0, len(some), step)])
        at += len(some)
    return out


#: Cells of the table that one step of ``distances_within`` looks places up in.
CELLS = 4_000_000


def distances_within(left: list[str], right: list[str], cutoff: int) -> np.ndarray:
    """The distance of each pair, cutoff + 1 where it is larger. On each diagonal near the main one, ``e`` edits reach as
    far as ``e`` - 1 edits and one more on it or beside it, and then along equal symbols; all pairs of a step go side by side."""
    m, n = (np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right))
    out = np.full(len(left), cutoff + 1, np.int64)
    todo = np.flatnonzero(np.abs(m - n) <= cutoff)
    todo, at = todo[np.argsort(n[todo], kind="stable")], 0
    while at < len(todo):
        step = max(1, CELLS // ((2 * cutoff + 1) * (int(n[todo[min(at + 1023, len(todo) - 1)]]) + 1)))
        some = todo[at : at + min(step, 1024)]
        out[some] = _reach([left[k] for k in some], [right[k] for k in some], m[some], n[some], cutoff)
        at += len(some)
    return out


def _rows(texts: list[str], lengths: np.ndarray, before: int, width: int, pad: int) -> np.ndarray:
    """(place, text): symbols plus 2, ``pad`` outside."""
    codes = _codes(texts) + np.uint32(2)
    grid = np.full((len(texts), width), pad, np.uint8 if not len(codes) or codes.max() < 256 else np.uint32)
    place = np.arange(width) - before
    grid[(place >= 0) & (place < lengths[:, None])] = codes
    return np.ascontiguousarray(grid.T)


def _reach(left: list[str], right: list[str], m: np.ndarray, n: np.ndarray, cutoff: int) -> np.ndarray:
    count, width, wide = len(left), int(n.max(initial=0)), 2 * cutoff + 1
    x, y = _rows(left, m, cutoff, max(width + 2 * cutoff, int(m.max(initial=0)) + cutoff), 0), _rows(right, n, 0, width, 1)
    kind = np.int16 if width < 2**15 else np.int32
    stop = np.empty((width + 1, wide, count), kind)  # the next place at which a diagonal's symbols differ
    stop[width] = width
    here, far = np.empty((wide, count), kind), kind(np.iinfo(kind).max)
    for j in range(width - 1, -1, -1):
        np.multiply(x[j : j + wide] == y[j], far, out=here)
        np.minimum(np.maximum(here, kind(j), out=here), stop[j + 1], out=stop[j])
    flat, lane = stop.ravel(), np.arange(wide * count).reshape(wide, count)
    diagonal = np.arange(-cutoff, cutoff + 1)[:, None]
    limit = np.minimum(n, m - diagonal)
    goal, lanes, none = m - n + cutoff, np.arange(count), -(2**30)
    reach = np.full((wide + 2, count), none, np.int64)  # a row more on either side
    d = np.full(count, cutoff + 1, np.int64)
    for e in range(cutoff + 1):
        if e == 0:
            moved = np.full((wide, count), none, np.int64)
            moved[cutoff] = 0
        else:
            moved = np.maximum(np.maximum(reach[1:-1] + 1, reach[2:] + 1), reach[:-2])
        moved = np.minimum(moved, limit)
        good = moved >= np.maximum(0, -diagonal)
        reach[1:-1] = np.where(good, flat[np.where(good, moved, 0) * (wide * count) + lane].astype(np.int64), none)
        d[(d > cutoff) & (reach[goal + 1, lanes] >= n)] = e
        if (d <= cutoff).all():
            break
    return d


@pandas_udf(T.IntegerType())
def exact_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance without a cutoff, a batch of pairs at a time; null where a side is null."""
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    left, right = a.to_numpy(), b.to_numpy()
    out = distances([left[i] for i in known], [right[i] for i in known])
    return pd.Series(out, index=a.index[known], dtype="Int32").reindex(a.index)


EQ, SUB, DEL, INS = range(4)
TAGS = ("EQ", "SUB", "DEL", "INS")


#: Diagonals on either side of the main one that alignments are looked for in first, then four times as many; cells of a piece.
NEAR_DIAGONALS, ALIGN_CELLS = 12, 2**22


def align_many(anchors: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, tag, pos, code point) of the operations that turn each anchor into its other string, in order.

    EQ, SUB and DEL stand at the anchor's place, INS before it. Among equally cheap scripts the walk back from the end takes
    a deletion first, then the diagonal, then an insertion. All pairs of a piece walk side by side.
    """
    parts, todo = [], np.arange(len(anchors))
    m, n = (np.fromiter(map(len, side), np.int64, len(side)) for side in (anchors, others))
    reach, most = NEAR_DIAGONALS, int(max(m.max(initial=0), n.max(initial=0)))
    while len(todo):
        reach, left = min(reach, most), []
        size = max(1, ALIGN_CELLS // ((int(m[todo].max()) + 1) * (2 * reach + 2)))
        for some in (todo[at : at + size] for at in range(0, len(todo), size)):
            within = some[np.abs(m[some] - n[some]) <= reach]
            found, (pair, tag, pos, ch) = _align_piece([anchors[k] for k in within], [others[k] for k in within], reach)
            parts.append((within[pair], tag, pos, ch))
            left += [some[np.abs(m[some] - n[some]) > reach], within[~found]]
        todo, reach = np.concatenate(left), 4 * reach
    if not parts:
        return (np.empty(0, np.int64),) * 4
    pair, tag, pos, ch = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(pair, kind="stable")
    return pair[order], tag[order], pos[order], ch[order]


def _align_piece(anchors: list[str], others: list[str], reach: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Which pairs lie within ``reach`` edits, and the operations of those. No cheapest script of theirs leaves the ``reach``
    diagonals on either side of the main one, so only these are filled; a cell beyond counts as far."""
    none = (np.empty(0, np.int64),) * 4
    if not anchors:
        return np.empty(0, bool), none
    alphabet = _alphabet(anchors, others)
    x, y = Texts(anchors, alphabet), Texts(others, alphabet)
    la, lb, wide = x.lengths, y.lengths, 2 * reach + 1
    kind = np.int16 if max(x.grid.shape[1], y.grid.shape[1]) < 2**13 else np.int32
    far, across = kind(np.iinfo(kind).max // 2), np.arange(wide, dtype=kind)
    a, b = x.grid.astype(np.int32), np.full((len(la), reach + max(y.grid.shape[1], x.grid.shape[1] + wide)), -1, np.int32)
    b[:, reach : reach + y.grid.shape[1]] = np.where(y.inside, y.grid.astype(np.int32), -1)
    table = np.full((a.shape[1] + 1, len(la), wide + 1), far, kind)
    table[0, :, reach:wide] = across[: reach + 1]
    for i in range(1, a.shape[1] + 1):
        row = np.minimum(table[i - 1, :, :wide] + (b[:, i - 1 : i - 1 + wide] != a[:, i - 1 : i]), table[i - 1, :, 1:] + kind(1))
        row -= across
        np.minimum.accumulate(row, axis=1, out=row)
        np.add(row, across, out=table[i, :, :wide])
        table[i, :, : max(0, reach - i)] = far
    found = table[la, np.arange(len(la)), lb - la + reach] <= reach
    i, j, live, steps = la.copy(), lb.copy(), np.flatnonzero(found & ((la > 0) | (lb > 0))), []
    while len(live):
        p, q = i[live], j[live]
        c = q - p + reach
        here, up = table[p, live, c], np.maximum(p - 1, 0)
        one, two = a[live, up], b[live, np.maximum(q - 1, 0) + reach]
        gone = (p > 0) & (here == table[up, live, c + 1] + 1)
        level = ~gone & (p > 0) & (q > 0) & (here == table[up, live, c] + (one != two))
        tag = np.where(gone, DEL, np.where(level, np.where(one == two, EQ, SUB), INS))
        steps.append((live, tag, np.where(tag == INS, p, p - 1), np.where(gone, 0, two)))
        i[live] -= gone | level
        j[live] -= ~gone
        live = live[(i[live] > 0) | (j[live] > 0)]
    if not steps:
        return found, none
    pair, tag, pos, ch = (np.concatenate(c[::-1]) for c in zip(*steps))
    order = np.argsort(pair, kind="stable")
    return found, (pair[order], tag[order], pos[order], np.concatenate([[0], alphabet]).astype(np.int64)[ch[order]])


def align(anchor: str, other: str) -> list[tuple[str, int, str | None]]:
    """The script of one pair."""
    _, tag, pos, ch = align_many([anchor], [other])
    return [(TAGS[t], int(p), None if t == DEL else chr(c)) for t, p, c in zip(tag, pos, ch)]


@pandas_udf(OPS)
def alignment_ops(anchor: pd.Series, other: pd.Series) -> pd.Series:
    """The script of each pair; null where a side is null."""
    known = np.flatnonzero((anchor.notna() & other.notna()).to_numpy())
    pair, tag, pos, ch = align_many(anchor.iloc[known].tolist(), other.iloc[known].tolist())
    rows: list[list[dict] | None] = [None] * len(anchor)
    for k in known:
        rows[k] = []
    for k, t, p, c in zip(known[pair].tolist(), tag.tolist(), pos.tolist(), ch.tolist()):
        rows[k].append({"tag": TAGS[t], "pos": p, "ch": None if t == DEL else chr(c)})
    return pd.Series(rows, index=anchor.index)
