"""Evaluation passages that stand in a training corpus.

The words of each shard of documents become a suffix array, sorted to full depth; every test suffix is looked up in it by
binary search, whose two neighbours give its longest verbatim match, and all places where at least ``min_words`` words agree
are followed to their own longest match. A shard is a run of documents inside one task, up to ``SHARD_WORDS`` words, so memory
is bounded and no text is shuffled. The test side is a stated query set: all its items are searched in one pass over the
corpus, a set of more than ``MOST_WORDS`` words in as many passes as it has times that many.

A word that no test item holds ends every match, so a suffix ends there, and suffixes of fewer than ``min_words`` words are
left out of the array.

Defined results: null texts and passages hold nothing; passages shorter than ``min_words`` words match nothing; empty tables
give no rows; a passage standing several times in one document, or in several documents, gives every place; repeated rows
of an item count once; repeated documents give their places each time in ``leak_places`` and once in ``leaked_pairs``;
other columns are ignored; texts are used whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.mail import decoded, words

SHARD_WORDS = 2_000_000
#: Words of test items that are sent to the executors at once, 20 bytes each and their vocabulary.
MOST_WORDS = 20_000_000
_SCHEMA = "doc_id long, item_id long, n_words int, doc_word int, item_word int"


def to_next_zero(ids: np.ndarray) -> np.ndarray:
    """How many words stand before the next 0, for each place; the last word is a 0."""
    ends = np.flatnonzero(ids == 0)
    place = np.arange(len(ids))
    return ends[np.searchsorted(ends, place)] - place


def suffix_array(ids: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """All places before a 0, by the words from there up to it. Ranks of ever longer beginnings are doubled until they tell
    all suffixes apart or reach the longest."""
    at, depth, key = np.flatnonzero(left), max(1, 63 // bits), np.zeros(len(ids), np.int64)
    for k in range(depth):
        key <<= bits
        key[: len(ids) - k] |= np.where(left[: len(ids) - k] > k, ids[k:], 0)
    rank = np.zeros(len(ids), np.int64)
    while len(at):
        order = np.argsort(key[at])
        sorted_keys = key[at][order]
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        rank[at[order]] = np.cumsum(new)
        if new.all() or depth >= left.max():
            return at[order]
        key[at] = rank[at] << 32
        on = at[left[at] > depth]
        key[on] |= rank[on + depth]
        depth *= 2
    return at


class TestSuffixes:
    """The words of the test items as numbers, and all their suffixes of at least ``depth`` words."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], depth: int):
        self.depth, self.vocabulary = depth, {}
        ids, sizes = [], []
        for _, passage in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(passage or "")]
            sizes.append(len(own) + 1)
            ids += own
            ids.append(0)
        self.ids, size = np.array(ids, np.int32), np.array(sizes, np.int64)
        self.owners = np.repeat(np.array([i for i, _ in items], np.int64), size)
        self.offsets = (np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.at = np.flatnonzero(to_next_zero(self.ids) >= depth).astype(np.int32) if len(ids) else np.empty(0, np.int32)

    def _common(self, ids: np.ndarray, shard: np.ndarray, test: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
        """How many words agree from two places on, ``known`` of them at least; up to ``most``."""
        length, alive = known.copy(), np.flatnonzero(known < most)
        while len(alive):  # both sides end in a 0
            x, y = ids[shard[alive] + length[alive]], self.ids[test[alive] + length[alive]]
            alive = alive[(x == y) & (x > 0)]
            length[alive] += 1
            alive = alive[length[alive] < most]
        return length

    def _bound(self, ids: np.ndarray, suffixes: np.ndarray, test: np.ndarray, most: int, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first suffix not before each test suffix, or with ``upper`` after it; words agreed with at best on the way), comparing
        ``most`` words. What agrees with both ends of the search agrees with all between."""
        low, high = np.zeros(len(test), np.int64), np.full(len(test), len(suffixes))
        below, above, best = (np.zeros(len(test), np.int64) for _ in range(3))
        active = np.arange(len(test))
        while len(active := active[low[active] < high[active]]):
            middle = (low[active] + high[active]) // 2
            shard = suffixes[middle]
            length = self._common(ids, shard, test[active], np.minimum(below[active], above[active]), most)
            x, y = ids[shard + length], self.ids[test[active] + length]
            right = np.where(length >= most, upper, x < y)
            low[active] = np.where(right, middle + 1, low[active])
            high[active] = np.where(right, high[active], middle)
            below[active] = np.where(right, length, below[active])
            above[active] = np.where(right, above[active], length)
            best[active] = np.maximum(best[active], length)
        return low, best

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the shard, place in the test words, words matched) of every match that cannot be begun earlier."""
        none = np.empty(0, np.int64)
        if not len(ids) or not len(self.at):
            return none, none, none
        left = to_next_zero(ids)
        # runs of known words that are too short hold no match; the others keep their places
        begin = np.flatnonzero((left > 0) & np.r_[True, ids[:-1] == 0])
        kept = np.zeros(len(ids) + 1, np.int64)
        long = begin[left[begin] >= self.depth]
        np.add.at(kept, long, 1)
        np.add.at(kept, long + left[long] + 1, -1)  # with the 0 that ends a run
        place = np.flatnonzero(np.cumsum(kept[:-1]))
        if not len(place):
            return none, none, none
        ids, left = ids[place], left[place]
        suffixes = suffix_array(ids, left, self.bits)
        suffixes = suffixes[left[suffixes] >= self.depth]
        test = self.at.astype(np.int64)
        # the neighbours of a test suffix agree with it longest, and the search has met both
        test = test[self._bound(ids, suffixes, test, 2**31, False)[1] >= self.depth]
        first, last = (self._bound(ids, suffixes, test, self.depth, upper)[0] for upper in (False, True))
        sizes = last - first
        test = np.repeat(test, sizes)
        shard = suffixes[np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        new = ~((shard > 0) & (test > 0) & (ids[shard - 1] == self.ids[test - 1]) & (self.ids[test - 1] > 0))
        shard, test = shard[new], test[new]
        return place[shard], test, self._common(ids, shard, test, np.full(len(shard), self.depth), 2**31)


def leak_places(documents: DataFrame, items: DataFrame, min_words: int = 12, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every longest match: (doc_id, item_id, n_words, doc_word, item_word)."""
    wanted = items.select(F.col("item_id").cast("long"), F.col("passage").cast("string")).where("item_id is not null and passage is not null").distinct()
    found = None
    for block in _blocks(wanted):
        part = _search_block(documents.select(F.col(doc_col).cast("long"), F.col(text_col)), TestSuffixes(block, min_words))
        found = part if found is None else found.unionByName(part)
    return documents.sparkSession.createDataFrame([], _SCHEMA) if found is None else found


def _blocks(wanted: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated test set, in one block up to ``MOST_WORDS`` words."""
    block, size = [], 0
    for row in wanted.orderBy("item_id").toLocalIterator():
        block.append((row[0], row[1]))
        size += row[1].count(" ") + 2
        if size >= MOST_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(documents: DataFrame, tests: TestSuffixes) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(tests)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        get = tests.vocabulary.get
        docs, pieces, size = [], [], 0

        def shard() -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, pieces)])
            place, test, length = tests.search(np.concatenate(pieces))
            doc = np.searchsorted(starts, place, "right") - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(docs, np.int64)[doc]), pa.array(tests.owners[test]), pa.array(length, pa.int32()), pa.array(place - starts[doc], pa.int32()), pa.array(tests.offsets[test], pa.int32())],
                ["doc_id", "item_id", "n_words", "doc_word", "item_word"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                own = words(decoded(text))
                docs.append(doc)
                pieces.append(np.fromiter((get(w, 0) for w in own), np.int32, len(own)))
                pieces[-1] = np.append(pieces[-1], np.int32(0))
                size += len(own)
                if size >= SHARD_WORDS:
                    yield shard()
                    docs, pieces, size = [], [], 0
        if pieces:
            yield shard()

    return documents.mapInArrow(search, _SCHEMA)


def leaked_pairs(documents: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """(doc_id, item_id), each once."""
    return leak_places(documents, items, min_words).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """The documents that hold no test passage, all columns kept."""
    leaked = leaked_pairs(documents, items, min_words).select("doc_id").distinct()
    return documents.join(leaked, "doc_id", "left_anti")
