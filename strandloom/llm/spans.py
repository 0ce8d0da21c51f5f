"""Spans of at least ``min_chars`` characters that stand letter for letter in more than one text.

Chunks are defined by content: a gear hash rolls over the text, and a cut falls wherever the hash is the least of some
window of ``WINDOW`` places. Equal stretches are therefore cut alike wherever they stand, after insertions too, and no gap
between cuts exceeds the window. Each chunk is digested with the next ones, as many as any span of ``min_chars`` must hold,
which finds the chunks that stand in several texts. The cuts a shared span is sure to hold depend on nothing outside it, so
it lies close around a run of shared chunks.

Chunks tell which texts hold them and at which distance. Where one chunk after the other stands in the same texts at the same
distances, all these texts share the whole run, and nothing in it needs comparing: any other text with a span of it would hold
one of its chunks. Of all other spans of exactly ``min_chars`` near shared chunks the digests are compared, which settles to
the letter where shared spans begin and end.

Comparisons send packed digests to buckets, whose number grows with the texts. A digest that several texts of one batch hold
goes there once, so a disclaimer that stands in a third of all texts costs no bucket more than one entry for each batch.

Defined results: a null text or id holds nothing; rows with the same id are one text (a span within one id is not shared);
equal texts share all they hold; texts shorter than ``min_chars`` share nothing; an empty table gives no rows; other columns
are ignored; positions count characters. Spans are equal where two digests of 64 and 32 bits are: among 10^10 spans, one
false pair is expected in 10^9 runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.hashing import from_planes, mix, planes, signed
from strandloom.session import partitions_for, planned_bytes

GEAR = 16
WINDOW = 64
SLICE = 1 << 18
#: Bytes of texts, as Spark plans them, whose digests make one bucket.
BUCKET_BYTES = 3 << 20
#: Digests of a task that go to their buckets together; the more they are, the better they pack.
HELD = 1_000_000
_ODD, _OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_ENTRIES = "bucket long, keys binary, more binary, docs binary, starts binary, sizes binary"
_LETTER = mix(np.arange(1, 65537, dtype=np.uint64))


class Slice:
    """Some texts laid end to end, with the digest of any stretch of them."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters = _LETTER[codes] if not len(codes) or codes.max() < 65536 else mix(codes.astype(np.uint64) + np.uint64(1))
        gear = (self.letters >> np.uint64(32)).astype(np.uint32)
        step = 1
        while step < GEAR:
            gear[step:] += gear[:-step].copy() << np.uint32(step)
            step *= 2
        self.gear = gear  # of the GEAR letters up to each place

    def digests(self, begin: np.ndarray, end: np.ndarray, base: int = _ODD) -> np.ndarray:
        n = len(self.letters) + 1
        power, inverse, sums = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64), np.zeros(n, np.uint64)
        power[0] = inverse[0] = 1
        np.cumsum(self.letters * np.cumprod(power)[:-1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * np.cumprod(inverse)[begin] ^ (end - begin).astype(np.uint64) * np.uint64(base))

    def cuts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the slice) of every cut."""
        n = len(self.gear)
        least = (self.gear.astype(np.uint64) << np.uint64(32)) | (np.uint64(2**32 - 1) - np.arange(n, dtype=np.uint64))
        width = 1
        while width < window and len(least):
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)[: len(least)]
        offset = np.arange(len(least)) - self.starts[text]
        whole = (offset >= GEAR - 1) & (offset + window <= self.lengths[text])
        place, text = (2**32 - 1) - (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[whole]
        new = np.diff(place, prepend=-1) != 0
        return text[new], place[new]


def window_for(min_chars: int) -> int:
    """So that a span of ``min_chars`` always holds two cuts of its own."""
    return max(1, min(WINDOW, (min_chars - GEAR) // 2))


def chunks_for(min_chars: int) -> int:
    """How many chunks in a row any span of ``min_chars`` is sure to hold, three at most: each cut is the least of at most
    ``window`` of the windows that lie inside the span."""
    window = window_for(min_chars)
    return max(1, min(3, -(-(min_chars - GEAR - window + 2) // window) - 1))


def packed_entries(keys: np.ndarray, more: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The entries of one batch by bucket; ``more`` are further bits of the keys. Sizes carry a mark: 256 where other texts
    of the batch hold the key too, 512 where the entry needs no comparison, because another one stands for it or because it
    came with that mark."""
    order = np.lexsort((starts, docs, keys))
    keys, more, docs, starts, sizes = keys[order], more[order], docs[order], starts[order], sizes[order]
    first = np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]
    at = np.flatnonzero(first)
    several = np.repeat(docs[at] != docs[np.r_[at[1:], len(keys)] - 1], np.diff(np.r_[at, len(keys)]))
    mark = np.where(sizes >= 512, 0, np.where(several, np.where(first, 256, 512), 0))
    bucket = (np.where(sizes + mark >= 512, mix(docs.view(np.uint64)), keys) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((starts, docs, bucket))
    bucket, keys, more, docs, starts, sizes = bucket[by], keys[by], more[by], docs[by], starts[by], (sizes + mark)[by]
    keys[sizes >= 512] = more[sizes >= 512] = 0
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = [(int(bucket[a]), planes(keys[a:b]), planes(more[a:b]), planes(np.diff(docs[a:b], prepend=0)), planes(np.diff(starts[a:b], prepend=0), 5), planes(sizes[a:b], 2)) for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 5))], ["bucket", "keys", "more", "docs", "starts", "sizes"])


def shared_entries(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, size, others) of the entries of one bucket whose key stands in more than one text. ``others`` says which
    texts hold the key and how far from this entry: it is the same for two entries of one text only where both stand in the
    same texts at the same distances. An entry whose texts are not all in sight, or twice in one text, has its own."""
    keys, more, sizes = np.concatenate(from_planes(group["keys"], 8, np.uint64)), np.concatenate(from_planes(group["more"], 4, np.uint32)), np.concatenate(from_planes(group["sizes"], 2))
    docs = np.concatenate([np.cumsum(d) for d in from_planes(group["docs"], 8)])
    starts = np.concatenate([np.cumsum(signed(d, 5)) for d in from_planes(group["starts"], 5)])
    known, weight = sizes >= 512, mix(docs.view(np.uint64))
    others = mix(weight + starts.astype(np.uint64))
    at = np.flatnonzero(~known)
    at = at[np.lexsort((docs[at], more[at], keys[at]))]
    if len(at):
        begin = np.flatnonzero(np.r_[True, (keys[at][1:] != keys[at][:-1]) | (more[at][1:] != more[at][:-1])])
        size = np.diff(np.r_[begin, len(at)])
        own = docs[at]
        several = (own[begin] != own[begin + size - 1]) | (np.maximum.reduceat(sizes[at], begin) >= 256)
        twice = np.add.reduceat(np.r_[False, own[1:] == own[:-1]].astype(np.int64) * ~np.isin(np.arange(len(at)), begin), begin) > 0
        plain = np.repeat(several & ~twice & (np.maximum.reduceat(sizes[at], begin) < 256), size)
        place = starts[at].astype(np.uint64)
        sums, moments = np.repeat(np.add.reduceat(weight[at], begin), size), np.repeat(np.add.reduceat(weight[at] * place, begin), size)
        others[at[plain]] = (moments - place * sums)[plain]
        known[at[np.repeat(several, size)]] = True
    return docs[known], starts[known], sizes[known] & 255, others[known]


def _slices(docs: np.ndarray, texts: list[str], least: int) -> Iterator[tuple[np.ndarray, Slice]]:
    """Texts that are long enough, some at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if text is not None and len(text) >= least:
            held.append(i)
            size += len(text)
            if size >= SLICE:
                yield docs[held], Slice([texts[j] for j in held])
                held, size = [], 0
    if held:
        yield docs[held], Slice([texts[j] for j in held])


def _joined(parts: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    if parts and sum(len(p[0]) for p in parts):
        yield packed_entries(*(np.concatenate(column) for column in zip(*parts)), buckets)


def shared_chunks(texts: DataFrame, min_chars: int, parts: int, buckets: int) -> DataFrame:
    """(doc, start, size, others): chunks in a row that stand in more than one text; ``texts`` is (doc, text)."""
    window, row = window_for(min_chars), chunks_for(min_chars)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for docs, piece in _slices(batch.column(0).to_numpy(), batch.column(1).to_pylist(), min_chars):
                text, cut = piece.cuts(window)
                same = text[row:] == text[:-row]
                begin, end, own = cut[:-row][same], cut[row:][same], text[:-row][same]
                keys = piece.digests(begin, end) & np.uint64(2**48 - 1)  # found again below with all bits
                parts.append((keys, np.zeros(len(keys), np.uint32), docs[own], begin - piece.starts[own], end - begin))
            yield from _joined(parts, buckets)

    def meet(group: pa.Table) -> pa.Table:
        docs, starts, sizes, others = shared_entries(group)
        return pa.table({"doc": docs, "start": pa.array(starts, pa.int32()), "size": pa.array(sizes, pa.int32()), "others": others.view(np.int64)})

    return texts.mapInArrow(emit, _ENTRIES).repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, "doc long, start int, size int, others long")


def stretches(starts: np.ndarray, sizes: np.ndarray, length: int, min_chars: int) -> list[tuple[int, int]]:
    """Places where spans of ``min_chars`` can begin: [from, to) around each run of shared chunks of one text."""
    window, order = window_for(min_chars), np.argsort(starts)
    begin, end = starts[order], (starts + sizes)[order]
    new = np.r_[True, begin[1:] > np.maximum.accumulate(end)[:-1]]
    at = np.flatnonzero(new)
    first, last = begin[at], np.maximum.reduceat(end, at)
    low = np.maximum(0, first - (GEAR + window - 2))
    high = np.minimum(length, last + window) - min_chars + 1
    out: list[tuple[int, int]] = []
    for a, b in zip(low.tolist(), high.tolist()):
        if out and a <= out[-1][1] and b > out[-1][1]:
            out[-1] = (out[-1][0], b)
        elif b > a and (not out or b > out[-1][1]):
            out.append((a, b))
    return out


def settled(starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, min_chars: int) -> list[tuple[int, int]]:
    """[from, to) of the spans' beginnings inside runs of chunks that the same texts share as a whole."""
    order = np.argsort(starts)
    begin, end, others = starts[order], (starts + sizes)[order], others[order]
    at = np.flatnonzero(np.r_[True, (others[1:] != others[:-1]) | (begin[1:] > end[:-1])])
    first, last = begin[at], end[np.r_[at[1:], len(begin)] - 1]
    return [(a, b - min_chars + 1) for a, b in zip(first.tolist(), last.tolist()) if b - a >= min_chars]


def shared_windows(texts: DataFrame, min_chars: int, parts: int, buckets: int) -> DataFrame:
    """(doc, starts): where spans of exactly ``min_chars`` begin that stand in another text; several rows for one text. Of a
    settled run there are as many as cover it."""
    chunks = shared_chunks(texts, min_chars, parts, buckets).groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in ("start", "size", "others")])
    placed = texts.repartition(parts, "doc").join(chunks, "doc").select("doc", "text", "start", "size", "others")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                texts, chunks, wanted = batch.column(1).to_pylist(), batch.columns[2:], {}
                for i, text in enumerate(texts):
                    start, size, others = (c[i].values.to_numpy() for c in chunks)
                    if text is not None and (ranges := stretches(start, size, len(text), min_chars)):
                        wanted[i] = ranges, settled(start, size, others, min_chars)
                for index, piece in _slices(np.arange(len(texts)), [t if i in wanted else None for i, t in enumerate(texts)], min_chars):
                    places, owners, marks = [], [], []
                    for k, i in enumerate(index.tolist()):
                        ranges, runs = wanted[i]
                        left = np.zeros(int(piece.lengths[k]), bool)
                        for a, b in ranges:
                            left[a:b] = True
                        for a, b in runs:
                            left[a:b] = False
                        known = [np.r_[np.arange(a, b, min_chars), b - 1] for a, b in runs]
                        own = np.concatenate([np.flatnonzero(left), *known])
                        places.append(own)
                        owners.append(np.full(len(own), k))
                        marks.append(np.where(np.arange(len(own)) < left.sum(), 0, 512))
                    start, own, mark = (np.concatenate(x) for x in (places, owners, marks))
                    if len(own):
                        begin = piece.starts[own] + start
                        more = (piece.digests(begin, begin + min_chars, _OTHER) >> np.uint64(32)).astype(np.uint32)
                        parts.append((piece.digests(begin, begin + min_chars), more, batch.column(0).to_numpy()[index[own]], start, mark))
                if sum(len(p[0]) for p in parts) >= HELD:
                    yield from _joined(parts, buckets)
                    parts = []
        yield from _joined(parts, buckets)

    def meet(group: pa.Table) -> pa.Table:
        docs, starts, *_ = shared_entries(group)
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order].astype(np.int32)
        at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(docs)], pa.int32()), pa.array(starts, pa.int32()))
        return pa.table({"doc": docs[at], "starts": lists if len(at) else pa.array([], pa.list_(pa.int32()))})

    return placed.mapInArrow(emit, _ENTRIES).repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, "doc long, starts array<int>")


def _found(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    parts = partitions_for(df.sparkSession, texts, BUCKET_BYTES)
    # several buckets a partition even out what hashing gives each; a bucket stays small where partitions have to grow
    return shared_windows(texts, min_chars, parts, max(2 * parts, planned_bytes(df) // BUCKET_BYTES))


def sharing_texts(df: DataFrame, id_col: str, text_col: str, min_chars: int = 300) -> DataFrame:
    """The ids of texts with a shared span, each once."""
    return _found(df, id_col, text_col, min_chars).select(F.col("doc").alias(id_col)).distinct()


def shared_spans(df: DataFrame, id_col: str, text_col: str, min_chars: int = 300) -> DataFrame:
    """(id, start, length): the stretches of each text that shared spans cover, as long as they reach."""
    starts = _found(df, id_col, text_col, min_chars).groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, begins, lengths = [], [], []
            for doc, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = places.values.to_numpy()
                cut = np.flatnonzero(np.diff(at, prepend=-(2**31)) > min_chars)
                begin, end = at[cut], at[np.r_[cut[1:], len(at)] - 1] + min_chars
                docs += [doc] * len(cut)
                begins += begin.tolist()
                lengths += (end - begin).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int32()), pa.array(lengths, pa.int32())], [id_col, "start", "length"])

    return starts.mapInArrow(merge, f"`{id_col}` long, start int, length int")
