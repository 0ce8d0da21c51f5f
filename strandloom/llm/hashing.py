"""Hashes, and arrays and texts packed for the shuffle, shared by the operators of this folder."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Letters that a packed text may hold, two bits each; all others are sent as UTF-8, compressed where that is shorter.
_LETTERS = b"ACGT"
_RAW, _DEFLATED = 255, 254
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(_LETTERS, np.uint8)] = np.arange(4)
_LAST = np.array([0xFF, 0xC0, 0xF0, 0xFC], np.uint8)
_FOUR = np.frombuffer(_LETTERS, np.uint8)[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of ``x``."""
    x = np.asarray(x).astype(np.uint64, copy=False)
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of integers as byte planes, so that what is alike stands together for compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize)[:, :width].T).tobytes()


def from_planes(blobs: pa.ChunkedArray, width: int, kind: type = np.int64) -> list[np.ndarray]:
    """Integers of ``kind`` from their planes; the planes cut off are zero."""
    out = []
    for blob in blobs.to_pylist():
        wide = np.zeros((len(blob) // width, np.dtype(kind).itemsize), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
        out.append(wide.view(kind).ravel())
    return out


def signed(values: np.ndarray, width: int) -> np.ndarray:
    """The sign that was cut off with the upper planes."""
    shift = np.int64(64 - 8 * width)
    return (values << shift) >> shift


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of all ranges one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _binary(kind: pa.DataType, size: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def pack_texts(column: pa.Array) -> pa.Array:
    """A text column without nulls as binary. A text of the four letters becomes a byte with the number of letters in the
    last byte, and four letters a byte; equal texts have equal bytes."""
    data, at = _flat(column)
    size = np.diff(at)
    bad = np.zeros(len(data) + 1, np.int64)
    codes = _CODE[data]
    np.cumsum(codes > 3, out=bad[1:])
    plain = bad[at[1:]] == bad[at[:-1]]
    other = {}
    for i in np.flatnonzero(~plain).tolist():
        raw = data[at[i] : at[i + 1]].tobytes()
        small = zlib.compress(raw, 1) if len(raw) > 200 else raw
        other[i] = bytes([_DEFLATED]) + small if len(small) < len(raw) else bytes([_RAW]) + raw
    width = np.where(plain, 1 + (size + 3) // 4, 0)
    width[list(other)] = [len(x) for x in other.values()]
    begin = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    own, last = begin[plain] + 1, begin[plain] + width[plain] - 1
    source = 4 * _ranges(np.zeros(len(own), np.int64), width[plain] - 1) + np.repeat(at[:-1][plain], width[plain] - 1)
    codes = np.concatenate([codes & 3, np.zeros(3, np.uint8)])
    out[_ranges(own, width[plain] - 1)] = (codes[source] << 6) | (codes[source + 1] << 4) | (codes[source + 2] << 2) | codes[source + 3]
    out[last] &= _LAST[size[plain] % 4]  # what follows is of the next text
    out[begin[plain]] = size[plain] % 4
    for i, x in other.items():
        out[begin[i] : begin[i] + len(x)] = np.frombuffer(x, np.uint8)
    return _binary(pa.binary(), width, out)


def unpack_texts(column: pa.Array) -> pa.Array:
    """The texts that were packed."""
    data, at = _flat(column)
    head = data[at[:-1]] if len(at) > 1 else np.empty(0, np.uint8)
    plain = head < 4
    other = {}
    for i in np.flatnonzero(~plain).tolist():
        raw = data[at[i] + 1 : at[i + 1]].tobytes()
        other[i] = zlib.decompress(raw) if head[i] == _DEFLATED else raw
    slots = 4 * (np.diff(at) - 1)
    size = np.where(plain, slots - (4 - head.astype(np.int64)) % 4, 0)
    size[list(other)] = [len(x) for x in other.values()]
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    letters = _FOUR[data[_ranges(at[:-1][plain] + 1, slots[plain] // 4)]].ravel()
    out[_ranges(begin[plain], size[plain])] = letters[_ranges(np.cumsum(slots[plain]) - slots[plain], size[plain])]
    for i, x in other.items():
        out[begin[i] : begin[i] + len(x)] = np.frombuffer(x, np.uint8)
    return _binary(pa.string(), size, out)
